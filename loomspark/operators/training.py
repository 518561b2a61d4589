"""Training records: filters, formats, instruction and preference pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomspark.functions.text import find_all, jaccard

# One question for each level and kind of chunk; {0} stands for the topic.
TEMPLATES = {
    "remember": "What are the key facts about {0}?", "understand": "Explain {0} in your own words.", "apply": "Show how {0} is used in a practical case.",
    "analyze": "Take {0} apart: which parts matter and how do they relate?", "evaluate": "Judge {0}: what speaks for it and what against it?", "create": "Design an activity that builds on {0}.",
}


def eligible(chunks: DataFrame) -> DataFrame:
    """Chunks with an id and an outcome."""
    return chunks.where("id is not null and size(learning_outcome_refs) > 0")


def instruction_pairs(chunks: DataFrame, prompt_range=(40, 400), completion_range=(50, 600), leak: int = 50) -> DataFrame:
    """(id, prompt, completion, reason): one pair a chunk; reason is null where it passes.

    The prompt asks about the chunk's first concept by its level; the completion is
    the beginning of the text up to the last sentence end within its limit. Too short
    or long ones, and prompts that share `leak` characters with the text, are named.
    """
    topic = F.regexp_replace(F.coalesce(F.get("concept_tags", F.lit(0)), F.col("source.section_heading"), F.lit("this topic")), "[-_]+", " ")
    table = F.create_map(*[F.lit(x) for kv in TEMPLATES.items() for x in kv])
    ask = F.replace(F.coalesce(table[F.col("bloom_level")], F.lit(TEMPLATES["understand"])), F.lit("{0}"), topic)
    prompt = F.concat(F.lit("From the course material: "), ask)
    completion = F.regexp_extract(F.left(F.coalesce("text", F.lit("")), F.lit(completion_range[1])), r"(?s)^(.*[.!?])", 1)
    rows = chunks.select("id", prompt.alias("prompt"), completion.alias("completion"))
    reason = (
        F.when(~F.length("prompt").between(*prompt_range), "prompt length").when(~F.length("completion").between(*completion_range), "completion length")
        .when(F.exists(F.sequence(F.lit(1), F.greatest(F.length("prompt") - (leak - 1), F.lit(1))), lambda i: (F.length("prompt") >= leak) & F.contains("completion", F.substr("prompt", i, F.lit(leak)))), "leak")
    )
    return rows.withColumn("reason", reason)


def preference_pairs(chunks: DataFrame, most_alike: float = 0.7) -> DataFrame:
    """(id, prompt, chosen, rejected, similarity): a misconception against its correction, where they differ enough."""
    m = chunks.select("id", F.explode("misconceptions").alias("m")).where("m.misconception is not null and m.correction is not null")
    toks = lambda c: F.array_distinct(find_all(F.lower(c), "[a-z0-9]+"))
    rows = m.select("id", F.concat(F.lit("Is this right? "), F.col("m.misconception")).alias("prompt"), F.col("m.correction").alias("chosen"), F.col("m.misconception").alias("rejected"))
    return rows.withColumn("similarity", jaccard(toks(F.col("chosen")), toks(F.col("rejected")))).where(F.col("similarity") <= most_alike)


def alternatives_to_pairs(df: DataFrame, prompt: str, chosen: str, alternatives: str) -> DataFrame:
    """A row for each rejected alternative of a decision."""
    return df.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.explode(alternatives).alias("rejected")).where("rejected is not null and rejected <> chosen")


def alpaca(instruction: Column, context: Column, output: Column) -> Column:
    return F.to_json(F.struct(instruction.alias("instruction"), F.coalesce(context, F.lit("")).alias("input"), output.alias("output")))


def chat(system: Column, user: Column, assistant: Column) -> Column:
    msg = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return F.to_json(F.struct(F.array(msg("system", system), msg("user", user), msg("assistant", assistant)).alias("messages")))


def passes(quality_rank: Column, least: int, kind: Column, kinds: list[str] | None = None, rejected: Column | None = None) -> Column:
    """The export filter: quality at least `least`, of the kinds asked for, not rejected."""
    out = quality_rank >= least
    if kinds is not None:
        out = out & kind.isin(kinds)
    return out if rejected is None else out & ~F.coalesce(rejected, F.lit(False))
