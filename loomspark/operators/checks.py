"""Filters, checks and validations that give rows of findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions.text import STOP_WORDS, canonical_slug, find_all

# Allowed kinds of chunk and levels; question types that suit a level.
CHUNK_TYPES = ["assessment_item", "overview", "summary", "exercise", "explanation", "example"]
DIFFICULTIES = ["foundational", "intermediate", "advanced"]
LEVELS = ["remember", "understand", "apply", "analyze", "evaluate", "create"]
TYPES_OF_LEVEL = {"multiple_choice": ["remember", "understand", "apply", "analyze"], "true_false": ["remember", "understand"], "short_answer": ["understand", "apply", "analyze"], "essay": ["analyze", "evaluate", "create"]}
# Terms that are contents-table scraps.
SCRAPS = r"(?i)^(?:chapter|section|page|figure|table|unit|week|part)\s*\d*(?:\.\d+)*$|^\d+(?:\.\d+)*$|\.{3,}|\s\d{1,4}$"


def tag_verdict(tag: Column, allowed: list[str] | None = None) -> tuple[Column, Column]:
    """(normalized, reason): reason is null for a good tag."""
    slug = canonical_slug(tag)
    words = F.filter(F.split(slug, "-"), lambda w: w != "")
    reason = (
        F.when(slug == "", "empty").when(F.forall(words, lambda w: w.isin(STOP_WORDS)), "stop words only").when(~slug.rlike("^[a-z]"), "no letter first").when(F.size(words) > 4, "too many words").when(slug.contains("--"), "format")
    )
    if allowed is not None:
        reason = reason.when(~slug.isin(allowed), "not in the vocabulary")
    return slug, reason


def clean_tags(tags: Column) -> Column:
    """Normalized good tags in order, each once."""
    return F.array_distinct(F.transform(F.filter(F.filter(tags, lambda t: t.isNotNull()), lambda t: tag_verdict(t)[1].isNull()), canonical_slug))


def is_scrap(term: Column) -> Column:
    return F.trim(term).rlike(SCRAPS)


def schema_findings(chunks: DataFrame) -> DataFrame:
    """(id, finding): missing required fields, unknown kinds and levels, negative numbers."""
    rules = {
        "text missing": F.col("text").isNull(), "course missing": F.col("source.course_id").isNull(), "module missing": F.col("source.module_id").isNull(), "tags missing": F.col("concept_tags").isNull(), "outcomes missing": F.col("learning_outcome_refs").isNull(),
        "unknown chunk type": ~F.coalesce(F.col("chunk_type").isin(CHUNK_TYPES), F.lit(False)), "unknown difficulty": F.col("difficulty").isNotNull() & ~F.col("difficulty").isin(DIFFICULTIES), "unknown level": F.col("bloom_level").isNotNull() & ~F.col("bloom_level").isin(LEVELS),
        "tokens missing": F.col("tokens_estimate").isNull(), "words missing": F.col("word_count").isNull(), "negative size": F.coalesce(F.least("tokens_estimate", "word_count"), F.lit(0)) < 0,
    }
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return chunks.select("id", F.explode(found).alias("finding"))


def cumulative_counts(df: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, kept): rows left after each stage of a filter, in one pass."""
    so_far, cols = F.lit(True), []
    for name, c in stages:
        so_far = so_far & F.coalesce(c, F.lit(False))
        cols.append(F.count_if(so_far).alias(name))
    names = [n for n, _ in stages]
    return df.agg(*cols).unpivot([], names, "stage", "kept")


def question_findings(chunks: DataFrame, fewest: int = 3) -> DataFrame:
    """(id, finding) of multiple-choice texts: a stem, then choices marked `A)`, `B)` ... on lines of their own."""
    choices = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*[A-H][).]\s")), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^\s*[A-H][).]\s+", ""))))
    stem = F.trim(F.split("text", r"\n\s*[A-H][).]\s")[0])
    rules = {"few choices": F.size(choices) < fewest, "equal choices": F.size(F.array_distinct(choices)) < F.size(choices), "short stem": F.length(stem) < 20, "no question": ~F.contains("text", F.lit("?")), "placeholder": F.lower("text").rlike(r"plausible distractor|correct answer based on content|\btodo\b|\btbd\b")}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    return chunks.where("chunk_type = 'assessment_item' and text is not null").select("id", F.explode(found).alias("finding"))


def choice_use(chunks: DataFrame) -> DataFrame:
    """(choice, n_questions): how many questions offer the same choice."""
    q = chunks.where("chunk_type = 'assessment_item' and text is not null")
    c = F.transform(F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^\s*[A-H][).]\s")), lambda x: F.lower(F.trim(F.regexp_replace(x, r"^\s*[A-H][).]\s+", ""))))
    return q.select("id", F.explode(F.array_distinct(c)).alias("choice")).groupBy("choice").agg(F.count("*").alias("n_questions"))


def samples_and_rest(findings: DataFrame, keys: list[str], order: str, show: int = 3) -> DataFrame:
    """The first few of each group, and how many there are."""
    w = Window.partitionBy(*keys)
    rows = findings.withColumn("n", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(order)))
    return rows.where(F.col("k") <= show)


def first_strategy(results: list[DataFrame], least: int, id_col: str = "id") -> DataFrame:
    """Results of the first strategy with `least` rows or more, else of the last; with its number."""
    tagged = reduce(DataFrame.unionByName, [r.withColumn("strategy", F.lit(i)) for i, r in enumerate(results)])
    sizes = tagged.groupBy("strategy").agg(F.count("*").alias("n"))
    pick = sizes.agg(F.coalesce(F.min(F.when(F.col("n") >= least, F.col("strategy"))), F.lit(len(results) - 1)).alias("pick"))
    return tagged.join(F.broadcast(pick), F.col("strategy") == F.col("pick")).drop("pick")  # one row


def merge_lists(primary: DataFrame, secondary: DataFrame, limit: int, id_col: str = "id", order: str = "pos") -> DataFrame:
    """The first list, then what the second adds, each id once, to the limit."""
    both = primary.withColumn("_s", F.lit(0)).unionByName(secondary.withColumn("_s", F.lit(1)))
    one = both.withColumn("_k", F.row_number().over(Window.partitionBy(id_col).orderBy("_s", order))).where("_k = 1")
    return one.orderBy("_s", order, id_col).limit(limit).drop("_k", "_s")


def key_values(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, value): `Key: value` lines, each with the lines after it up to the next key or a blank line."""
    lines = df.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("pos", "line"))
    key = F.nullif(F.regexp_extract("line", r"^\s*([A-Z][\w ]{1,38}):\s+\S", 1), F.lit(""))
    w = Window.partitionBy(id_col).orderBy("pos")
    part = F.sum(F.when(key.isNotNull() | (F.trim("line") == ""), 1).otherwise(0)).over(w)
    rows = lines.withColumn("key", key).withColumn("part", part)
    g = rows.groupBy(id_col, "part").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "line"))).alias("x")).where(F.col("x")[0]["key"].isNotNull())
    rest = F.transform("x", lambda r: F.when(r["key"].isNotNull(), F.regexp_replace(r["line"], r"^\s*[A-Z][\w ]{1,38}:\s+", "")).otherwise(r["line"]))
    return g.select(id_col, F.col("x")[0]["key"].alias("key"), F.trim(F.regexp_replace(F.array_join(rest, " "), r"\s+", " ")).alias("value"))


def formulas(c: Column) -> Column:
    """Formulas in TeX marks, and plain equations."""
    return F.concat(find_all(c, r"\$[^$\n]+\$|\\\([^\n]+?\\\)"), find_all(c, r"[a-zA-Z][a-zA-Z0-9_]* = [^.,;\n]{1,60}"))


def canonical_names(c: Column, aliases: dict[str, str]) -> Column:
    """Names in the text by their canonical form, longest alias first; aliases are a parameter."""
    for a in sorted(aliases, key=lambda x: (-len(x), x)):
        c = F.regexp_replace(c, rf"(?i)\b{a}\b", aliases[a])
    return c
