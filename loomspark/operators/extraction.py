"""Statements, definitions, examples and questions found in text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomspark.functions import scoring, text as T

# Patterns of definitions, relations and examples; the first that fits a sentence counts.
DEFINITIONS = [r"^([A-Z][\w -]{2,60}?) (?:is|are) defined as (.+)$", r"^([A-Z][\w -]{2,60}?) refers to (.+)$", r"^([A-Z][\w -]{2,60}?) means (.+)$", r"^([A-Z][\w -]{2,60}?) (?:is|are) an? (.+)$"]
RELATIONS = [(name, rf"^(.+?) (?:{verbs}) (.+)$") for name, verbs in (("causes", "causes|leads to|results in"), ("part of", "is part of"), ("depends on", "depends on|requires"), ("enables", "enables|supports"), ("contrasts with", "differs from|contrasts with"))]
EXAMPLE = r"(?i)\bfor example\b|\bfor instance\b|\bsuch as\b|\be\.g\."
FACT = r"(?i)\b(?:is|are|was|were|has|have|contains?|includes?|shows?|measures?|controls?|changes?)\b"


def sentence_rows(df: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    return df.select(id_col, F.posexplode(T.sentences(F.col(text_col))).alias("pos", "sentence")).withColumn("sentence", T.collapse(F.col("sentence")))


def definitions(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, term, definition), each term once for a text."""
    s = sentence_rows(df, id_col)
    hit = F.coalesce(*[F.when(F.col("sentence").rlike(p), F.struct(F.regexp_extract("sentence", p, 1).alias("term"), F.regexp_extract("sentence", p, 2).alias("definition"))) for p in DEFINITIONS])
    rows = s.select(id_col, "pos", hit.alias("h")).where("h is not null")
    return rows.groupBy(id_col, F.col("h.term").alias("term")).agg(F.min_by("h.definition", "pos").alias("definition"))


def relations(df: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, relation, left, right): the first pattern that fits a sentence."""
    s = sentence_rows(df, id_col)
    hit = F.coalesce(*[F.when(F.col("sentence").rlike(p), F.struct(F.lit(n).alias("relation"), F.regexp_extract("sentence", p, 1).alias("left"), F.regexp_extract("sentence", p, 2).alias("right"))) for n, p in RELATIONS])
    return s.select(id_col, hit.alias("h")).where("h is not null").select(id_col, "h.*").distinct()


def facts(df: DataFrame, id_col: str = "id", shortest: int = 20, longest: int = 300) -> DataFrame:
    s = sentence_rows(df, id_col)
    return s.where(F.length("sentence").between(shortest, longest) & F.col("sentence").rlike(FACT) & F.col("sentence").rlike("^[A-Z]") & ~F.col("sentence").endswith("?")).select(id_col, "sentence").distinct()


def examples(df: DataFrame, id_col: str = "id") -> DataFrame:
    return sentence_rows(df, id_col).where(F.col("sentence").rlike(EXAMPLE)).select(id_col, "pos", "sentence")


def summary(text: Column, terms: Column, most: int = 3, least: int = 40, longest: int = 400) -> Column:
    """The best sentences in their order: +2 for the first, +1 for each of the terms in it, -0.5 over 40 words; cut to `longest`."""
    s = F.transform(T.sentences(text), T.collapse)
    low = F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.lower(t))
    scored = F.transform(s, lambda x, i: F.struct(
        (-(F.when(i == 0, 2.0).otherwise(0.0) + F.size(F.filter(low, lambda t: F.contains(F.lower(x), t))) - F.when(T.word_count(x) > 40, 0.5).otherwise(0.0))).alias("score"), i.alias("i"), x.alias("s")))
    best = F.slice(F.array_sort(scored), F.lit(1), F.lit(most))
    ordered = F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s"))))
    joined = F.array_join(F.transform(ordered, lambda x: x["s"]), " ")
    return F.when(F.length(joined) > longest, F.concat(F.regexp_extract(F.left(joined, F.lit(longest - 1)), r"(?s)^(.*)\s", 1), F.lit("…"))).when(F.length(joined) < least, F.left(T.collapse(F.coalesce(text, F.lit(""))), F.lit(longest))).otherwise(joined)


def content_profile(c: Column) -> dict[str, Column]:
    """Signals of a text: words, sentences, long words, reading ease, level of thinking, kind."""
    words = T.find_all(F.lower(F.coalesce(c, F.lit(""))), "[a-z]+")
    n, s = F.size(words), F.greatest(F.size(T.sentences(c)), F.lit(1))
    kinds = {"procedure": r"\bstep\b|\bfirst\b|\bthen\b", "definition": r"\bdefined\b|\bmeans\b|\brefers to\b", "example": r"\bexample\b|\binstance\b", "comparison": r"\bcompare\b|\bdiffer\b|\bwhereas\b|\bcontrast\b", "argument": r"\bbecause\b|\btherefore\b|\bthus\b"}
    low = F.lower(F.coalesce(c, F.lit("")))
    counts = F.array(*[F.struct(F.regexp_count(low, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(k).alias("k")) for i, (k, p) in enumerate(kinds.items())])
    best = F.array_max(counts)
    return {"words": n, "sentences": s, "long_words": F.size(F.filter(words, lambda w: F.length(w) > 6)), "bloom_level": scoring.detect_bloom(c), "kind": F.when(best["n"] > 0, best["k"]).otherwise(F.lit("exposition"))}


def negate(statement: Column) -> Column:
    """The statement with its first form of `be`, `can` or `has` denied; unchanged without one."""
    return reduce(lambda c, v: F.when(statement.rlike(rf"\b{v}\b"), F.regexp_replace(statement, rf"^(.*?)\b{v}\b", rf"$1{v} not")).otherwise(c), ["has", "can", "are", "is"], statement)


def blank_out(statement: Column, term: Column) -> Column:
    """The statement with the term's first place left open; null where it has none."""
    low = F.position(F.lower(term), F.lower(statement))
    return F.when(low > 0, F.concat(F.substr(statement, F.lit(1), low - 1), F.lit("_____"), F.substr(statement, low + F.length(term))))
