"""Word runs that come back in many documents: found, merged into spans, removed, measured."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from loomspark.functions.text import ngrams
from loomspark.operators.joins import small
from loomspark.session import materialize

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def _words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda w: w != "").alias("w"))


def repeated_ngrams(docs: DataFrame, n: int = 15, share: float = 0.3, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(gram, n_docs) of word runs in at least max(2, share of the documents) documents.

    The threshold is rounded half to even. Runs are counted by two 64-bit hashes, with
    map-side aggregation in one shuffle; the words of a run are looked up only for those
    that are frequent, in any document that has it.
    """
    total = docs.count()
    least = max(2, int(round(total * share)))
    words = _words(docs, id_col, text_col)
    hashed = F.transform(ngrams(F.col("w"), n), lambda g: F.struct(F.xxhash64(g).alias("a"), F.xxhash64(F.lit(n), g).alias("b")))
    g = words.select("id", F.explode(F.array_distinct(hashed)).alias("h")).groupBy("h.a", "h.b").agg(F.count("*").alias("n_docs"), F.min("id").alias("id")).where(F.col("n_docs") >= least)
    often = materialize(g, "frequent-runs")
    holders = words.join(small(often.select("id").distinct()), "id", "left_semi")
    text = holders.select("id", F.explode(F.array_distinct(ngrams(F.col("w"), n))).alias("gram")).withColumn("a", F.xxhash64("gram")).withColumn("b", F.xxhash64(F.lit(n), "gram"))
    return materialize(text.join(small(often), ["id", "a", "b"]).select("gram", "n_docs").distinct(), "runs-of-words")


def spans(docs: DataFrame, grams: DataFrame, n: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(span, n_words): maximal stretches of consecutive frequent grams of a document, longest first by order of length.

    A stretch ends with its last gram; one that begins before the end of the stretch
    before it is left out, as in a scan that goes on from there.
    """
    words = _words(docs, id_col, text_col)
    at = words.select("id", "w", F.posexplode(ngrams(F.col("w"), n)).alias("pos", "gram")).join(small(grams.select("gram")), "gram", "left_semi")
    own = at.groupBy("id").agg(F.array_sort(F.collect_list("pos")).alias("pos"), F.first("w").alias("w"))
    start = F.array().cast("array<struct<a:int,b:int>>")

    def step(acc, p):
        last = F.element_at(acc, -1)
        new = F.struct(p.alias("a"), (p + n).alias("b"))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["a"].alias("a"), (p + n).alias("b"))))
        return F.when(F.size(acc) == 0, F.array(new)).when(p + n == last["b"] + 1, grown).when(p < last["b"], acc).otherwise(F.concat(acc, F.array(new)))

    found = own.select("w", F.explode(F.aggregate("pos", start, step)).alias("r"))
    return found.select(F.array_join(F.slice("w", F.col("r.a") + 1, F.col("r.b") - F.col("r.a")), " ").alias("span"), (F.col("r.b") - F.col("r.a")).alias("n_words")).distinct()


def strip_spans(c: Column, found: list[str]) -> Column:
    """The text with every span replaced by a space, whatever white space stands between its words. `found` is a short list."""
    for s in sorted(found, key=len, reverse=True):
        pattern = r"\s+".join(_SPECIAL.sub(r"\\\1", w) for w in s.split())
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n"))


def contamination(docs: DataFrame, grams: DataFrame, n: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(rate): share of the documents that hold a gram of `grams`."""
    words = _words(docs, id_col, text_col)
    hit = words.select("id", F.explode(F.array_distinct(ngrams(F.col("w"), n))).alias("gram")).join(small(grams.select("gram")), "gram", "left_semi").select("id").distinct()
    return docs.agg(F.count("*").alias("n")).crossJoin(hit.agg(F.count("*").alias("h"))).select((F.col("h") / F.col("n")).alias("rate"))


def boilerplate_issues(docs: DataFrame, grams: DataFrame, above: float = 0.1) -> DataFrame:
    """(gram, share, severity): an issue for every run of words in more than `above` of the documents; `high` in half of them or more."""
    n = docs.count()
    share = F.col("n_docs") / F.lit(float(max(n, 1)))
    return grams.select("gram", share.alias("share")).where(F.col("share") > above).withColumn("severity", F.when(F.col("share") >= 0.5, "high").otherwise("medium"))
