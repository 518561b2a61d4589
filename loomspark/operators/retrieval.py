"""Ranking of texts: filters, BM25, boosts, fusion, and what is measured of them.

Everything is ranked: candidates are not cut off before scoring. Ties go to the id.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomspark.functions import scoring, text as T
from loomspark.operators.joins import among, small
from loomspark.session import materialize


def chunk_filter(chunk_type=None, difficulty=None, bloom_level=None, content_type=None, module_id=None, concept_tags=None, outcome_refs=None, min_tokens=0, max_tokens=0, week=None) -> Column:
    """One predicate from those given; None (and 0 for token limits) leaves one out. Missing tokens count as 0."""
    parts = [F.col(c) == F.lit(v) for c, v in (("chunk_type", chunk_type), ("difficulty", difficulty), ("bloom_level", bloom_level), ("content_type_label", content_type), ("source.module_id", module_id)) if v is not None]
    parts += [F.arrays_overlap(F.col(c), T.strings(v)) for c, v in (("concept_tags", concept_tags), ("learning_outcome_refs", outcome_refs)) if v]
    tokens = F.coalesce("tokens_estimate", F.lit(0))
    if min_tokens:
        parts.append(tokens >= min_tokens)
    if max_tokens:
        parts.append(tokens <= max_tokens)
    if week is not None:
        parts.append(F.coalesce(F.nullif(F.regexp_extract("source.module_id", r"(?i)(?:week[_\-\s]?|_w)(\d+)", 1), F.lit("")).cast("int") == week, F.lit(False)))
    return F.coalesce(reduce(lambda a, b: a & b, parts, F.lit(True)), F.lit(False))


def query_terms(spark: SparkSession, queries: list[tuple[int, str]]) -> DataFrame:
    """(query_id, term, mult): how often each ranking token stands in each query."""
    q = spark.createDataFrame(queries, "query_id int, query string")
    toks = T.tokenize(T.fold_references(F.col("query")))
    return q.select("query_id", F.explode(toks).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("mult"))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", within: tuple[str, ...] = ()) -> DataFrame:
    """(within, id, dl, term, tf) of the terms wanted, as a table in the shared folder.

    One pass over the texts: every text also has a row with the term '' (no token is
    empty), from which the statistics are taken, so that nothing is tokenised twice.
    """
    toks = T.tokenize(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(*within, F.col(id_col).alias("id"), toks.alias("toks"))
    rows = base.select(*within, "id", F.size("toks").alias("dl"), F.explode(F.array_append("toks", F.lit(""))).alias("term"))
    wanted = terms.select("term").distinct().union(terms.sparkSession.createDataFrame([("",)], "term string"))
    kept = among(rows, wanted, ["term"], F.col("id"))
    return materialize(kept.groupBy(*within, "id", "dl", "term").agg(F.count("*").alias("tf")), "postings")


def bm25(docs: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", within: tuple[str, ...] = ()) -> DataFrame:
    """(within, query_id, id, score): BM25 of every text that has a term of the query.

    `terms` is (within, query_id, term, mult). Each value of the `within` columns (a
    course, say) is an index of its own: its texts, its statistics, its queries. A term
    repeated in the query counts that often. Null texts have no tokens but count in the
    statistics.
    """
    post = postings(docs, terms, id_col, text_col, within)
    stats = post.where("term = ''").groupBy(*within).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    hits = post.where("term <> ''")
    df = hits.groupBy(*within, "term").agg(F.count("*").alias("df"))
    rows = terms.join(df, [*within, "term"])
    rows = rows.join(stats, list(within)) if within else rows.crossJoin(F.broadcast(stats))  # one row of statistics
    rows = materialize(rows.select(*within, "query_id", "term", "mult", "avgdl", scoring.bm25_idf(F.col("n_docs"), F.col("df")).alias("idf")), "query-terms")
    part = scoring.bm25_term(F.col("tf"), F.col("dl"), F.col("avgdl"), F.col("idf")) * F.col("mult")
    return hits.join(small(rows), [*within, "term"]).groupBy(*within, "query_id", "id").agg(F.sum(part).alias("score"))


def blend_trigrams(scores: DataFrame, docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", weight: float = 0.15) -> DataFrame:
    """(1 - w) score + w J score, J the similarity of trigrams with the first 500 characters."""
    grams = T.char_trigrams(F.lit(query))
    own = docs.select(F.col(id_col).alias("id"), T.char_trigrams(F.left(F.col(text_col), F.lit(500))).alias("g"))
    return scores.join(own, "id").select("query_id", "id", ((1 - weight) * F.col("score") + weight * T.jaccard(F.col("g"), grams) * F.col("score")).alias("score"))


def top_k(scores: DataFrame, k: int, floor: float = 0.0) -> DataFrame:
    """The k best of each query at or above `floor`, with rank from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scores.where(F.col("score") >= floor).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def concept_overlap(tags: Column, concepts: list[str]) -> Column:
    """Similarity of a chunk's lower-case tags and the query's concepts; 0 for null."""
    own = F.array_distinct(F.transform(F.filter(F.coalesce(tags, F.array().cast("array<string>")), lambda t: t.isNotNull()), lambda t: F.lower(t)))
    return T.jaccard(own, T.strings(sorted(set(concepts)))) if concepts else F.lit(0.0)


def outcome_match(refs: Column, explicit: list[str]) -> Column:
    """1 where a named outcome is among the chunk's."""
    return F.when(F.coalesce(F.arrays_overlap(F.transform(refs, lambda r: F.lower(r)), T.strings(explicit)), F.lit(False)), 1.0).otherwise(0.0)


def prerequisite_cover(needed: Column, covered: Column, violating: Column) -> Column:
    """-0.5 if a violating concept is needed, 0.7 if all needed are covered, else 0."""
    none = F.coalesce(F.size(needed), F.lit(0)) == 0
    return F.when(none, 0.0).when(F.arrays_overlap(needed, violating), -0.5).when(F.forall(needed, lambda p: F.array_contains(covered, p)), 0.7).otherwise(0.0)


def query_concepts(query: Column) -> Column:
    """What of a question may name a concept: its words, its hyphenated tokens and its pairs of neighbouring words."""
    low = F.lower(F.coalesce(query, F.lit("")))
    words = T.find_all(low, "[a-z0-9]+")
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws("-", a, b))
    return F.array_distinct(F.concat(words, T.find_all(low, "[a-z0-9]+(?:-[a-z0-9]+)+"), pairs))


def concepts_of_queries(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """(query_id, concept) of the concepts of a graph (nodes: concept) that questions (query_id, query) name."""
    own = queries.select("query_id", F.explode(query_concepts(F.col("query"))).alias("concept"))
    return own.join(nodes.select(F.lower("concept").alias("concept")).distinct(), "concept").select("query_id", "concept")


def targets_boost(chunks: DataFrame, edges: DataFrame, concepts: DataFrame, level: str | None = None, bonus: float = 0.2) -> DataFrame:
    """(query_id, id, boost) of chunks whose outcomes target a concept of the question.

    chunks (id, learning_outcome_refs), edges (source outcome, target concept,
    bloom_level), concepts (query_id, concept). The similarity of the concepts that a
    chunk's outcomes target and the question's, times 1 + bonus (1 at most) if one in
    common is targeted at `level`. Chunks without one in common have no row.
    """
    refs = chunks.select("id", F.explode("learning_outcome_refs").alias("r")).select("id", F.lower("r").alias("lo")).where("lo is not null").distinct()
    e = edges.select(F.lower("source").alias("lo"), F.lower("target").alias("concept"), F.lower("bloom_level").alias("b"))
    e = e.groupBy("lo", "concept").agg(F.max(F.coalesce(F.col("b") == F.lit(level.lower() if level else None), F.lit(False))).alias("fits"))
    e = materialize(e.where("lo is not null"), "targeted-concepts")
    # an outcome may target most concepts and be most chunks', so chunks don't meet concepts: those with the same outcomes
    # share a row, and concepts targeted by the same outcomes are one kind, named by 128 bits of them, with a count
    sets = materialize(refs.groupBy("id").agg(F.array_sort(F.collect_set("lo")).alias("los")), "outcome-sets")
    each = sets.select("los").distinct().select("los", F.explode("los").alias("lo"))
    of = e.groupBy("concept").agg(F.bit_xor(F.xxhash64("lo")).alias("h1"), F.bit_xor(F.xxhash64("lo", F.lit(1))).alias("h2"))
    kinds = of.groupBy("h1", "h2").agg(F.count("*").alias("n"))
    kind_of = e.join(of.withColumnRenamed("concept", "_c"), F.col("concept").eqNullSafe(F.col("_c"))).select("lo", "h1", "h2").distinct()
    n_own = each.join(kind_of, "lo").select("los", "h1", "h2").distinct().join(kinds, ["h1", "h2"]).groupBy("los").agg(F.sum("n").alias("n_own"))
    q = concepts.select("query_id", F.lower("concept").alias("concept")).distinct()
    n_q = q.groupBy("query_id").agg(F.count("*").alias("n_q"))
    hits = each.join(e.join(q, "concept"), "lo").groupBy("query_id", "los", "concept").agg(F.max("fits").alias("fits"))
    both = hits.groupBy("query_id", "los").agg(F.count("*").alias("k"), F.max("fits").alias("fits"))
    base = F.col("k") / (F.col("n_own") + F.col("n_q") - F.col("k"))
    boosts = both.join(n_own, "los").join(n_q, "query_id").select("query_id", "los", F.when(F.col("fits"), F.least(F.lit(1.0), base * (1 + bonus))).otherwise(base).alias("boost"))
    return sets.join(small(materialize(boosts, "boosts-of-sets")), "los").select("query_id", "id", "boost")


def statement_boost(refs: Column, query: str, outcomes: Column, explicit: list[str] = (), threshold: float = 0.4) -> Column:
    """1 where a named outcome is among the chunk's, 0.7 where the statement of one is like the question, else 0.

    `outcomes` is an array of (id, statement); outcomes named are those of `explicit`
    and ids such as `co-03` in the question.
    """
    import re

    named = sorted({x.lower() for x in explicit} | {m.lower() for m in re.findall(r"\b[a-z]{2}-\d{2,3}\b", query, re.I)})
    own = F.transform(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.lower(r))
    words = F.array_distinct(T.find_all(F.lower(F.lit(query)), "[a-z0-9]+"))
    like = F.exists(F.coalesce(outcomes, F.array().cast("array<struct<id:string,statement:string>>")), lambda o: F.array_contains(own, F.lower(o["id"])) & (T.jaccard(F.array_distinct(T.find_all(F.lower(o["statement"]), "[a-z0-9]+")), words) >= threshold))
    hit = F.arrays_overlap(own, T.strings(named)) if named else F.lit(False)
    return F.when(F.coalesce(hit, F.lit(False)), 1.0).when(F.coalesce(like, F.lit(False)), 0.7).otherwise(0.0)


def rationale(refs: Column, terms: Column, query: str) -> Column:
    """(refs, terms): the outcomes named in the question that the chunk has, and the chunk's key terms that stand in it."""
    import re

    named = sorted({m.lower() for m in re.findall(r"\b[a-z]{2}-\d{2,3}\b", query, re.I)})
    own = F.filter(F.coalesce(refs, F.array().cast("array<string>")), lambda r: F.lower(r).isin(named) if named else F.lit(False))
    hit = F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: (F.trim(t) != "") & F.contains(F.lit(query.lower()), F.lower(F.trim(t))))
    return F.struct(own.alias("refs"), F.array_distinct(hit).alias("terms"))


def text_variants(chunks: DataFrame) -> DataFrame:
    """(course, variant, id, text) of chunks (course, id, text, summary, key_terms): the text, the summary, and the summary with terms and definitions."""
    flat = F.array_join(F.filter(F.flatten(F.transform(F.coalesce("key_terms", F.array().cast("array<struct<term:string,definition:string>>")), lambda k: F.array(k["term"], k["definition"]))), lambda x: x.isNotNull() & (x != "")), " ")
    summary = F.coalesce("summary", F.lit(""))
    each = F.explode(F.create_map(F.lit("text"), F.coalesce("text", F.lit("")), F.lit("summary"), summary, F.lit("retrieval_text"), F.trim(F.concat_ws(" ", summary, flat)))).alias("variant", "body")
    return chunks.select("course", "id", each).withColumnRenamed("body", "text")


def recall_benchmark(variants: DataFrame, questions: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(variant, queries, recall_at_k...): mean recall over the questions that have a relevant chunk.

    variants (course, variant, id, text), questions (course, query_id, query), relevant
    (query_id, id). Every course's variant is an index of its own; all are ranked in one
    plan. Ties go to the id.
    """
    terms = questions.select("course", "query_id", F.explode(T.tokenize(T.fold_references(F.coalesce("query", F.lit(""))))).alias("term")).groupBy("course", "query_id", "term").agg(F.count("*").alias("mult"))
    names = variants.sparkSession.createDataFrame([("text",), ("summary",), ("retrieval_text",)], "variant string")
    scores = bm25(variants, terms.crossJoin(F.broadcast(names)), within=("course", "variant")).withColumn("score", F.round("score", 6))
    w = Window.partitionBy("variant", "query_id").orderBy(F.desc("score"), "id")
    ranked = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(ks))
    n_rel = relevant.groupBy("query_id").agg(F.count("*").alias("n")).crossJoin(F.broadcast(names))
    hit = ranked.join(relevant, ["query_id", "id"]).groupBy("variant", "query_id").agg(*[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    rows = n_rel.join(hit, ["variant", "query_id"], "left")
    return rows.groupBy("variant").agg(F.count("*").alias("queries"), *[F.avg(F.coalesce(f"h{k}", F.lit(0)) / F.col("n")).alias(f"recall_at_{k}") for k in ks])


def retrieve_for_objective(chunks: DataFrame, question: str, level: str, k: int) -> DataFrame:
    """(id, arm, score, position): the k best of the level's first kinds of chunk, filled up from its second kinds; ties go to the id."""
    from loomspark.operators.decompose import KINDS_OF_LEVEL

    first, second = KINDS_OF_LEVEL.get(level, KINDS_OF_LEVEL["understand"])
    scores = bm25(chunks, query_terms(chunks.sparkSession, [(1, question)]))
    arm = F.when(F.col("chunk_type").isin(first), 1).when(F.col("chunk_type").isin(second), 2)
    rows = scores.join(chunks.select("id", arm.alias("arm")).where("arm is not null"), "id")
    w = Window.partitionBy("arm").orderBy(F.desc("score"), "id")
    best = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)  # at most 2k rows go on to one order
    return best.withColumn("position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("arm", F.desc("score"), "id"))).where(F.col("position") <= k).select("id", "arm", "score", "position")


def report_difference(before: DataFrame, after: DataFrame, metrics: list[str], watched: dict[str, float]) -> DataFrame:
    """(metric, before, after, delta, regression) of two one-row reports; a watched metric regresses if it falls by more than its limit."""
    pick = lambda df: F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value")
    a, b = before.select(pick(before)).withColumnRenamed("value", "before"), after.select(pick(after)).withColumnRenamed("value", "after")
    limit = F.create_map(*[x for m, v in watched.items() for x in (F.lit(m), F.lit(float(v)))])[F.col("metric")]
    return a.join(b, "metric").withColumn("delta", F.col("after") - F.col("before")).withColumn("regression", F.coalesce(F.col("delta") < -limit, F.lit(False)))


def fuse(ranked: DataFrame, weights: dict[int, float], k: int = 60) -> DataFrame:
    """(id, fused, n_lists, sources map): reciprocal rank fusion with weights that add up to 1."""
    total = sum(weights.values()) or 1.0
    w = F.create_map(*[x for q, v in weights.items() for x in (F.lit(q), F.lit(v / total))])
    one = ranked.withColumn("part", scoring.rrf(F.col("rank"), w[F.col("query_id")], k))
    return one.groupBy("id").agg(F.sum("part").alias("fused"), F.count("*").alias("n_lists"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("query_id", "part")))).alias("sources"))


def greedy_distinct(results: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Results (id, score, text) in order of score; one too similar to one already kept is dropped.

    Word bigrams, similarity times the ratio of lengths. The pass depends on the order
    and so runs in one task: meant for result lists, whose length is a query's limit.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True])
        kept, sets = [], []
        for i, t in zip(pdf.index, pdf["text"].fillna("")):
            w = t.lower().split()
            g = set(zip(w, w[1:]))
            dup = any(g and h and len(g & h) / len(g | h) * min(len(w), n) / max(len(w), n) >= threshold for h, n in sets)
            if not dup:
                kept.append(i)
                sets.append((g, len(w)))
        return pdf.loc[kept]

    one = results.select("id", "score", "text", F.lit(0).alias("_all"))
    return one.groupBy("_all").applyInPandas(lambda pdf: run(pdf)[["id", "score", "text"]], "id string, score double, text string")


def metrics(ranked: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Per query: recall@k, hit@k, reciprocal rank and precision at 10.

    `ranked` is (query_id, id, rank), `relevant` (query_id, id). A query without results
    has 0 everywhere; the precision's denominator is the number retrieved, at most 10.
    """
    n_rel = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    got = ranked.groupBy("query_id").agg(F.least(F.count("*"), F.lit(10)).alias("retrieved"))
    hit = ranked.join(relevant, ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"), *[F.count_if(F.col("rank") <= k).alias(f"h{k}") for k in ks])
    rows = n_rel.join(got, "query_id", "left").join(hit, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select(
        "query_id", *[(zero(F.col(f"h{k}")) / F.col("n_relevant")).alias(f"recall_at_{k}") for k in ks], *[(zero(F.col(f"h{k}")) > 0).cast("int").alias(f"hit_at_{k}") for k in ks],
        F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col(f"h{ks[-1]}") / F.col("retrieved"), F.lit(0.0)).alias("precision_at_10"),
    )


def round_robin(chunks: DataFrame, by: Column, order: list, budget: int, per_group: int | None = None) -> DataFrame:
    """The first of every group, then the second of every group, to the budget."""
    w = Window.partitionBy("_g").orderBy(*order)
    rows = chunks.withColumn("_g", by).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= min(per_group or budget, budget))
    return rows.orderBy("_n", "_g").limit(budget).withColumn("turn", F.col("_n")).drop("_n", "_g")


def coherence(results: DataFrame) -> DataFrame:
    """One row: share of the largest domain, mean tag similarity of pairs, share found by several queries.

    Results (id, domain, tags, n_lists) are a query's result list.
    """
    a, b = results.select(F.col("id").alias("i"), F.col("tags").alias("x")), results.select(F.col("id").alias("j"), F.col("tags").alias("y"))
    pairs = a.join(b, F.col("i") < F.col("j")).agg(F.avg(T.jaccard(F.col("x"), F.col("y"))).alias("tag_similarity"))
    domain = results.groupBy("domain").count().agg((F.max("count") / F.sum("count")).alias("largest_domain"))
    multi = results.agg(F.avg((F.col("n_lists") > 1).cast("double")).alias("several_queries"))
    return domain.crossJoin(pairs).crossJoin(multi)  # three single rows
