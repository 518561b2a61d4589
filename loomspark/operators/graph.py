"""Concept graphs of courses: untyped co-occurrence, typed edges by rules, centrality.

A graph is two tables with a course column, nodes (course, concept, frequency,
n_chunks, first_chunk) and edges (course, source, target, weight). All courses are built in one
plan. Typed edges are (course, source, target, type, confidence, rule).
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions.text import rule_slug, slug_item
from loomspark.session import materialize

#: Rank of a type where several rules name the same pair.
PRECEDENCE = {"is-a": 3, "prerequisite": 2, "assesses": 2, "exemplifies": 2, "misconception-of": 2, "derived-from-objective": 2, "defined-by": 2, "targets-concept": 2, "related-to": 1}
#: Patterns of a definition that names a kind, in order; and words that name nothing.
IS_A = [
    r"(?i)\bis\s+(?:a|an)\s+(?:type|form|kind|class|category|variant|subset)\s+of\s+(?:an?\s+|the\s+)?([^.,;:\n]+)", r"(?i)\bis\s+one\s+of\s+the\s+([^.,;:\n]+)",
    r"(?i)\brefers\s+to\s+(?:an?\s+|the\s+)([^.,;:\n]+)", r"(?i)\bis\s+(?:a|an)\s+([^.,;:\n]+)",
]
#: The rule that each type of edge comes from.
RULES = {
    "is-a": "is_a_from_key_terms", "prerequisite": "prerequisite_from_lo_order", "related-to": "related_from_cooccurrence", "assesses": "assesses_from_question_lo", "exemplifies": "exemplifies_from_example_chunks",
    "misconception-of": "misconception_of_from_misconception_ref", "derived-from-objective": "derived_from_lo_ref", "defined-by": "defined_by_from_first_mention", "targets-concept": "targets_concept_from_lo",
}
EMPTY_NAMES = "way method means tool thing example result process case situation step part".split()


def concept_mentions(chunks: DataFrame) -> DataFrame:
    """(course, id, concept): every mention, repeats kept; nulls and empty tags dropped."""
    rows = chunks.select(F.col("source.course_id").alias("course"), "id", F.explode("concept_tags").alias("t"))
    return rows.select("course", "id", slug_item(F.col("t")).alias("concept")).where("concept <> ''")


def tag_graph(mentions: DataFrame, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Nodes with `least` mentions or more, and the number of chunks in which two of them stand together.

    frequency counts mentions, n_chunks distinct chunk ids, first_chunk is the least of
    them; an edge joins two different concepts of a chunk once, source < target.
    """
    each = mentions.groupBy("course", "concept", "id").agg(F.count("*").alias("n"))  # an id's mentions first, so that no concept's ids are gathered
    nodes = each.groupBy("course", "concept").agg(F.sum("n").alias("frequency"), F.count("*").alias("n_chunks"), F.min("id").alias("first_chunk")).where(F.col("frequency") >= least)
    nodes = materialize(nodes, "concept-nodes")
    kept = mentions.join(nodes.select("course", "concept"), ["course", "concept"], "left_semi")
    sets = kept.groupBy("course", "id").agg(F.array_sort(F.collect_set("concept")).alias("c"))
    first = sets.select("course", "c", F.posexplode("c").alias("i", "source"))
    pairs = first.where(F.col("i") + 1 < F.size("c")).select("course", "source", F.explode(F.slice("c", F.col("i") + 2, F.size("c"))).alias("target"))
    return nodes, materialize(pairs.groupBy("course", "source", "target").agg(F.count("*").alias("weight")), "concept-edges")


def _typed(df: DataFrame, kind: str, confidence) -> DataFrame:
    conf = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return df.select("course", "source", "target", F.lit(kind).alias("type"), conf.alias("confidence"))


def related_to(edges: DataFrame, least: int = 3) -> DataFrame:
    return _typed(edges.where(F.col("weight") >= least), "related-to", F.least(F.lit(1.0), 0.4 + 0.05 * F.col("weight")))


def prerequisite(mentions: DataFrame, edges: DataFrame, outcome_refs: DataFrame, outcome_order: DataFrame) -> DataFrame:
    """Of two concepts together in a chunk, the one first met under a later outcome needs the other.

    outcome_refs (course, id, lo), outcome_order (course, lo, pos).
    """
    pos = outcome_refs.join(outcome_order, ["course", "lo"]).groupBy("course", "id").agg(F.min("pos").alias("pos"))
    first = mentions.join(pos, ["course", "id"]).groupBy("course", "concept").agg(F.min("pos").alias("pos"))
    a, b = first.select("course", F.col("concept").alias("source"), F.col("pos").alias("pa")), first.select("course", F.col("concept").alias("target"), F.col("pos").alias("pb"))
    both = edges.join(a, ["course", "source"]).join(b, ["course", "target"]).where("pa <> pb")
    later = F.when(F.col("pa") < F.col("pb"), F.struct(F.col("target").alias("s"), F.col("source").alias("t"))).otherwise(F.struct(F.col("source").alias("s"), F.col("target").alias("t")))
    return _typed(both.select("course", later.alias("x")).select("course", F.col("x.s").alias("source"), F.col("x.t").alias("target")), "prerequisite", 0.6)


def is_a(key_terms: DataFrame, nodes: DataFrame, longest: int = 6) -> DataFrame:
    """From (course, term, definition): the term's node is a kind of a node named in the defining phrase.

    The first pattern whose phrase names another node decides. Phrases are looked up
    by their runs of up to `longest` words, an equality join instead of a search for
    every node in every phrase.
    """
    names = nodes.select("course", "concept")
    t = key_terms.select("course", rule_slug(F.col("term")).alias("source"), "definition").where("source <> '' and definition is not null")
    t = t.join(names.withColumnRenamed("concept", "source"), ["course", "source"], "left_semi")
    phrases = F.array(*[F.struct(F.lit(i).alias("p"), rule_slug(F.regexp_extract("definition", p, 1)).alias("phrase")) for i, p in enumerate(IS_A)])
    t = t.select("course", "source", F.explode(phrases).alias("x")).where("x.phrase <> ''").select("course", "source", "x.p", F.split("x.phrase", "-").alias("w"))
    run = F.flatten(F.transform(F.sequence(F.lit(1), F.size("w")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size("w") - i + 1)), lambda n: F.concat_ws("-", F.slice(F.col("w"), i, n)))))
    hits = t.select("course", "source", "p", F.explode(F.array_distinct(run)).alias("concept")).join(names, ["course", "concept"]).where((F.col("concept") != F.col("source")) & ~F.col("concept").isin(EMPTY_NAMES))
    best = hits.withColumn("first", F.min("p").over(Window.partitionBy("course", "source"))).where("p = first")
    return _typed(best.select("course", "source", F.col("concept").alias("target")).distinct(), "is-a", 0.8)


def defined_by(nodes: DataFrame) -> DataFrame:
    return _typed(nodes.where("first_chunk is not null").select("course", F.col("concept").alias("source"), F.col("first_chunk").alias("target")), "defined-by", 0.7)


def derived_from_objective(outcome_refs: DataFrame) -> DataFrame:
    return _typed(outcome_refs.select("course", F.col("id").alias("source"), F.col("lo").alias("target")).distinct(), "derived-from-objective", 1.0)


def exemplifies(chunks: DataFrame, mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Chunks labelled examples (by content type, else by chunk type) with each of their concepts."""
    ex = chunks.where(F.coalesce("content_type_label", "chunk_type") == "example").select("id")
    m = mentions.join(ex, "id", "left_semi").join(nodes.select("course", "concept"), ["course", "concept"], "left_semi")
    return _typed(m.select("course", F.col("id").alias("source"), F.col("concept").alias("target")).distinct(), "exemplifies", 0.8)


def assesses(chunks: DataFrame, outcome_refs: DataFrame) -> DataFrame:
    q = chunks.where("chunk_type = 'assessment_item'").select("id")
    return _typed(outcome_refs.join(q, "id", "left_semi").select("course", F.col("id").alias("source"), F.col("lo").alias("target")).distinct(), "assesses", 1.0)


def misconception_of(misconceptions: DataFrame) -> DataFrame:
    """(course, mc_id, concept) with a concept."""
    return _typed(misconceptions.where("concept is not null").select("course", F.col("mc_id").alias("source"), F.col("concept").alias("target")).distinct(), "misconception-of", 1.0)


def targets_concept(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(course, lo, pos, concept): the first mention of each pair, for concepts that are nodes."""
    t = targets.join(nodes.select("course", "concept"), ["course", "concept"], "left_semi")
    return _typed(t.select("course", F.col("lo").alias("source"), F.col("concept").alias("target")).distinct(), "targets-concept", 1.0)


def by_precedence(rules: list[DataFrame]) -> DataFrame:
    """One edge for each ordered pair, the strongest type (ties: the earlier rule); no `related-to` where any other edge joins the pair."""
    tagged = [r.withColumn("_n", F.lit(i)) for i, r in enumerate(rules)]
    rank = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])[F.col("type")]
    rows = reduce(DataFrame.unionByName, tagged).withColumn("_r", rank)
    w = Window.partitionBy("course", "source", "target").orderBy(F.desc("_r"), "_n")
    best = rows.withColumn("_k", F.row_number().over(w)).where("_k = 1")
    pair = Window.partitionBy("course", F.least("source", "target"), F.greatest("source", "target"))
    best = best.withColumn("_top", F.max("_r").over(pair)).where("type <> 'related-to' or _top = 1")
    rule = F.create_map(*[F.lit(x) for kv in RULES.items() for x in kv])[F.col("type")]
    return best.select("course", "source", "target", "type", "confidence", rule.alias("rule"))


def cross_course(mentions: DataFrame) -> DataFrame:
    """(concept, courses, total_courses) of every concept, most widely used first by order of the last two."""
    return mentions.select("course", "concept").distinct().groupBy("concept").agg(F.array_sort(F.collect_list("course")).alias("courses"), F.count("*").alias("total_courses"))


def shared_edges(edges: DataFrame, index: DataFrame, least: int = 2) -> DataFrame:
    """Edges whose two ends are both used by `least` courses or more."""
    shared = index.where(F.col("total_courses") >= least).select("concept")
    return edges.join(shared.withColumnRenamed("concept", "source"), "source", "left_semi").join(shared.withColumnRenamed("concept", "target"), "target", "left_semi")


def tfidf_centrality(mentions: DataFrame) -> DataFrame:
    """(course, concept, frequency, df, frequency_score, tfidf_score): within the course, scaled by its largest."""
    n = mentions.groupBy("course").agg(F.count_distinct("id").alias("n"))
    f = mentions.groupBy("course", "concept").agg(F.count("*").alias("frequency"), F.count_distinct("id").alias("df")).join(n, "course")
    f = f.withColumn("raw", F.col("frequency") * (F.log(F.col("n") / (F.col("df") + 1)) + 1))
    w = Window.partitionBy("course")
    return f.select("course", "concept", "frequency", "df", (F.col("frequency") / F.max("frequency").over(w)).alias("frequency_score"), (F.col("raw") / F.max("raw").over(w)).alias("tfidf_score"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, cut_every: int = 10, tolerance: float = 1e-9) -> DataFrame:
    """(course, concept, rank): weighted and undirected, no redistribution of what isolated nodes hold.

    Each round is one join and one aggregation; the ranks are written out every
    `cut_every` rounds, where the change decides whether to go on.
    """
    both = edges.select("course", "source", "target", "weight").unionByName(edges.select("course", F.col("target").alias("source"), F.col("source").alias("target"), "weight")).where("source <> target")
    total = both.groupBy("course", "source").agg(F.sum("weight").alias("total"))
    share = materialize(both.join(total, ["course", "source"]).select("course", "source", "target", (F.col("weight") / F.col("total")).alias("share")), "shares")
    base = materialize(nodes.select("course", "concept", (1.0 / F.count("*").over(Window.partitionBy("course"))).alias("start")), "ranks")
    rank = base.select("course", "concept", F.col("start").alias("rank"))
    before = rank
    for i in range(rounds):
        inflow = rank.withColumnRenamed("concept", "source").join(share, ["course", "source"]).groupBy("course", F.col("target").alias("concept")).agg(F.sum(F.col("rank") * F.col("share")).alias("x"))
        rank = base.join(inflow, ["course", "concept"], "left").select("course", "concept", ((1 - damping) * F.col("start") + damping * F.coalesce("x", F.lit(0.0))).alias("rank"))
        if (i + 1) % cut_every == 0:
            rank = materialize(rank, "ranks")
            moved = rank.join(before.withColumnRenamed("rank", "old"), ["course", "concept"]).agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if moved is None or moved < tolerance:
                break
            before = rank
    return rank


def betweenness(nodes: DataFrame, edges: DataFrame, block: int = 256) -> DataFrame:
    """(course, concept, score): Brandes' sums over all sources, scaled by the course's largest.

    Each task has `block` sources and their course's edges; a graph is that of one
    course's vocabulary, and nothing passes through the driver.
    """
    n = nodes.groupBy("course").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sources = nodes.select("course", "concept").join(n, "course").select("course", "concept", F.pmod(F.xxhash64("concept"), F.col("blocks")).cast("int").alias("block"))
    spread = edges.select("course", "source", "target").join(n, "course").select("course", "source", "target", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(key, own, links):
        graph: dict = {}
        for a, b in zip(links["source"], links["target"]):
            graph.setdefault(a, []).append(b)
            graph.setdefault(b, []).append(a)
        out: dict = {}
        for s in own["concept"]:
            dist, sigma, before, order = {s: 0}, {s: 1.0}, {}, [s]
            for v in order:
                for w in graph.get(v, ()):
                    if w not in dist:
                        dist[w], sigma[w] = dist[v] + 1, 0.0
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
                        before.setdefault(w, []).append(v)
            delta = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before.get(w, ()):
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                if w != s:
                    out[w] = out.get(w, 0.0) + delta[w]
        return pd.DataFrame([(key[0], w, x) for w, x in out.items()], columns=["course", "concept", "part"])

    part = sources.groupBy("course", "block").cogroup(spread.groupBy("course", "block")).applyInPandas(run, "course string, concept string, part double")
    total = nodes.select("course", "concept").join(part.groupBy("course", "concept").agg(F.sum("part").alias("raw")), ["course", "concept"], "left").na.fill({"raw": 0.0})
    top = F.max("raw").over(Window.partitionBy("course"))
    return total.select("course", "concept", F.when(top > 0, F.col("raw") / top).otherwise(F.lit(0.0)).alias("score"))


def importance(scores: DataFrame) -> DataFrame:
    """composite of (frequency, tfidf, pagerank, betweenness) at 0.2, 0.3, 0.3, 0.2; position and band within the course."""
    comp = 0.2 * F.col("frequency_score") + 0.3 * F.col("tfidf_score") + 0.3 * F.col("pagerank_score") + 0.2 * F.col("betweenness_score")
    rows = scores.withColumn("composite", comp)
    w = Window.partitionBy("course")
    pos, n = F.row_number().over(w.orderBy(F.desc("composite"), "concept")), F.count("*").over(w)
    rows = rows.withColumn("position", pos).withColumn("_n", n)
    band = F.when(F.col("position") <= F.floor(F.col("_n") / 5), "core").when(F.col("position") <= F.floor(F.col("_n") / 2), "supporting").otherwise("peripheral")
    return rows.withColumn("band", band).drop("_n")
