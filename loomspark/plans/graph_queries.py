"""Queries of concept graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import ids
from loomspark.operators import graph as G
from loomspark.plans.registry import ONCE, query
from loomspark.session import materialize
from loomspark.tables import once_per_id, table

_G = f"""WITH {ONCE}, me AS (SELECT source.course_id AS course, id, unnest(concept_tags) AS t FROM one),
mn AS (SELECT course, id, trim(regexp_replace(lower(t), '[ \\t\\n\\r\\x{{A0}}_\\-\\x{{2010}}-\\x{{2013}}]+', '-', 'g'), '-') AS concept FROM me WHERE t IS NOT NULL),
m AS (SELECT * FROM mn WHERE concept <> ''), nd AS (SELECT course, concept, count(*) AS frequency, count(DISTINCT id) AS n_chunks, min(id) AS first_chunk FROM m GROUP BY ALL HAVING count(*) >= 2),
dm AS (SELECT DISTINCT course, id, concept FROM m JOIN nd USING (course, concept)),
ed AS (SELECT a.course, a.concept AS source, b.concept AS target, count(*) AS weight FROM dm a JOIN dm b ON a.course = b.course AND a.id = b.id AND a.concept < b.concept GROUP BY ALL),
rf AS (SELECT source.course_id AS course, id, lower(r) AS lo FROM (SELECT source, id, unnest(learning_outcome_refs) AS r FROM one) WHERE r IS NOT NULL),
lo AS (SELECT course_code AS course, lower(x.id) AS lo, min(pos) AS pos FROM (SELECT course_code, unnest(learning_outcomes) AS x, generate_subscripts(learning_outcomes, 1) - 1 AS pos FROM courses) WHERE x.id IS NOT NULL GROUP BY ALL),
fp AS (SELECT m.course, concept, min(p.pos) AS pos FROM m JOIN (SELECT rf.course, id, min(pos) AS pos FROM rf JOIN lo USING (course, lo) GROUP BY ALL) p ON p.course = m.course AND p.id = m.id GROUP BY ALL),
pre AS (SELECT e.course, CASE WHEN a.pos < b.pos THEN target ELSE source END AS source, CASE WHEN a.pos < b.pos THEN source ELSE target END AS target FROM ed e JOIN fp a ON a.course = e.course AND a.concept = e.source JOIN fp b ON b.course = e.course AND b.concept = e.target WHERE a.pos <> b.pos),
rel AS (SELECT course, source, target, least(1.0, 0.4 + 0.05 * weight)::DOUBLE AS confidence FROM ed WHERE weight >= 3)"""


class Parts:
    """What the graph queries share: chunks once per id, mentions, nodes, edges, outcomes."""

    def __init__(self, spark, d):
        self.chunks = once_per_id(table(spark, d, "chunks").drop("text"))
        self.mentions = materialize(G.concept_mentions(self.chunks), "mentions")
        self.nodes, self.edges = G.tag_graph(self.mentions)
        r = self.chunks.select(F.col("source.course_id").alias("course"), "id", F.explode("learning_outcome_refs").alias("r"))
        self.refs = materialize(r.select("course", "id", F.lower("r").alias("lo")).where("lo is not null"), "outcome-refs")
        o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.posexplode("learning_outcomes").alias("pos", "x"))
        self.order = o.select("course", F.lower("x.id").alias("lo"), "pos").where("lo is not null").groupBy("course", "lo").agg(F.min("pos").alias("pos"))


@query("concept_nodes", f"{_G} SELECT course, concept, frequency::BIGINT AS frequency, n_chunks, first_chunk FROM nd")
def _(spark, d):
    return Parts(spark, d).nodes


@query("concept_edges", f"{_G} SELECT course, source, target, weight FROM ed")
def _(spark, d):
    return Parts(spark, d).edges


def _rule(name, sql):
    def keep(f):
        query(f"rule_{name}", f"{_G} {sql}")(lambda spark, d: f(Parts(spark, d)).select("course", "source", "target", F.round("confidence", 6).alias("confidence")))
        return f

    return keep


@_rule("related_to", "SELECT course, source, target, round(confidence, 6) AS confidence FROM rel")
def _(p):
    return G.related_to(p.edges)


@_rule("prerequisite", "SELECT course, source, target, 0.6::DOUBLE AS confidence FROM pre")
def _(p):
    return G.prerequisite(p.mentions, p.edges, p.refs, p.order)


@_rule("defined_by", "SELECT course, concept AS source, first_chunk AS target, 0.7::DOUBLE AS confidence FROM nd")
def _(p):
    return G.defined_by(p.nodes)


@_rule("derived_from_objective", "SELECT DISTINCT course, id AS source, lo AS target, 1.0::DOUBLE AS confidence FROM rf")
def _(p):
    return G.derived_from_objective(p.refs)


@_rule("exemplifies", "SELECT DISTINCT course, id AS source, concept AS target, 0.8::DOUBLE AS confidence FROM dm JOIN one USING (id) WHERE coalesce(content_type_label, chunk_type) = 'example'")
def _(p):
    return G.exemplifies(p.chunks, p.mentions, p.nodes)


@_rule("assesses", "SELECT DISTINCT course, id AS source, lo AS target, 1.0::DOUBLE AS confidence FROM rf JOIN one USING (id) WHERE chunk_type = 'assessment_item'")
def _(p):
    return G.assesses(p.chunks, p.refs)


_MC = "SELECT DISTINCT source.course_id AS course, 'mc_' || left(sha256(lower(trim(x.misconception)) || '|' || lower(trim(coalesce(x.correction, '')))), 16) AS source, c AS target, 1.0::DOUBLE AS confidence FROM (SELECT source, unnest(misconceptions) AS x, concept_tags[1] AS c FROM one) WHERE x.misconception IS NOT NULL AND c IS NOT NULL"


@_rule("misconception_of", _MC)
def _(p):
    m = p.chunks.select(F.col("source.course_id").alias("course"), F.explode("misconceptions").alias("x"), F.get("concept_tags", F.lit(0)).alias("concept")).where("x.misconception is not null")
    return G.misconception_of(m.select("course", ids.misconception_id(F.col("x.misconception"), F.col("x.correction")).alias("mc_id"), "concept"))


@_rule("targets_concept", "SELECT DISTINCT rf.course, rf.lo AS source, dm.concept AS target, 1.0::DOUBLE AS confidence FROM rf JOIN dm ON dm.id = rf.id AND dm.course = rf.course JOIN lo ON lo.course = rf.course AND lo.lo = rf.lo")
def _(p):
    t = p.refs.join(p.order, ["course", "lo"]).join(p.mentions, ["course", "id"])
    return G.targets_concept(t.select("course", "lo", "pos", "concept"), p.nodes)


def _slug(c: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', '-', 'g'), '-'), '-+', '-', 'g'), '-')"


_ISA = "kt AS (SELECT course, term AS source, definition FROM (SELECT source.course_id AS course, " + _slug("k.term") + " AS term, k.definition AS definition FROM (SELECT source, unnest(key_terms) AS k FROM one)) WHERE term <> '' AND definition IS NOT NULL AND (course, term) IN (SELECT course, concept FROM nd)), "
_ISA += "ph AS (SELECT course, source, unnest([" + ", ".join(f"struct_pack(p := {i}, phrase := " + _slug(f"regexp_extract(definition, '{p}', 1)") + ")" for i, p in enumerate(G.IS_A)) + "]) AS x FROM kt), "
_ISA += "rn AS (SELECT DISTINCT course, source, x.p AS p, unnest(flatten([[array_to_string(list_slice(w, i, i + n - 1), '-') FOR n IN range(1, least(6, len(w) - i + 1) + 1)] FOR i IN range(1, len(w) + 1)])) AS concept FROM (SELECT course, source, x, string_split(x.phrase, '-') AS w FROM ph WHERE x.phrase <> '')), "
_ISA += "isa AS (SELECT DISTINCT course, source, concept AS target FROM (SELECT rn.*, min(p) OVER (PARTITION BY course, source) AS first FROM rn JOIN nd USING (course, concept) WHERE concept <> source AND concept NOT IN (" + ", ".join(f"'{w}'" for w in G.EMPTY_NAMES) + ")) WHERE p = first)"


@query("rule_is_a", f"{_G}, {_ISA} SELECT course, source, target, 'is-a' AS type, 0.8::DOUBLE AS confidence FROM isa")
def _(spark, d):
    p = Parts(spark, d)
    return G.is_a(_terms(p), p.nodes)


def _terms(p):
    return p.chunks.select(F.col("source.course_id").alias("course"), F.explode("key_terms").alias("k")).select("course", "k.term", "k.definition")


_NINE = [  # type, rows, confidence, rank: in the order in which ties are decided
    ("is-a", "SELECT course, source, target FROM isa", "0.8", 3), ("prerequisite", "SELECT course, source, target FROM pre", "0.6", 2),
    ("assesses", "SELECT DISTINCT course, id, lo FROM rf JOIN one USING (id) WHERE chunk_type = 'assessment_item'", "1.0", 2),
    ("exemplifies", "SELECT DISTINCT course, id, concept FROM dm JOIN one USING (id) WHERE coalesce(content_type_label, chunk_type) = 'example'", "0.8", 2),
    ("misconception-of", _MC.replace(", 1.0::DOUBLE AS confidence", ""), "1.0", 2), ("derived-from-objective", "SELECT DISTINCT course, id, lo FROM rf", "1.0", 2), ("defined-by", "SELECT course, concept, first_chunk FROM nd", "0.7", 2),
    ("targets-concept", "SELECT DISTINCT rf.course, rf.lo, dm.concept FROM rf JOIN dm ON dm.id = rf.id AND dm.course = rf.course JOIN lo ON lo.course = rf.course AND lo.lo = rf.lo", "1.0", 2),
]


@query(
    "semantic_graph",
    f"{_G}, {_ISA}, al(course, source, target, type, confidence, r, n) AS (" + " UNION ALL ".join(f"SELECT *, '{t}', {c}::DOUBLE, {r}, {i} FROM ({q})" for i, (t, q, c, r) in enumerate(_NINE)) + " UNION ALL SELECT course, source, target, 'related-to', confidence, 1, 9 FROM rel), "
    + "b AS (SELECT *, max(r) OVER (PARTITION BY course, least(source, target), greatest(source, target)) AS top FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY course, source, target ORDER BY r DESC, n) = 1)) "
    + "SELECT course, source, target, type, round(confidence, 6) AS confidence, CASE type " + " ".join(f"WHEN '{t}' THEN '{r}'" for t, r in G.RULES.items()) + " END AS rule FROM b WHERE type <> 'related-to' OR top = 1",
)
def _(spark, d):
    """All nine rules in one graph."""
    p = Parts(spark, d)
    targets = p.refs.join(p.order, ["course", "lo"]).join(p.mentions, ["course", "id"]).select("course", "lo", "pos", "concept")
    m = p.chunks.select(F.col("source.course_id").alias("course"), F.explode("misconceptions").alias("x"), F.get("concept_tags", F.lit(0)).alias("concept")).where("x.misconception is not null")
    wrong = m.select("course", ids.misconception_id(F.col("x.misconception"), F.col("x.correction")).alias("mc_id"), "concept")
    rules = [
        G.is_a(_terms(p), p.nodes), G.prerequisite(p.mentions, p.edges, p.refs, p.order), G.assesses(p.chunks, p.refs), G.exemplifies(p.chunks, p.mentions, p.nodes), G.misconception_of(wrong),
        G.derived_from_objective(p.refs), G.defined_by(p.nodes), G.targets_concept(targets, p.nodes), G.related_to(p.edges),
    ]
    return G.by_precedence(rules).withColumn("confidence", F.round("confidence", 6))


@query("cross_course_concepts", f"{_G} SELECT concept, count(DISTINCT course) AS total_courses, string_agg(DISTINCT course, ',' ORDER BY course) AS courses FROM m GROUP BY concept HAVING count(DISTINCT course) > 1")
def _(spark, d):
    index = G.cross_course(Parts(spark, d).mentions).where("total_courses > 1")
    return index.select("concept", "total_courses", F.array_join("courses", ",").alias("courses"))


@query("shared_edges", f"{_G}, sh AS (SELECT concept FROM m GROUP BY concept HAVING count(DISTINCT course) > 1) SELECT course, source, target, weight FROM ed WHERE source IN (SELECT concept FROM sh) AND target IN (SELECT concept FROM sh)")
def _(spark, d):
    p = Parts(spark, d)
    return G.shared_edges(p.edges, G.cross_course(p.mentions)).select("course", "source", "target", "weight")


@query("tfidf_centrality", f"{_G}, f AS (SELECT course, concept, count(*) AS frequency, count(DISTINCT id) AS df FROM m GROUP BY ALL), n AS (SELECT course, count(DISTINCT id) AS n FROM m GROUP BY ALL), r AS (SELECT *, frequency * (ln(n / (df + 1)) + 1) AS raw FROM f JOIN n USING (course)) SELECT course, concept, frequency, df, round(frequency / max(frequency) OVER (PARTITION BY course), 6) AS frequency_score, round(raw / max(raw) OVER (PARTITION BY course), 6) AS tfidf_score FROM r")
def _(spark, d):
    c = G.tfidf_centrality(Parts(spark, d).mentions)
    return c.withColumn("frequency_score", F.round("frequency_score", 6)).withColumn("tfidf_score", F.round("tfidf_score", 6))


@query("graph_statistics", f"{_G}, c AS (SELECT course, count(*) AS nodes, avg(frequency) AS f FROM nd GROUP BY course), e AS (SELECT course, count(*) AS edges, avg(weight) AS w FROM ed GROUP BY course) SELECT course, nodes, coalesce(edges, 0) AS edges, round(f, 6) AS mean_frequency, round(w, 6) AS mean_weight, round(2 * coalesce(edges, 0) / nodes, 6) AS mean_degree FROM c LEFT JOIN e USING (course)")
def _(spark, d):
    p = Parts(spark, d)
    n = p.nodes.groupBy("course").agg(F.count("*").alias("nodes"), F.round(F.avg("frequency"), 6).alias("mean_frequency"))
    e = p.edges.groupBy("course").agg(F.count("*").alias("edges"), F.round(F.avg("weight"), 6).alias("mean_weight"))
    j = n.join(e, "course", "left").withColumn("edges", F.coalesce("edges", F.lit(0)))
    return j.withColumn("mean_degree", F.round(2 * F.col("edges") / F.col("nodes"), 6))


@query("concept_importance")
def _(spark, d):
    from pyspark.sql import Window

    p = Parts(spark, d)
    pr = G.pagerank(p.nodes, p.edges)
    pr = pr.select("course", "concept", (F.col("rank") / F.max("rank").over(Window.partitionBy("course"))).alias("pagerank_score"))
    bt = G.betweenness(p.nodes, p.edges).withColumnRenamed("score", "betweenness_score")
    rows = G.tfidf_centrality(p.mentions).join(pr, ["course", "concept"]).join(bt, ["course", "concept"])
    return G.importance(rows).select("course", "concept", F.round("composite", 6).alias("composite"), "position", "band")
