"""Queries of ranking, fusion and retrieval measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import scoring, text as T
from loomspark.operators import decompose, retrieval as R
from loomspark.plans.registry import ONCE, query
from loomspark.tables import once_per_id, spread, table

QUESTION = "retrieval practice and working memory"
QUERIES = [(1, QUESTION), (2, "sunk cost of the market share"), (3, "how does the routing table read the packet header")]
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _toks(c: str) -> str:
    return f"[t FOR t IN regexp_extract_all(lower(coalesce({c}, '')), '{T.TOKEN_RE}') IF length(t) > 1 AND t NOT IN ({_STOP})]"


def _bm25_sql(docs: str, queries: list[tuple[int, str]]) -> str:
    rows = ", ".join(f"({i}, '{q}')" for i, q in queries)
    return f"""d AS ({docs}), tk AS (SELECT id, {_toks('text')} AS w FROM d), st AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM tk),
po AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(w) AS dl, unnest(w) AS term FROM tk) GROUP BY ALL),
qt AS (SELECT query_id, term, count(*) AS mult FROM (SELECT query_id, unnest({_toks('query')}) AS term FROM (VALUES {rows}) v(query_id, query)) GROUP BY ALL),
dfq AS (SELECT term, count(*) AS df FROM po GROUP BY term),
sc AS (SELECT query_id, id, sum(mult * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN po USING (term) JOIN dfq USING (term), st GROUP BY ALL)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"


def _docs(spark, d):
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("bm25_top10", f"WITH {_bm25_sql(_DOCS, QUERIES)} SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM sc QUALIFY rank <= 10")
def _(spark, d):
    scores = R.bm25(_docs(spark, d), R.query_terms(spark, QUERIES))
    return R.top_k(scores, 10).withColumn("score", F.round("score", 6))


def _blend_sql() -> str:
    tri = "list_distinct(flatten([[substr(w, i::INT, 3) FOR i IN range(1, length(w) - 1)] FOR w IN regexp_split_to_array(regexp_replace(lower({0}), '[^a-z0-9 ]', '', 'g'), ' +') IF length(w) >= 3]))"
    return f"""WITH {_bm25_sql(_DOCS, QUERIES[:1])}, g AS (SELECT id, {tri.format('left(text, 500)')} AS g, {tri.format(f"'{QUESTION}'")} AS q FROM d)
SELECT id, round(0.85 * score + 0.15 * score * len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))), 6) AS score FROM sc JOIN g USING (id) ORDER BY 0.85 * score + 0.15 * score * len(list_intersect(g, q)) / len(list_distinct(list_concat(g, q))) DESC, id LIMIT 20"""


@query("bm25_with_trigrams", _blend_sql())
def _(spark, d):
    docs = _docs(spark, d)
    scores = R.blend_trigrams(R.bm25(docs, R.query_terms(spark, QUERIES[:1])), docs, QUESTION)
    return R.top_k(scores, 20).select("id", F.round("score", 6).alias("score"))


_CHUNKS = f"WITH {ONCE}, {_bm25_sql('SELECT id, text FROM one', QUERIES[:1])}"
_CONCEPTS = ["retrieval-practice", "working-memory"]


@query(
    "boosted_ranking",
    f"""{_CHUNKS}, b AS (SELECT id, score, list_distinct([lower(t) FOR t IN coalesce(concept_tags, []) IF t IS NOT NULL]) AS tags, [lower(r) FOR r IN learning_outcome_refs] AS refs FROM sc JOIN one USING (id)),
p AS (SELECT id, score, len(list_intersect(tags, ['retrieval-practice', 'working-memory'])) / len(list_distinct(list_concat(tags, ['retrieval-practice', 'working-memory']))) AS overlap, CASE WHEN list_has_any(refs, ['co-01', 'to-01']) THEN 1.0::DOUBLE ELSE 0.0 END AS lo FROM b),
f AS (SELECT id, score AS bm25, overlap, lo, greatest(0, score * (1 + greatest(-0.5, least(0.5, 0.3 * overlap + 0.3 * lo)))) AS final FROM p)
SELECT id, round(bm25, 6) AS bm25, round(overlap, 6) AS concept_overlap, lo AS outcome_match, round(final, 6) AS score, row_number() OVER (ORDER BY final DESC, id)::INT AS rank FROM f WHERE final >= 0.5 QUALIFY rank <= 50""",
)
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "text", "concept_tags", "learning_outcome_refs"))
    scores = R.bm25(one, R.query_terms(spark, QUERIES[:1]))
    rows = scores.join(one.select("id", R.concept_overlap(F.col("concept_tags"), _CONCEPTS).alias("concept_overlap"), R.outcome_match(F.col("learning_outcome_refs"), ["co-01", "to-01"]).alias("outcome_match")), "id")
    final = scoring.combine_boosts(F.col("score"), {"concepts": (F.col("concept_overlap"), 0.3), "outcomes": (F.col("outcome_match"), 0.3)})
    rows = R.top_k(rows.select("query_id", "id", F.col("score").alias("bm25"), "concept_overlap", "outcome_match", final.alias("score")), 50, floor=0.5)
    return rows.select("id", F.round("bm25", 6).alias("bm25"), F.round("concept_overlap", 6).alias("concept_overlap"), "outcome_match", F.round("score", 6).alias("score"), "rank")


_SUB = decompose.decompose("Compare retrieval practice and worked example")


def _fused_sql() -> str:
    total = sum(w for *_, w in _SUB)
    cases = " ".join(f"WHEN {i} THEN {w / total!r}" for i, _, _, w in _SUB)
    return f"""WITH {ONCE}, {_bm25_sql('SELECT id, text FROM one', [(i, q) for i, q, _, _ in _SUB])},
rk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sc QUALIFY rank <= 20),
fu AS (SELECT id, sum((CASE query_id {cases} END) / (60 + rank)) AS fused, count(*) AS n_lists FROM rk GROUP BY id)"""


@query("multi_query_fusion", f"{_fused_sql()} SELECT id, round(fused, 9) AS fused, n_lists FROM fu")
def _(spark, d):
    return _fused(spark, d).select("id", F.round("fused", 9).alias("fused"), "n_lists")


def _fused(spark, d):
    one = once_per_id(spread(table(spark, d, "chunks").select("id", "text")))
    scores = R.bm25(one, R.query_terms(spark, [(i, q) for i, q, _, _ in _SUB])).withColumn("score", F.round("score", 9))
    return R.fuse(R.top_k(scores, 20), {i: w for i, _, _, w in _SUB})


@query("intent_coverage", f"{_fused_sql()} SELECT aspect, count(rk.id) AS n_results FROM (VALUES " + ", ".join(f"({i}, '{a}')" for i, _, a, _ in _SUB) + ") v(query_id, aspect) LEFT JOIN rk USING (query_id) GROUP BY aspect")
def _(spark, d):
    one = once_per_id(spread(table(spark, d, "chunks").select("id", "text")))
    ranked = R.top_k(R.bm25(one, R.query_terms(spark, [(i, q) for i, q, _, _ in _SUB])), 20)
    aspects = spark.createDataFrame([(i, a) for i, _, a, _ in _SUB], "query_id int, aspect string")
    return aspects.join(ranked, "query_id", "left").groupBy("aspect").agg(F.count("id").alias("n_results"))


@query(
    "result_coherence",
    f"""{_fused_sql()}, r AS (SELECT id, source.course_id AS domain, list_distinct(coalesce(concept_tags, [])) AS tags, n_lists FROM fu JOIN one USING (id)),
p AS (SELECT avg(CASE WHEN len(list_distinct(list_concat(a.tags, b.tags))) = 0 THEN 0 ELSE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) END) AS s FROM r a JOIN r b ON a.id < b.id)
SELECT round((SELECT max(c) / sum(c) FROM (SELECT count(*) AS c FROM r GROUP BY domain)), 6) AS largest_domain, round(s, 6) AS tag_similarity, round((SELECT avg((n_lists > 1)::INT) FROM r), 6) AS several_queries FROM p""",
)
def _(spark, d):
    chunks = once_per_id(table(spark, d, "chunks").select("id", F.col("source.course_id").alias("domain"), "concept_tags"))
    tags = F.filter(F.array_distinct(F.coalesce("concept_tags", F.array().cast("array<string>"))), lambda t: t.isNotNull())
    rows = _fused(spark, d).join(chunks, "id").select("id", "domain", tags.alias("tags"), "n_lists")
    return R.coherence(rows).select(*[F.round(c, 6).alias(c) for c in ("largest_domain", "tag_similarity", "several_queries")])


@query("distinct_results")
def _(spark, d):
    text = once_per_id(spread(table(spark, d, "chunks").select("id", "text")))
    rows = _fused(spark, d).join(text, "id").select("id", F.col("fused").alias("score"), "text")
    return R.greedy_distinct(rows).select("id", "score")


_OQ = """o AS (SELECT course_code, unnest(learning_outcomes) AS o FROM courses), q AS (SELECT row_number() OVER (ORDER BY course_code, o.id)::INT AS query_id, course_code, lower(o.id) AS lo, o.statement AS query FROM o WHERE o.id IS NOT NULL),
rl AS (SELECT DISTINCT query_id, one.id FROM q JOIN (SELECT id, source.course_id AS c, unnest(learning_outcome_refs) AS r FROM one) one ON one.c = q.course_code AND lower(one.r) = q.lo)"""


def _indexed_sql(docs: str, fold: bool = False) -> str:
    """Scores of all outcomes' statements, each within the index (course, variant) that `docs` (ix, course, id, text) names."""
    return f"""d AS ({docs}), tk AS (SELECT ix, course, id, {_toks('text')} AS w FROM d), st AS (SELECT ix, course, count(*) AS n_docs, avg(len(w)) AS avgdl FROM tk GROUP BY ALL),
po AS (SELECT ix, course, id, dl, term, count(*) AS tf FROM (SELECT ix, course, id, len(w) AS dl, unnest(w) AS term FROM tk) GROUP BY ALL),
qt AS (SELECT course_code AS course, query_id, term, count(*) AS mult FROM (SELECT course_code, query_id, unnest({_toks('query')}) AS term FROM q) GROUP BY ALL), dfq AS (SELECT ix, course, term, count(*) AS df FROM po GROUP BY ALL),
sc AS (SELECT ix, query_id, id, sum(mult * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM qt JOIN po USING (course, term) JOIN dfq USING (ix, course, term) JOIN st USING (ix, course) GROUP BY ALL),
rk AS (SELECT ix, query_id, id, row_number() OVER (PARTITION BY ix, query_id ORDER BY round(score, 6) DESC, id) AS rank FROM sc QUALIFY rank <= 10)"""


def _outcome_questions(spark, d, one):
    """(course, query_id, lo, query) of every outcome, and (query_id, id) of the chunks of its course that refer to it."""
    o = table(spark, d, "courses").select("course_code", F.explode("learning_outcomes").alias("o")).where("o.id is not null")
    q = o.select(F.col("course_code").alias("course"), F.xxhash64("course_code", "o.id", "o.statement").alias("query_id"), F.lower("o.id").alias("lo"), F.col("o.statement").alias("query"))
    refs = one.select("id", "course", F.explode("learning_outcome_refs").alias("r")).select("id", "course", F.lower("r").alias("lo"))
    return q, q.join(refs, ["course", "lo"]).select("query_id", "id").distinct()


_METRICS = ["recall_at_1", "recall_at_5", "recall_at_10", "hit_at_10", "mrr", "mean_precision_at_10"]


def _outcome_metrics(spark, d):
    """Every outcome's statement asked of its own course's chunks, an index for each course."""
    one = once_per_id(spread(table(spark, d, "chunks").select("id", "text", "source", "learning_outcome_refs"))).withColumn("course", F.col("source.course_id"))
    q, relevant = _outcome_questions(spark, d, one)
    terms = q.select("course", "query_id", F.explode(T.tokenize(F.coalesce("query", F.lit("")))).alias("term")).groupBy("course", "query_id", "term").agg(F.count("*").alias("mult"))
    scores = R.bm25(one.select("course", "id", "text"), terms, within=("course",)).withColumn("score", F.round("score", 6))
    m = R.metrics(R.top_k(scores, 10), relevant)
    mean = lambda c, n: F.avg(c).alias(n)
    return m.agg(F.count("*").alias("queries"), *[mean(c, n) for c, n in zip(["recall_at_1", "recall_at_5", "recall_at_10", "hit_at_10", "reciprocal_rank", "precision_at_10"], _METRICS)])


_OM = f"""WITH {ONCE}, {_OQ}, {_indexed_sql("SELECT 0 AS ix, source.course_id AS course, id, text FROM one")},
pq AS (SELECT n.query_id, n.c AS n_relevant, least(10, coalesce(g.c, 0)) AS got, min(rank) AS first, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM (SELECT query_id, count(*) AS c FROM rl GROUP BY ALL) n LEFT JOIN (SELECT query_id, count(*) AS c FROM rk GROUP BY ALL) g USING (query_id) LEFT JOIN (SELECT * FROM rk JOIN rl USING (query_id, id)) h ON h.query_id = n.query_id GROUP BY ALL),
om AS (SELECT count(*) AS queries, avg(h1 / n_relevant) AS recall_at_1, avg(h5 / n_relevant) AS recall_at_5, avg(h10 / n_relevant) AS recall_at_10, avg((h10 > 0)::INT) AS hit_at_10, avg(coalesce(1 / first, 0)) AS mrr, avg(CASE WHEN got > 0 THEN h10 / got ELSE 0 END) AS mean_precision_at_10 FROM pq)"""


@query("outcome_retrieval_metrics", f"{_OM} SELECT queries, " + ", ".join(f"round({m}, 4) AS {m}" for m in _METRICS) + " FROM om")
def _(spark, d):
    return _outcome_metrics(spark, d).select("queries", *[F.round(m, 4).alias(m) for m in _METRICS])


_FIRST = r"(?s)^[^.!?]*[.!?]?"


@query(
    "recall_of_text_variants",
    f"""WITH {ONCE}, {_OQ}, ch AS (SELECT id, source.course_id AS course, coalesce(text, '') AS text, regexp_extract(coalesce(text, ''), '{_FIRST}', 0) AS summary, array_to_string([x FOR x IN flatten([[k.term, k.definition] FOR k IN coalesce(key_terms, [])]) IF x IS NOT NULL AND x <> ''], ' ') AS kt FROM one),
{_indexed_sql("SELECT 'text' AS ix, course, id, text FROM ch UNION ALL SELECT 'summary', course, id, summary FROM ch UNION ALL SELECT 'retrieval_text', course, id, summary || ' ' || kt FROM ch")},
v(ix) AS (VALUES ('text'), ('summary'), ('retrieval_text')), n AS (SELECT ix, query_id, c FROM (SELECT query_id, count(*) AS c FROM rl GROUP BY ALL), v),
h AS (SELECT ix, query_id, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS h10 FROM rk JOIN rl USING (query_id, id) GROUP BY ALL)
SELECT ix AS variant, count(*) AS queries, round(avg(coalesce(h1, 0) / c), 4) AS recall_at_1, round(avg(coalesce(h5, 0) / c), 4) AS recall_at_5, round(avg(coalesce(h10, 0) / c), 4) AS recall_at_10 FROM n LEFT JOIN h USING (ix, query_id) GROUP BY ix""",
)
def _(spark, d):
    """The driver's chunks have no summary: their first sentence stands for it."""
    one = once_per_id(spread(table(spark, d, "chunks").select("id", "text", "source", "learning_outcome_refs", "key_terms"))).withColumn("course", F.col("source.course_id"))
    q, relevant = _outcome_questions(spark, d, one)
    own = one.select("course", "id", "text", F.regexp_extract(F.coalesce("text", F.lit("")), _FIRST, 0).alias("summary"), "key_terms")
    got = R.recall_benchmark(R.text_variants(own), q, relevant)
    return got.select("variant", "queries", *[F.round(c, 4).alias(c) for c in ("recall_at_1", "recall_at_5", "recall_at_10")])


@query("report_difference", f"{_OM}, bf(m, b) AS (VALUES ('mrr', 0.9), ('recall_at_5', 0.01)), af AS (SELECT 'mrr' AS m, mrr AS a FROM om UNION ALL SELECT 'recall_at_5', recall_at_5 FROM om) SELECT m AS metric, b::DOUBLE AS before, round(a, 4) AS after, a - b < -0.05 AND m = 'mrr' AS regression FROM bf JOIN af USING (m)")
def _(spark, d):
    """The report of all outcomes against an earlier one."""
    before = spark.createDataFrame([(0.9, 0.01)], "mrr double, recall_at_5 double")
    got = R.report_difference(before, _outcome_metrics(spark, d), ["mrr", "recall_at_5"], {"mrr": 0.05, "hit_at_10": 0.05})
    return got.select("metric", "before", F.round("after", 4).alias("after"), "regression")


_SLUG = "trim(regexp_replace(lower(t), '[ \\t\\n\\r\\x{A0}_\\-\\x{2010}-\\x{2013}]+', '-', 'g'), '-')"
_QC = f"""nodes AS (SELECT DISTINCT {_SLUG} AS concept FROM (SELECT unnest(concept_tags) AS t FROM one) WHERE t IS NOT NULL),
wq AS (SELECT query_id, course_code, lower(query) AS low, regexp_extract_all(lower(query), '[a-z0-9]+') AS w FROM q WHERE query IS NOT NULL),
qc AS (SELECT DISTINCT query_id, course_code, concept FROM (SELECT query_id, course_code, unnest(list_concat(list_concat(w, regexp_extract_all(low, '[a-z0-9]+(?:-[a-z0-9]+)+')), [w[i] || '-' || w[i + 1] FOR i IN range(1, len(w))])) AS concept FROM wq) WHERE concept IN (SELECT concept FROM nodes WHERE concept <> ''))"""


def _nodes(one):
    return one.select(F.explode("concept_tags").alias("t")).select(T.slug_item(F.col("t")).alias("concept")).where("concept <> ''").distinct()


@query("concepts_of_questions", f"WITH {ONCE}, {_OQ}, {_QC} SELECT q.course_code AS course, q.lo, qc.concept FROM qc JOIN q USING (query_id)")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "concept_tags", "source", "learning_outcome_refs")).withColumn("course", F.col("source.course_id"))
    q, _ = _outcome_questions(spark, d, one)
    return R.concepts_of_queries(q, _nodes(one)).join(q, "query_id").select("course", "lo", "concept")


_TAGS_SQL = "['retrieval-practice', 'working-memory', 'learning-outcome']"
_TAGS = ["retrieval-practice", "working-memory", "learning-outcome"]


@query("targets_boost", f"""WITH {ONCE}, rf AS (SELECT DISTINCT id, lower(r) AS lo FROM (SELECT id, unnest(learning_outcome_refs) AS r FROM one) WHERE r IS NOT NULL),
ta AS (SELECT DISTINCT lower(r) AS lo, {_SLUG} AS concept, lower(bloom_level) AS b FROM (SELECT r, bloom_level, unnest(concept_tags) AS t FROM (SELECT unnest(learning_outcome_refs) AS r, bloom_level, concept_tags FROM one WHERE chunk_type = 'overview')) WHERE r IS NOT NULL AND t IS NOT NULL),
own AS (SELECT id, concept, max(coalesce(b = 'apply', false)) AS fits FROM rf JOIN ta USING (lo) GROUP BY ALL), n AS (SELECT id, count(*) AS n FROM own GROUP BY id), hit AS (SELECT id, count(*) AS k, max(fits) AS fits FROM own WHERE concept IN (SELECT unnest({_TAGS_SQL})) GROUP BY id)
SELECT id, round(CASE WHEN fits THEN least(1.0, k / (n + 3 - k) * 1.2) ELSE k / (n + 3 - k) END, 6) AS boost FROM hit JOIN n USING (id)""")
def _(spark, d):
    """Outcomes target the concepts of the overviews that refer to them, at those overviews' level."""
    one = once_per_id(table(spark, d, "chunks").select("id", "concept_tags", "chunk_type", "bloom_level", "learning_outcome_refs"))
    o = one.where("chunk_type = 'overview'").select(F.explode("learning_outcome_refs").alias("source"), "concept_tags", "bloom_level").select("source", F.explode("concept_tags").alias("t"), "bloom_level")
    edges = o.select("source", T.slug_item(F.col("t")).alias("target"), "bloom_level").where("source is not null and target is not null")
    concepts = spark.createDataFrame([(1, c) for c in _TAGS], "query_id int, concept string")
    return R.targets_boost(one, edges, concepts, "apply").select("id", F.round("boost", 6).alias("boost"))


_ASKED = "How does co-01 build on retrieval practice and working memory"


@query("statement_boost", f"""WITH {ONCE}, oc AS (SELECT course_code, learning_outcomes AS os FROM courses), w AS (SELECT list_distinct(regexp_extract_all(lower('{_ASKED}'), '[a-z0-9]+')) AS w),
r AS (SELECT one.id, [lower(x) FOR x IN coalesce(learning_outcome_refs, []) IF x IS NOT NULL] AS own, os, w FROM one LEFT JOIN oc ON course_code = source.course_id, w)
SELECT id, CASE WHEN list_contains(own, 'co-01') THEN 1.0::DOUBLE WHEN len([o FOR o IN coalesce(os, []) IF list_contains(own, lower(o.id)) AND len(list_intersect(list_distinct(regexp_extract_all(lower(o.statement), '[a-z0-9]+')), w)) / len(list_distinct(list_concat(regexp_extract_all(lower(o.statement), '[a-z0-9]+'), w))) >= 0.15]) > 0 THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END AS boost FROM r""")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "source", "learning_outcome_refs"))
    c = table(spark, d, "courses").select(F.col("course_code").alias("_c"), F.transform("learning_outcomes", lambda o: F.struct(o["id"].alias("id"), o["statement"].alias("statement"))).alias("outcomes"))
    return one.join(c, F.col("source.course_id") == F.col("_c"), "left").select("id", R.statement_boost(F.col("learning_outcome_refs"), _ASKED, F.col("outcomes"), threshold=0.15).cast("double").alias("boost"))


@query("match_rationale", f"""WITH {ONCE} SELECT id, array_to_string([r FOR r IN coalesce(learning_outcome_refs, []) IF lower(r) = 'co-01'], ' ') AS refs, array_to_string(list_sort(list_distinct([k.term FOR k IN coalesce(key_terms, []) IF k.term IS NOT NULL AND trim(k.term, ' ') <> '' AND contains(lower('{_ASKED}'), lower(trim(k.term, ' ')))])), '|') AS terms FROM one""")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "learning_outcome_refs", F.col("key_terms.term").alias("terms")))
    m = one.select("id", R.rationale(F.col("learning_outcome_refs"), F.col("terms"), _ASKED).alias("m"))
    return m.select("id", F.array_join("m.refs", " ").alias("refs"), F.array_join(F.array_sort("m.terms"), "|").alias("terms"))


_OBJ = "Students will be able to explain how working memory limits retrieval practice"


@query(
    "objective_retrieval",
    f"""WITH {ONCE}, {_bm25_sql("SELECT id, text FROM one", [(1, "working memory limits retrieval practice")])}, t AS (SELECT sc.id, score, CASE WHEN chunk_type IN ('explanation', 'example') THEN 1 WHEN chunk_type IN ('overview', 'summary') THEN 2 END AS arm FROM sc JOIN one USING (id)),
k AS (SELECT id, arm, round(score, 6) AS score FROM t WHERE arm IS NOT NULL QUALIFY row_number() OVER (PARTITION BY arm ORDER BY score DESC, id) <= 10) SELECT id, arm::INT AS arm, score, row_number() OVER (ORDER BY arm, score DESC, id)::INT AS position FROM k QUALIFY position <= 10""",
)
def _(spark, d):
    """The objective without its preamble, asked of the level's own kinds of chunk first, then of the second ones."""
    one = once_per_id(table(spark, d, "chunks").select("id", "text", "chunk_type"))
    return R.retrieve_for_objective(one, decompose.objective_concepts(_OBJ), "understand", 10).withColumn("score", F.round("score", 6))


@query("filtered_chunks", f"WITH {ONCE} SELECT id FROM one WHERE difficulty = 'foundational' AND list_has_any(learning_outcome_refs, ['co-01', 'to-01']) AND coalesce(tokens_estimate, 0) >= 100 AND coalesce(tokens_estimate, 0) <= 600")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").drop("text"))
    return one.where(R.chunk_filter(difficulty="foundational", outcome_refs=["co-01", "to-01"], min_tokens=100, max_tokens=600)).select("id")


@query("round_robin_scan", f"WITH {ONCE}, n AS (SELECT id, source.course_id AS c, row_number() OVER (PARTITION BY source.course_id ORDER BY id) AS turn FROM one) SELECT id, turn::INT AS turn FROM n WHERE turn <= 5 ORDER BY turn, c LIMIT 100")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "source"))
    return R.round_robin(one, F.col("source.course_id"), ["id"], 100, 5).select("id", "turn")


@query("prerequisite_cover", f"WITH {ONCE} SELECT id, CASE WHEN coalesce(len(concept_tags), 0) = 0 THEN 0.0::DOUBLE WHEN list_has_any(concept_tags, ['final-exam']) THEN -0.5 WHEN len([t FOR t IN concept_tags IF t IS NULL OR t NOT IN ('working-memory', 'assessment', 'practice-set', 'learning-outcome')]) = 0 THEN 0.7 ELSE 0.0 END AS boost FROM one")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "concept_tags"))
    tags = F.transform("concept_tags", lambda t: F.coalesce(t, F.lit("?")))
    return one.select("id", R.prerequisite_cover(tags, T.strings(["working-memory", "assessment", "practice-set", "learning-outcome"]), T.strings(["final-exam"])).cast("double").alias("boost"))
