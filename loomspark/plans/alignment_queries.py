"""Queries of chunks against outcomes, weeks and sources, and of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import ids, text as T
from loomspark.operators import alignment as L, events as E, graph as G, roles as O, runs as U
from loomspark.plans.graph_queries import _G, Parts
from loomspark.plans.registry import ONCE, query
from loomspark.tables import once_per_id, table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _one(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


# The driver's outcomes name no weeks: an outcome's place in its course's list is its first week, and it goes on for two more.
_OW = "ow AS (SELECT DISTINCT course_code AS course, lower(x.id) AS lo, pos::INT AS week_lo, (pos + 2)::INT AS week_hi, x.statement AS statement FROM (SELECT course_code, unnest(learning_outcomes) AS x, generate_subscripts(learning_outcomes, 1) AS pos FROM courses) WHERE x.id IS NOT NULL)"
_WEEK = "nullif(regexp_extract(source.module_id, '(?i)(?:week[_\\-\\s]?|_w)(\\d+)', 1), '')::INT"


def _outcomes(spark, d):
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.posexplode("learning_outcomes").alias("pos", "x")).where("x.id is not null")
    return o.select("course", F.lower("x.id").alias("lo"), (F.col("pos") + 1).alias("week_lo"), (F.col("pos") + 3).alias("week_hi"), F.col("x.statement").alias("statement")).distinct()


def _week(c: str = "source.module_id"):
    return F.nullif(F.regexp_extract(c, r"(?i)(?:week[_\-\s]?|_w)(\d+)", 1), F.lit("")).cast("int")


def _tk(c: str) -> str:
    return f"[t FOR t IN regexp_extract_all(lower(coalesce({c}, '')), '{T.TOKEN_RE}') IF length(t) > 1 AND t NOT IN ({_STOP})]"


@query("outcomes_by_week", f"""WITH {ONCE}, {_OW}, ch AS (SELECT id, source.course_id AS course, {_WEEK} AS week, learning_outcome_refs AS refs, text FROM one), lt AS (SELECT DISTINCT course, id, lower(r) AS lo FROM (SELECT course, id, unnest(refs) AS r FROM ch) WHERE (course, lower(r)) IN (SELECT course, lo FROM ow)),
rs AS (SELECT * FROM ch WHERE id NOT IN (SELECT id FROM lt) AND week IS NOT NULL), w AS (SELECT course, unnest(generate_series(week_lo, week_hi)) AS week, lo, statement FROM ow),
n AS (SELECT course, week, count(*) AS n FROM w GROUP BY ALL), tf AS (SELECT course, week, lo, l, term, count(*) AS tf FROM (SELECT course, week, lo, len(k) AS l, unnest(k) AS term FROM (SELECT course, week, lo, {_tk('statement')} AS k FROM w)) GROUP BY ALL), idf AS (SELECT course, week, term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN n USING (course, week) GROUP BY course, week, term, n),
w2 AS (SELECT course, week, lo, term, tf / l * idf AS w2 FROM tf JOIN idf USING (course, week, term)), n2 AS (SELECT course, week, lo, sqrt(sum(w2 * w2)) AS n2 FROM w2 GROUP BY ALL),
tt AS (SELECT course, week, id, l, term, count(*) AS tf FROM (SELECT course, week, id, len(k) AS l, unnest(k) AS term FROM (SELECT course, week, id, {_tk('text')} AS k FROM rs)) GROUP BY ALL), w1 AS (SELECT course, week, id, term, tf / l * idf AS w1 FROM tt JOIN idf USING (course, week, term)), n1 AS (SELECT course, week, id, sqrt(sum(w1 * w1)) AS n1 FROM w1 GROUP BY ALL),
s AS (SELECT course, id, lo, round(sum(w1 * w2) / (n1 * n2), 9) AS s FROM w1 JOIN w2 USING (course, week, term) JOIN n1 USING (course, week, id) JOIN n2 USING (course, week, lo) GROUP BY course, week, id, lo, n1, n2),
si AS (SELECT course, id, lo FROM s WHERE s >= 0.15 QUALIFY row_number() OVER (PARTITION BY course, id ORDER BY s DESC, lo) <= 3), fi AS (SELECT course, week, min(lo) AS lo FROM w GROUP BY ALL)
SELECT course, id, lo, 'literal' AS how FROM lt UNION ALL SELECT course, id, lo, 'similar' FROM si UNION ALL SELECT rs.course, rs.id, fi.lo, 'first' FROM rs JOIN fi USING (course, week) WHERE rs.id NOT IN (SELECT id FROM si)""")
def _(spark, d):
    c = _one(spark, d, "source", "learning_outcome_refs", "text").select("id", F.col("source.course_id").alias("course"), _week().alias("week"), F.col("learning_outcome_refs").alias("refs"), "text")
    return L.match_by_week(c, _outcomes(spark, d))


@query("prerequisites_before", f"""{_G}, pl AS (SELECT DISTINCT m.course, m.id, m.concept, struct_pack(a := source.module_id, b := source.position_in_module, c := m.id) AS plc FROM m JOIN one USING (id) WHERE concept NOT IN ('initial-post', 'replies', 'due')), sn AS (SELECT course, concept, min(plc) AS seen FROM pl GROUP BY ALL),
bo AS (SELECT course, source, target, weight FROM ed UNION ALL SELECT course, target, source, weight FROM ed), rc AS (SELECT bo.course, bo.source AS concept, bo.target, weight / sqrt(frequency) AS score, seen FROM bo JOIN nd ON nd.course = bo.course AND nd.concept = bo.target JOIN sn ON sn.course = bo.course AND sn.concept = bo.target),
ca AS (SELECT pl.course, pl.id, rc.target AS concept, max(score) AS score FROM pl JOIN rc ON rc.course = pl.course AND rc.concept = pl.concept WHERE seen < plc GROUP BY ALL), cb AS (SELECT * FROM ca WHERE (id, concept) NOT IN (SELECT id, concept FROM pl)),
be AS (SELECT id, list(concept ORDER BY k) AS found FROM (SELECT id, concept, row_number() OVER (PARTITION BY course, id ORDER BY round(score, 9) DESC, concept) AS k FROM cb) WHERE k <= 5 GROUP BY id),
tg AS (SELECT id, list_sort(list(DISTINCT concept)) AS tags FROM pl GROUP BY id), rw AS (SELECT one.id, coalesce(tags, []) AS tags, lag(coalesce(tags, [])) OVER (PARTITION BY source.course_id, source.module_id ORDER BY source.position_in_module, one.id) AS before FROM one LEFT JOIN tg USING (id))
SELECT id, array_to_string(coalesce(found, ([t FOR t IN coalesce(before, []) IF NOT list_contains(tags, t)])[1:5]), '|') AS prereqs FROM rw LEFT JOIN be USING (id)""")
def _(spark, d):
    p = Parts(spark, d)
    c = p.chunks.select("id", F.col("source.course_id").alias("course"), F.col("source.module_id").alias("module"), F.col("source.position_in_module").alias("pos"))
    return L.prerequisites_before(c, p.mentions, p.nodes, p.edges).select("id", F.array_join("prereqs", "|").alias("prereqs"))


_REFS = "rf AS (SELECT DISTINCT source.course_id AS course, id, r AS ref FROM (SELECT id, source, unnest(learning_outcome_refs) AS r FROM one) WHERE r IS NOT NULL)"


def _refs(spark, d):
    return _one(spark, d, "source", "learning_outcome_refs").select("id", F.col("source.course_id").alias("course"), F.explode("learning_outcome_refs").alias("ref")).where("ref is not null")


@query("resolved_refs", f"WITH {ONCE}, {_OW}, {_REFS}, wr AS (SELECT course, id, ref FROM rf UNION SELECT course, id, 'W03-' || ref FROM rf), b AS (SELECT *, lower(ref) AS own, regexp_replace(lower(ref), '^w(?:eek)?[-_]?\\d+[-_]', '') AS bare FROM wr) SELECT id, ref, CASE WHEN (course, own) IN (SELECT course, lo FROM ow) THEN own WHEN (course, bare) IN (SELECT course, lo FROM ow) THEN bare END AS lo, CASE WHEN (course, own) IN (SELECT course, lo FROM ow) THEN 'direct' WHEN (course, bare) IN (SELECT course, lo FROM ow) THEN 'parent' ELSE 'orphan' END AS status FROM b")
def _(spark, d):
    """All references, and each once more under the name of a week."""
    r = _refs(spark, d)
    return L.resolve_refs(r.unionByName(r.withColumn("ref", F.concat(F.lit("W03-"), F.col("ref")))), _outcomes(spark, d))


_OUT = f"WITH {ONCE}, {_OW}, {_REFS}, pg AS (SELECT DISTINCT one.id, source.course_id AS course, {_WEEK} AS week, lower(ref) AS lo FROM rf JOIN one USING (id)), bad AS (SELECT id, lo FROM pg WHERE week IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ow WHERE ow.course = pg.course AND ow.lo = pg.lo AND pg.week BETWEEN week_lo AND week_hi))"


def _outside(spark, d):
    p = _one(spark, d, "source", "learning_outcome_refs").select("id", F.col("source.course_id").alias("course"), _week().alias("week"), F.explode("learning_outcome_refs").alias("lo")).where("lo is not null")
    return L.outside_week(p, _outcomes(spark, d))


@query("outcomes_outside_week", f"{_OUT} SELECT id, lo FROM bad")
def _(spark, d):
    return _outside(spark, d)


@query("weekly_gate", f"{_OUT} SELECT source.course_id AS course, count(*) AS total, count(*) FILTER (id NOT IN (SELECT id FROM bad)) AS passed, count(*) FILTER (id IN (SELECT id FROM bad)) AS failed, round(count(*) FILTER (id NOT IN (SELECT id FROM bad)) / count(*), 6) AS share FROM one GROUP BY 1")
def _(spark, d):
    bad = _outside(spark, d).select("id").distinct().withColumn("bad", F.lit(True))
    c = _one(spark, d, F.col("source.course_id").alias("course")).join(bad, "id", "left").select("course", F.col("bad").isNull().alias("ok"))
    return U.gate_summary(c, ["course"], "ok").withColumn("share", F.round("share", 6))


@query("valid_outcome_ids", "WITH b AS (SELECT DISTINCT course_code AS course, lower(x.id) AS lo FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses) WHERE x.id IS NOT NULL AND lower(x.hierarchy_level) IN ('terminal', 'chapter')) SELECT course, lo FROM b UNION SELECT course, 'w' || lpad(w::VARCHAR, 2, '0') || '-' || lo FROM b, range(1, 13) r(w)")
def _(spark, d):
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).where("x.id is not null")
    level = lambda n: o.where(F.lower("x.hierarchy_level") == n).select("course", F.col("x.id").alias("lo"))
    return L.valid_ids(level("terminal"), level("chapter"), 12)


_ROLE = "coalesce(CASE content_type_label " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.ROLE_OF.items()) + " END, CASE chunk_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.ROLE_OF.items()) + " END, 'elaborate')"


@query("alignment_metrics", f"WITH {ONCE}, {_OW}, {_REFS}, ok AS (SELECT DISTINCT id FROM rf WHERE (course, lower(ref)) IN (SELECT course, lo FROM ow)), c AS (SELECT source.course_id AS course, CASE WHEN {_ROLE} = 'elaborate' AND coalesce(source.position_in_module = 0, false) AND coalesce(content_type_label, chunk_type) = 'explanation' THEN 'introduce' ELSE {_ROLE} END AS role, id IN (SELECT id FROM ok) AS hit FROM one), g AS (SELECT course, count(*) AS chunks, avg(hit::INT) AS covered, avg((role IN ('introduce', 'reinforce', 'assess'))::INT) AS consistent FROM c GROUP BY course) SELECT course, chunks, round(covered, 6) AS covered, round(consistent, 6) AS consistent, round(0.6 * covered + 0.4 * consistent, 6) AS score FROM g")
def _(spark, d):
    c = _one(spark, d, "source", "learning_outcome_refs", "content_type_label", "chunk_type")
    c = c.select("id", F.col("source.course_id").alias("course"), F.col("learning_outcome_refs").alias("refs"), O.teaching_role(F.col("content_type_label"), F.col("chunk_type"), F.col("source.position_in_module") == 0).alias("role"))
    m = L.alignment_metrics(c, _outcomes(spark, d).select("course", "lo").distinct(), ["introduce", "reinforce", "assess"])
    return m.select("course", "chunks", *[F.round(x, 6).alias(x) for x in ("covered", "consistent", "score")])


@query("unresolved_sources", "SELECT doc_id, course_id FROM documents WHERE course_id IS NOT NULL AND course_id NOT IN (SELECT course_code FROM courses WHERE domain = 'education')")
def _(spark, d):
    """Documents that name a course outside one domain."""
    known = table(spark, d, "courses").where("domain = 'education'").select(F.col("course_code").alias("course_id"))
    return L.unresolved(table(spark, d, "documents").select("doc_id", "course_id").where("course_id is not null"), known, ["course_id"])


_WC = "len(regexp_extract_all(p, '[^ \\t\\n\\r\\x{A0}]+'))"


@query("grounded_paragraphs", f"WITH p AS (SELECT doc_id AS page, course_id, unnest(string_split(text, chr(10))) AS p FROM documents WHERE text IS NOT NULL) SELECT page, count(*) AS long, count(*) FILTER (coalesce(course_id IN (SELECT course_code FROM courses), false)) AS grounded, round(count(*) FILTER (coalesce(course_id IN (SELECT course_code FROM courses), false)) / count(*), 6) AS share FROM p WHERE {_WC} >= 30 GROUP BY page")
def _(spark, d):
    """Lines are the paragraphs; what a document names as its course is inherited by all of them."""
    p = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("page"), F.explode(F.split("text", "\n", -1)).alias("text"), F.lit(None).cast("array<string>").alias("sources"), F.when(F.col("course_id").isNotNull(), F.array("course_id")).alias("inherited"))
    return L.grounding(p, table(spark, d, "courses").select(F.col("course_code").alias("source"))).withColumn("share", F.round("share", 6))


_CW = lambda c: f"list_distinct([t FOR t IN regexp_extract_all(lower({c}), '[a-z]{{3,}}') IF t NOT IN ({_STOP})])"


@query("sources_of_pages", f"""WITH a AS (SELECT course_code AS course, course_code || '/' || lower(x.id) AS page, {_CW("x.statement")} AS w FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses) WHERE x.id IS NOT NULL AND x.statement IS NOT NULL), b AS (SELECT course_id AS course, doc_id AS block, {_CW("text")} AS w FROM documents WHERE text IS NOT NULL AND course_id IS NOT NULL),
k AS (SELECT page, block, count(*) AS k, any_value(na) AS na, any_value(nb) AS nb FROM (SELECT course, page, len(w) AS na, unnest(w) AS word FROM a) JOIN (SELECT course, block, len(w) AS nb, unnest(w) AS word FROM b) USING (course, word) GROUP BY ALL), j AS (SELECT page, block, round(k / (na + nb - k), 9) AS score FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, block) AS n, max(score) OVER (PARTITION BY page) AS top FROM j), p AS (SELECT *, (score >= greatest(0.15, top * 0.8) AND n <= 2) OR n = 1 AS pr FROM r)
SELECT page, block, 'primary' AS kind, score FROM p WHERE pr UNION ALL SELECT page, block, 'contributing', score FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, block) AS q FROM p WHERE NOT pr AND score >= 0.05) WHERE q <= 3""")
def _(spark, d):
    """Outcomes are the pages, documents the source blocks."""
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).where("x.id is not null and x.statement is not null")
    pages = o.select("course", F.concat_ws("/", "course", F.lower("x.id")).alias("page"), T.content_words(F.col("x.statement")).alias("words"))
    blocks = table(spark, d, "documents").where("text is not null and course_id is not null").select(F.col("course_id").alias("course"), F.col("doc_id").alias("block"), T.content_words(F.col("text")).alias("words"))
    return L.sources_of_pages(pages, blocks)


@query("refs_of_lessons", f"WITH {ONCE}, r AS (SELECT source.lesson_id AS lesson, struct_pack(p := source.position_in_module, id := id) AS o, id, unnest(learning_outcome_refs) AS r, generate_subscripts(learning_outcome_refs, 1) AS i FROM one), f AS (SELECT lesson, r, min(struct_pack(o := o, i := i)) AS k FROM r WHERE r IS NOT NULL GROUP BY ALL), g AS (SELECT lesson, string_agg(r, '|' ORDER BY k) AS refs FROM f GROUP BY lesson) SELECT l.lesson, coalesce(refs, '') AS refs FROM (SELECT DISTINCT source.lesson_id AS lesson FROM one) l LEFT JOIN g ON g.lesson IS NOT DISTINCT FROM l.lesson")
def _(spark, d):
    r = _one(spark, d, "source", "learning_outcome_refs").select("id", F.col("source.lesson_id").alias("lesson"), F.struct("source.position_in_module", "id").alias("o"), F.filter("learning_outcome_refs", lambda x: x.isNotNull()).alias("refs"))
    return L.merged_in_order(r, ["lesson"], F.col("o"), "refs").select("lesson", F.array_join("refs", "|").alias("refs"))


@query("nested_values", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def _(spark, d):
    return L.nested_ids(table(spark, d, "events"), "event_id", "props", ("k",))


@query("section_metadata", f"WITH {ONCE} SELECT id, coalesce(nullif(trim(content_type_label, ' '), ''), nullif(trim(chunk_type, ' '), ''), 'explanation') AS kind, CASE WHEN nullif(trim(content_type_label, ' '), '') IS NOT NULL THEN 'content_type_label' WHEN nullif(trim(chunk_type, ' '), '') IS NOT NULL THEN 'chunk_type' ELSE 'default' END AS kind_from, coalesce(nullif(trim(bloom_level, ' '), ''), 'understand') AS level, CASE WHEN nullif(trim(bloom_level, ' '), '') IS NOT NULL THEN 'bloom_level' ELSE 'default' END AS level_from FROM one")
def _(spark, d):
    return L.section_metadata(_one(spark, d, "content_type_label", "chunk_type", "bloom_level"), {"kind": ["content_type_label", "chunk_type"], "level": ["bloom_level"]}, {"kind": "explanation", "level": "understand"})


@query("module_roll_up", f"WITH {ONCE}, t AS (SELECT source.module_id AS module, lower(trim(k.term, ' ')) AS term, max((trim(coalesce(k.definition, ''), ' ') <> '')::INT) AS has FROM (SELECT source, unnest(key_terms) AS k FROM one) WHERE trim(k.term, ' ') <> '' GROUP BY ALL), g AS (SELECT module, count(*) AS terms, sum(has)::BIGINT AS definitions FROM t GROUP BY module), k AS (SELECT source.module_id AS module, count(*) FILTER (chunk_type = 'example') AS examples, count(*) FILTER (chunk_type = 'exercise') AS exercises FROM one GROUP BY 1) SELECT module, examples, exercises, coalesce(terms, 0) AS terms, coalesce(definitions, 0) AS definitions FROM k LEFT JOIN g USING (module)")
def _(spark, d):
    return L.roll_up(_one(spark, d, "source", "key_terms", "chunk_type").withColumn("module", F.col("source.module_id")), ["module"])


@query("taxonomy_errors", "WITH t AS (SELECT DISTINCT division, domain FROM courses WHERE course_code NOT LIKE 'W%') SELECT course_code AS id, CASE WHEN division NOT IN (SELECT division FROM t) THEN 'division' ELSE 'domain' END AS level, CASE WHEN division NOT IN (SELECT division FROM t) THEN division ELSE domain END AS value FROM courses WHERE division IS NOT NULL AND domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM t WHERE t.division = courses.division AND t.domain = courses.domain)")
def _(spark, d):
    """The taxonomy is that of the courses but for one group, which then must be found."""
    c = table(spark, d, "courses").select(F.col("course_code").alias("id"), "division", "domain")
    return L.taxonomy_errors(c.where("division is not null and domain is not null"), c.where("id not like 'W%'"), ["division", "domain"])


@query("tag_graph_of_roles", f"{_G} SELECT course, source, target, weight FROM ed WHERE source IN (SELECT DISTINCT lower(chunk_type) FROM one UNION SELECT unnest(['assessment', 'practice-set', 'learning-outcome', 'reading-list', 'learning-log', 'study-plan'])) AND target IN (SELECT unnest(['assessment', 'practice-set', 'learning-outcome', 'reading-list', 'learning-log', 'study-plan']) UNION SELECT DISTINCT lower(chunk_type) FROM one)")
def _(spark, d):
    """The tag graph of an inclusion list alone."""
    p = Parts(spark, d)
    listed = ["assessment", "practice-set", "learning-outcome", "reading-list", "learning-log", "study-plan", "assessment_item", "overview", "summary", "exercise", "explanation", "example"]
    return G.tag_graph(p.mentions.where(F.col("concept").isin(listed)))[1]


# ---------------------------------------------------------------- runs: a user's events are a run, their types its phases


def _ev(spark, d):
    return table(spark, d, "events")


@query("run_manifests", "WITH r AS (SELECT run_id, source.course_id AS course, min(created_at) AS created_at FROM chunks GROUP BY ALL), i AS (SELECT coalesce(run_id, '') AS run_id, course AS path, unnest([x FOR x IN [CASE WHEN run_id IS NULL THEN struct_pack(s := 'error', c := 'missing run_id') END, CASE WHEN created_at IS NULL THEN struct_pack(s := 'error', c := 'missing created_at') END, CASE WHEN NOT coalesce(run_id = 'run-1', false) THEN struct_pack(s := 'warning', c := 'other run') END] IF x IS NOT NULL]) AS x FROM r) SELECT x.s AS severity, x.c AS category, count(*) AS n FROM i GROUP BY ALL")
def _(spark, d):
    r = table(spark, d, "chunks").groupBy("run_id", F.col("source.course_id").alias("path")).agg(F.min("created_at").alias("created_at")).withColumn("dir_run", F.lit("run-1"))
    return U.manifest_issues(r).groupBy("severity", "category").agg(F.count("*").alias("n"))


@query("run_validation", "WITH s AS (SELECT user_id::VARCHAR AS run_id, count(*) FILTER (event_type = 'error') AS warnings FROM events GROUP BY 1) SELECT run_id, 0::BIGINT AS errors, warnings, true AS valid FROM s WHERE warnings > 0")
def _(spark, d):
    """Events of a run are its checkpoints; those of type `error` were begun and never completed."""
    c = _ev(spark, d).select(F.col("user_id").alias("run_id"), F.col("event_type").alias("phase_name"), F.when(F.col("event_type") == "error", "started").otherwise("completed").alias("status"), F.col("event_id").alias("path"))
    return U.validate_runs([U.checkpoint_issues(c)])


_FIN = "f AS (SELECT user_id, count(*) AS events, count(DISTINCT event_type) AS kinds FROM events GROUP BY 1)"


@query("finalized_runs", f"WITH {_FIN} SELECT user_id, events, kinds, events AS artifacts, true AS intact FROM f")
def _(spark, d):
    """Every event's record is an artifact; a second finalization of the same run must give the same digest."""
    ev = _ev(spark, d)
    art = ev.select("user_id", F.col("event_id").cast("string").alias("path"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"))
    done = U.finalize(ev, art, "user_id", "event_type")
    again = U.finalize(ev.repartition(5), art.repartition(7), "user_id", "event_type")
    same = U.verify_runs(done, again, "user_id").select("user_id", (F.col("status") == "intact").alias("intact"))
    return done.join(same, "user_id").select("user_id", "events", "kinds", "artifacts", "intact")


@query("changed_runs", "WITH c AS (SELECT user_id, bool_or(event_id % 1000 = 7) AS changed FROM events GROUP BY 1) SELECT user_id, CASE WHEN changed THEN 'changed' ELSE 'intact' END AS status FROM c")
def _(spark, d):
    """Integrity of all runs after some of their artifacts were altered."""
    ev = _ev(spark, d)
    art = ev.select("user_id", "event_id", F.col("event_id").cast("string").alias("path"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"))
    altered = art.withColumn("hash", F.when(F.col("event_id") % 1000 == 7, F.sha2(F.concat("hash", F.lit("!")), 256)).otherwise(F.col("hash")))
    return U.verify_runs(U.finalize(ev, art, "user_id", "event_type"), U.finalize(ev, altered, "user_id", "event_type"), "user_id")


@query("modified_files", "WITH a AS (SELECT event_id, CASE WHEN event_id % 500 = 3 THEN 'missing' WHEN event_id % 500 = 4 THEN 'modified' END AS status FROM events) SELECT event_id, status FROM a WHERE status IS NOT NULL")
def _(spark, d):
    """A lock of all events' hashes against files of which some are gone and some altered."""
    lock = _ev(spark, d).select("event_id", F.sha2(F.coalesce("props", F.lit("")), 256).alias("hash"))
    files = lock.where("event_id % 500 <> 3").withColumn("hash", F.when(F.col("event_id") % 500 == 4, F.lit("x")).otherwise(F.col("hash")))
    return U.lock_issues(lock, files, ["event_id"])


@query("replayed_decisions", "SELECT CASE WHEN value < 0.5 THEN 'skipped' WHEN event_type = 'click' THEN 'clicked' WHEN event_type = 'purchase' THEN CASE WHEN value > 10 THEN 'large' ELSE 'small' END ELSE 'unhandled' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def _(spark, d):
    ev = _ev(spark, d).select(F.col("event_id").alias("id"), "event_type", "value")
    handlers = {"click": lambda x: x.select("id", F.lit("clicked").alias("outcome")), "purchase": lambda x: x.select("id", F.when(F.col("value") > 10, "large").otherwise("small").alias("outcome"))}
    return U.replay(ev, handlers, "event_type", F.col("value") < 0.5).groupBy("outcome").agg(F.count("*").alias("n"))


_PH = "ph AS (SELECT user_id, event_type AS phase, arg_max(CASE WHEN value >= 5 THEN 'completed' WHEN value >= 2 THEN 'failed' ELSE 'started' END, (ts, event_id)) AS status, count(*) AS artifacts, min(ts) AS start, max(ts) AS \"end\" FROM events GROUP BY ALL)"


def _phases(spark, d):
    s = F.when(F.col("value") >= 5, "completed").when(F.col("value") >= 2, "failed").otherwise("started")
    return _ev(spark, d).groupBy("user_id", F.col("event_type").alias("phase")).agg(F.max_by(s, F.struct("ts", "event_id")).alias("status"), F.count("*").alias("artifacts"), F.min("ts").alias("start"), F.max("ts").alias("end"))


@query("run_outcomes", f"WITH {_PH} SELECT user_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status NOT IN ('completed', 'failed')) AS open, sum(artifacts)::BIGINT AS artifacts, ((epoch_us(max(\"end\")) - epoch_us(min(start))) // 1000000)::BIGINT AS seconds FROM ph GROUP BY user_id")
def _(spark, d):
    return U.outcome_summary(_phases(spark, d), "user_id")


@query("phase_difference", f"WITH {_PH}, a AS (SELECT phase, status, artifacts FROM ph WHERE user_id = 1), b AS (SELECT phase, status, artifacts FROM ph WHERE user_id = 2) SELECT coalesce(a.phase, b.phase) AS phase, coalesce(a.status, 'missing') AS before, coalesce(b.status, 'missing') AS after, coalesce(b.artifacts, 0) - coalesce(a.artifacts, 0) AS artifacts, CASE WHEN coalesce(a.status, 'missing') <> coalesce(b.status, 'missing') THEN 'status' WHEN a.artifacts <> b.artifacts THEN 'artifacts' ELSE 'same' END AS change FROM a FULL JOIN b ON a.phase = b.phase")
def _(spark, d):
    """Two runs' phases against one another."""
    p = _phases(spark, d).withColumn("score", F.lit(0.0))
    return U.phase_difference(p.where("user_id = 1"), p.where("user_id = 2"), "phase").select("phase", "before", "after", "artifacts", "change")


@query("gate_summary", "SELECT event_type, count(*) AS total, count(*) FILTER (value >= 5) AS passed, count(*) FILTER (NOT coalesce(value >= 5, false)) AS failed, round(count(*) FILTER (value >= 5) / count(*), 6) AS share FROM events GROUP BY event_type")
def _(spark, d):
    return U.gate_summary(_ev(spark, d).withColumn("ok", F.col("value") >= 5), ["event_type"], "ok").withColumn("share", F.round("share", 6))


@query("resumable_phases", f"WITH {_PH} SELECT user_id, arg_max(phase, (\"end\", phase)) AS phase FROM ph WHERE status <> 'completed' GROUP BY user_id")
def _(spark, d):
    return U.resumable(_phases(spark, d).withColumn("o", F.struct("end", "phase")), "user_id", "o", "status", "phase")


@query("table_difference", "(SELECT user_id, event_type, 'first' AS side FROM (SELECT user_id, event_type FROM events EXCEPT ALL SELECT user_id, event_type FROM events WHERE event_id % 97 <> 5)) UNION ALL (SELECT user_id, event_type, 'second' FROM (SELECT user_id, event_type FROM events WHERE event_id % 97 <> 5 EXCEPT ALL SELECT user_id, event_type FROM events))")
def _(spark, d):
    """A table against a copy that lacks some rows."""
    ev = _ev(spark, d)
    return U.table_difference(ev.select("user_id", "event_type"), ev.where("event_id % 97 <> 5").select("user_id", "event_type"))


@query("phase_order", "SELECT * FROM (VALUES ('extract', 0), ('chunk', 1), ('align', 2), ('graph', 3), ('index', 4)) v(phase, position)")
def _(spark, d):
    return U.phase_order(spark, {"index": ["graph", "align"], "graph": ["align"], "align": ["chunk"], "chunk": ["extract"], "extract": []})


@query("rate_excess", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 4")
def _(spark, d):
    return U.rate_excess(_ev(spark, d), ["event_type"], "ts", 4, "1 hour")


@query("leases", "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600 * 1000000::BIGINT OR lag(user_id) OVER w = user_id OR lag(ts) OVER w IS NULL, true) AS granted FROM events WINDOW w AS (PARTITION BY event_type, user_id % 10 ORDER BY ts, user_id)")
def _(spark, d):
    """Ten users share a resource; a request of another of them within an hour is turned down."""
    r = _ev(spark, d).withColumn("resource", F.concat_ws("/", "event_type", F.col("user_id") % 10))
    return U.leases(r, "resource", "user_id", "ts", 3600).select("event_id", "granted")


@query("stale_tasks", "WITH l AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT event_id FROM events LEFT JOIN l USING (user_id), n WHERE event_type = 'error' AND (t IS NULL OR epoch_us(now) - epoch_us(t) > 172800 * 1000000::BIGINT)")
def _(spark, d):
    """Errors are open tasks, views are heartbeats; a worker is dead after two days."""
    ev = _ev(spark, d)
    tasks = ev.where("event_type = 'error'").select("event_id", "user_id", F.lit("in_progress").alias("status"))
    return U.stale_tasks(tasks, ev.where("event_type = 'view'").select("user_id", "ts"), "user_id", F.lit(ev.agg(F.max("ts")).first()[0]), 172800).select("event_id")


@query("decision_issues", "WITH r AS (SELECT event_id, props, event_type, value FROM events), i AS (SELECT event_id, unnest([x FOR x IN [CASE WHEN trim(coalesce(props, ''), ' ') = '' THEN 'missing rationale' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase', 'signup') THEN 'unknown decision_type' END, CASE WHEN NOT value / 20 BETWEEN 0 AND 1 THEN 'confidence out of range' END] IF x IS NOT NULL]) AS issue FROM r) SELECT event_id, issue FROM i")
def _(spark, d):
    r = _ev(spark, d).select("event_id", F.col("user_id").alias("run_id"), F.col("ts").alias("timestamp"), F.lit("op").alias("operation"), F.col("event_type").alias("decision_type"), F.col("event_type").alias("decision"), F.col("props").alias("rationale"), (F.col("value") / 20).alias("confidence"))
    return U.decision_issues(r, "event_id", ["click", "view", "purchase", "signup"])


@query("export_levels", f"WITH {ONCE} SELECT id, CASE WHEN length(coalesce(text, '')) >= 100 AND coalesce(len(key_terms) > 0, false) AND coalesce(len(misconceptions) > 0, false) THEN 'exemplary' WHEN length(coalesce(text, '')) >= 50 THEN 'proficient' ELSE 'developing' END AS level FROM one")
def _(spark, d):
    return _one(spark, d, "text", "key_terms", "misconceptions").select("id", U.export_level(F.col("text"), F.size("key_terms") > 0, F.size("misconceptions") > 0).alias("level"))


@query("store_findings", f"WITH {ONCE}, c AS (SELECT DISTINCT source.course_id AS slug FROM one), k AS (SELECT course_code AS slug FROM courses), b AS (SELECT doc_id::VARCHAR AS name FROM documents WHERE text IS NOT NULL AND doc_id % 50 = 1) SELECT name, 'content differs from its name' AS finding FROM b UNION ALL SELECT slug, 'no chunks' FROM k WHERE slug NOT IN (SELECT slug FROM c) UNION ALL SELECT slug, 'not in the catalog' FROM c WHERE slug NOT IN (SELECT slug FROM k)")
def _(spark, d):
    """Documents are blobs named by their hash, some under a wrong name."""
    docs = table(spark, d, "documents").where("text is not null")
    h = F.sha2("text", 256)
    blobs = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("doc_id") % 50 == 1, "wrong").otherwise(h).alias("name"), h.alias("sha256"))
    slugs = _one(spark, d, F.col("source.course_id").alias("slug")).select("slug")
    return U.store_findings(blobs, table(spark, d, "courses").select(F.col("course_code").alias("slug")), slugs)


@query("outdated_index", "SELECT (SELECT max(created_at) FROM chunks) AS newest, (SELECT max(created_at) FROM courses) AS indexed, (SELECT max(created_at) FROM chunks) > (SELECT max(created_at) FROM courses) AS outdated")
def _(spark, d):
    return U.outdated_index(table(spark, d, "chunks"), table(spark, d, "courses"), "created_at")


@query("broken_chains", "SELECT event_type AS log, 5::BIGINT AS break_at FROM events GROUP BY event_type HAVING count(*) > 5")
def _(spark, d):
    """Chains of all types' events, each with its sixth record altered."""
    ev = _ev(spark, d).withColumn("payload", ids.canonical_json({c: F.col(c) for c in ("event_id", "event_type", "user_id", "value")}))
    c = E.append_chain(ev, "event_type", "event_id", "payload")
    return U.chain_issues(c.withColumn("payload", F.when(F.col("seq") == 5, F.concat("payload", F.lit(" "))).otherwise(F.col("payload"))))
