"""Queries of sections put together, tables found in text, rubrics and gaps, objectives made from topics, and pages' elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.operators import synthesis as Y
from loomspark.plans.registry import ONCE, query
from loomspark.sources import markup as M
from loomspark.tables import once_per_id, table


def _one(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


_RB = ["outcomes >= 3", "trim(title, ' ') <> ''", "overviews > 0", "summaries > 0", "examples * 10 >= n", "exercises * 20 >= n", "questions > 0", "aligned >= 0.6", "with_terms >= 0.3", "levels >= 4", "modules >= 3", "words <= 300"]


@query("course_rubric", f"""WITH {ONCE}, c AS (SELECT source.course_id AS course, count(*) AS n, count(*) FILTER (chunk_type = 'overview') AS overviews, count(*) FILTER (chunk_type = 'summary') AS summaries, count(*) FILTER (chunk_type = 'example') AS examples, count(*) FILTER (chunk_type = 'exercise') AS exercises, count(*) FILTER (chunk_type = 'assessment_item') AS questions,
avg(coalesce(len(learning_outcome_refs) > 0, false)::INT) AS aligned, avg(coalesce(len(key_terms) > 0, false)::INT) AS with_terms, count(DISTINCT bloom_level) AS levels, count(DISTINCT source.module_id) AS modules, avg(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{{A0}}]+')), 0)) AS words FROM one GROUP BY 1),
j AS (SELECT *, len(learning_outcomes) AS outcomes FROM c JOIN courses ON course_code = course), p AS (SELECT course, {' + '.join(f'coalesce({r}, false)::INT' for r in _RB)} AS passed FROM j) SELECT course, passed::INT AS passed, 12::INT AS "of", round(passed / 12, 6) AS score, passed / 12 >= 0.7 AS ok FROM p""")
def _(spark, d):
    return Y.course_rubric(_one(spark, d, "source", "chunk_type", "learning_outcome_refs", "key_terms", "bloom_level", "text"), table(spark, d, "courses")).withColumn("score", F.round("score", 6))


@query("objectives_from_topics", f"""WITH {ONCE}, t AS (SELECT source.course_id AS course, source.lesson_id AS lesson, min(source.lesson_title) AS heading FROM one WHERE source.lesson_title IS NOT NULL GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY lesson) - 1 AS i, count(*) OVER (PARTITION BY course) AS n FROM t)
SELECT course, 'to-' || lpad((i // ceil(n / 5)::BIGINT + 1)::VARCHAR, 2, '0') AS id, 'terminal' AS hierarchy_level, 0 AS week, 'Demonstrate command of ' || lower(heading) AS statement FROM n WHERE i % ceil(n / 5)::BIGINT = 0
UNION ALL SELECT course, 'co-' || lpad((i + 1)::VARCHAR, greatest(2, length((i + 1)::VARCHAR))::INT, '0'), 'chapter', (floor(i * 12 / n) + 1)::INT, (['Explain', 'Apply', 'Analyze', 'Evaluate'])[(i % 4 + 1)::INT] || ' ' || lower(heading) FROM n""")
def _(spark, d):
    t = _one(spark, d, "source").where("source.lesson_title is not null").groupBy(F.col("source.course_id").alias("course"), F.col("source.lesson_id").alias("lesson")).agg(F.min("source.lesson_title").alias("heading"))
    return Y.objectives_from_topics(t, ["course"], "lesson", 12).na.fill(0, ["week"])


@query("merged_sources", f"""WITH {ONCE}, p AS (SELECT source.module_id AS module, 'table' AS src, content_type_label AS v, 0.9 AS c FROM one UNION ALL SELECT source.module_id, 'text', chunk_type, 0.8 FROM one), f AS (SELECT * FROM p WHERE v IS NOT NULL AND trim(v, ' ') <> ''), g AS (SELECT module, lower(v) AS form, sum(c) AS total, max(c) AS best, count(DISTINCT src) AS agree FROM f GROUP BY ALL) SELECT module, form AS value, round(1 - (1 - best) * pow(0.9, agree - 1), 6)::DOUBLE AS confidence, agree FROM g QUALIFY row_number() OVER (PARTITION BY module ORDER BY round(total, 6) DESC, form) = 1""")
def _(spark, d):
    """Labels and kinds of a module's chunks are two sources that say what it is made of."""
    one = _one(spark, d, F.col("source.module_id").alias("module"), "content_type_label", "chunk_type")
    part = lambda c, s: one.select("module", F.lit(s).alias("source"), F.col(c).alias("value"), F.lit(None).cast("double").alias("confidence"))
    m = Y.merge_sources(part("content_type_label", "table").unionByName(part("chunk_type", "text")), ["module"])
    return m.select("module", F.lower("value").alias("value"), F.round("confidence", 6).alias("confidence"), "agree")


@query("table_rows", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents), c AS (SELECT doc_id, row, [trim(x, ' ') FOR x IN regexp_split_to_array(regexp_replace(trim(line, ' '), '^\\||\\|$', '', 'g'), '\\s*\\|\\s*|\\t+| {2,}')] AS c FROM l) SELECT doc_id, row::INT AS row, c[1] AS a, c[2] AS b, c[3] AS c, c[4] AS d FROM c WHERE len(c) = 4 AND len([x FOR x IN c IF regexp_matches(x, '^[-:= ]*$')]) = 0 AND lower(c[1]) <> 'a'")
def _(spark, d):
    return Y.table_rows(table(spark, d, "documents"), "doc_id", "text", ["a", "b", "c", "d"])


@query("mean_confidence", "SELECT event_type, round(coalesce(avg(CASE WHEN event_type <> 'view' THEN value END), 1.0), 6) AS confidence FROM events GROUP BY event_type")
def _(spark, d):
    e = table(spark, d, "events").select("event_type", F.when(F.col("event_type") != "view", F.col("value")).alias("confidence"))
    return Y.mean_confidence(e, ["event_type"]).withColumn("confidence", F.round("confidence", 6))


@query("conversion_report", "WITH s AS (SELECT source, count(*) AS sections, count(*) FILTER (trim(coalesce(text, ''), ' ') = '') AS empty, sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\x{A0}]+')), 0))::BIGINT AS words, count(*) FILTER (contains(coalesce(text, ''), '&amp;')) AS failures FROM documents WHERE source IS NOT NULL GROUP BY source) SELECT source, sections, empty, words, 1.0::DOUBLE AS confidence, failures, failures = 0 AND empty * 2 <= sections AS passed FROM s")
def _(spark, d):
    """A site is a document, its pages the sections; entities left in the text are failures."""
    docs = table(spark, d, "documents").where("source is not null").select("source", "text", F.lit(None).cast("double").alias("confidence"))
    bad = docs.where(F.contains(F.coalesce("text", F.lit("")), F.lit("&amp;"))).select("source", F.lit(1).alias("n"))
    return Y.conversion_report(docs, bad, "source")


@query("module_openers", f"WITH {ONCE} SELECT id, source.module_id AS module FROM one QUALIFY row_number() OVER (PARTITION BY source.module_id ORDER BY source.position_in_module, id) = 1")
def _(spark, d):
    rows = _one(spark, d, F.col("source.module_id").alias("module"), F.col("source.position_in_module").alias("pos"))
    return Y.first_of_each(rows, ["module"], ["pos", "id"]).select("id", "module")


_KINDS = ["overview", "summary", "example", "exercise", "assessment_item", "glossary"]


@query("content_gaps", f"WITH {ONCE}, e AS (SELECT course_code AS course, k AS kind FROM courses, (VALUES {', '.join(f'({k!r})' for k in _KINDS)}) v(k)), a AS (SELECT source.course_id AS course, chunk_type AS kind, count(*) AS rows FROM one GROUP BY ALL) SELECT e.course, e.kind, 'missing' AS finding FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.course = e.course AND a.kind = e.kind)")
def _(spark, d):
    expected = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode(F.array(*[F.lit(k) for k in _KINDS])).alias("kind"))
    have = _one(spark, d, F.col("source.course_id").alias("course"), F.col("chunk_type").alias("kind")).groupBy("course", "kind").agg(F.count("*").alias("rows"))
    return Y.content_gaps(expected, have, ["course", "kind"])


@query("strict_evidence", f"WITH {ONCE} SELECT id AS source, source.lesson_id AS target, 'linked' AS rule, array_to_string([x FOR x IN [CASE WHEN coalesce(follows_chunk, '') = '' THEN 'follows' END, CASE WHEN coalesce(difficulty, '') = '' THEN 'difficulty' END] IF x IS NOT NULL], ',') AS missing FROM one WHERE coalesce(follows_chunk, '') = '' OR coalesce(difficulty, '') = ''")
def _(spark, d):
    """Links of chunks, whose evidence must name the chunk before and the difficulty."""
    one = _one(spark, d, "follows_chunk", "difficulty", F.col("source.lesson_id").alias("target"))
    e = one.select(F.col("id").alias("source"), "target", F.lit("linked").alias("rule"), F.create_map(F.lit("follows"), "follows_chunk", F.lit("difficulty"), "difficulty").alias("evidence"))
    return Y.strict_evidence(e, {"linked": ["follows", "difficulty"]}).withColumn("missing", F.array_join("missing", ","))


@query("iso_times", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", Y.iso_time(F.col("ts")).alias("at"))


@query("applied_filters", "SELECT event_type, 'difficulty=advanced;refs=co-01,to-01' AS applied FROM (SELECT DISTINCT event_type FROM events)")
def _(spark, d):
    m = Y.applied_filters({"chunk_type": None, "difficulty": "advanced", "refs": ["co-01", "to-01"], "min_tokens": 0, "tags": []})
    text = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, d, "events").select("event_type").distinct().withColumn("applied", text)


def _pages(spark, d):
    """Documents as pages: headings as marked, every other line a paragraph."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "&", "&amp;"), "<", "&lt;"), "[\r\x0b\x0c\x1c-\x1f\x85  ]", " ")
    lines = F.transform(F.split(t, "\n"), lambda x: F.when(x.rlike("^# +[^ ]"), F.concat(F.lit("<h1>"), F.regexp_replace(x, "^# +", ""), F.lit("</h1>"))).when(x.rlike("^## +[^ ]"), F.concat(F.lit("<h2>"), F.regexp_replace(x, "^## +", ""), F.lit("</h2>"))).otherwise(F.concat(F.lit("<p>"), x, F.lit("</p>"))))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("<html><body>"), F.array_join(lines, ""), F.lit("</body></html>")).alias("html"))


@query("page_structure", "WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL) SELECT id, count(*) FILTER (regexp_matches(x, '^# +[^ ]')) AS chapters, count(*) FILTER (regexp_matches(x, '^## +[^ ]')) AS sections FROM l GROUP BY id HAVING count(*) FILTER (regexp_matches(x, '^##? +[^ ]')) > 0")
def _(spark, d):
    s = M.textbook_structure(_pages(spark, d))
    return s.groupBy("id").agg(F.count_if(F.col("kind") == "chapter").alias("chapters"), F.count_if(F.col("kind") == "section").alias("sections")).where("chapters + sections > 0")


@query("accessibility_report", "SELECT doc_id AS id, 2::BIGINT AS failures, 2::BIGINT AS criteria FROM documents")
def _(spark, d):
    """Pages made of documents' text have no language and no title, and nothing else to fail."""
    return M.accessibility_report(M.accessibility(_pages(spark, d))).select("id", "failures", "criteria")


@query("slides", f"WITH {ONCE}, t AS (SELECT id, len(string_split(text, chr(10))) AS n FROM one WHERE text IS NOT NULL), s AS (SELECT id, n, unnest(range(0, ceil(n / 6)::BIGINT)) AS k FROM t) SELECT id, k::INT AS slide, k > 0 AS continued, least(6, n - k * 6)::INT AS points FROM s")
def _(spark, d):
    """A chunk is a section, its lines the points."""
    s = _one(spark, d, "text", F.col("source.section_heading").alias("heading")).where("text is not null").select("id", F.lit(0).alias("o"), F.coalesce("heading", F.lit("")).alias("heading"), F.split("text", "\n", -1).alias("points"))
    return M.slides(s, ["id"], "o").select("id", "slide", F.col("title").endswith(" (continued)").alias("continued"), F.size("points").alias("points"))


@query("contacts")
def _(spark, d):
    return Y.contacts(table(spark, d, "documents"), "doc_id", "text")


@query("roster")
def _(spark, d):
    return Y.roster(table(spark, d, "documents"), "doc_id", "text")
