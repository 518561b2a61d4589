"""Queries of questions: scores, gates, leaks, and questions made from content."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import assessment as Q, checks as C
from loomspark.plans.registry import ONCE, query
from loomspark.plans.text_queries import _V
from loomspark.session import materialize
from loomspark.tables import once_per_id, table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_COLUMNS = ["source", "bloom_level", "learning_outcome_refs", "text", "chunk_type"]


def _words(c: str) -> str:
    return f"list_distinct([t FOR t IN regexp_extract_all(lower({c}), '[a-z]{{3,}}') IF t NOT IN ({_STOP})])"


_CH = "[trim(regexp_replace(x, '^\\s*[A-H][).]\\s+', ''), ' ') FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '^\\s*[A-H][).]\\s')]"
_Q = f"q AS (SELECT id, source.course_id AS course, bloom_level AS level, learning_outcome_refs AS refs, trim(regexp_split_to_array(text, '\\n\\s*[A-H][).]\\s')[1], ' ') AS stem, {_CH} AS choices FROM one WHERE chunk_type = 'assessment_item' AND text IS NOT NULL)"
_LO = "lo AS (SELECT DISTINCT course_code AS course, lower(x.id) AS lo FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses) WHERE x.id IS NOT NULL)"


def _chunks(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


def _questions(spark, d):
    return materialize(Q.questions_of(_chunks(spark, d, *_COLUMNS)), "questions")


def _targets(spark, d):
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).where("x.id is not null")
    return o.select("course", F.lower("x.id").alias("lo")).distinct()


_QS = f"""{_Q}, vo AS (SELECT DISTINCT course, unnest(w) AS word FROM (SELECT source.course_id AS course, {_words("coalesce(text, '')")} AS w FROM one)), nv AS (SELECT course, count(*) AS nv FROM vo GROUP BY course),
pa AS (SELECT id, course, 0 AS part, {_words('stem')} AS w FROM q UNION ALL SELECT id, course, i, {_words('c')} FROM (SELECT id, course, unnest(range(1, len(choices))) AS i, unnest(choices[2:]) AS c FROM q)),
ht AS (SELECT id, part, count(*) AS k FROM (SELECT id, course, part, unnest(w) AS word FROM pa) JOIN vo USING (course, word) GROUP BY ALL),
sh AS (SELECT id, part, len(w) AS n, coalesce(k, 0) / (len(w) + nv - coalesce(k, 0)) AS j FROM pa LEFT JOIN nv USING (course) LEFT JOIN ht USING (id, part)),
dp AS (SELECT q.id, avg(greatest(0, 1.0 - CASE WHEN len(regexp_extract_all(c, '\\S+')) < 3 THEN 0.4 ELSE 0 END - CASE WHEN len(a) > 0 AND len(list_intersect(w, a)) / len(list_distinct(list_concat(w, a))) > 0.9 THEN 0.5 ELSE 0 END - CASE WHEN n > 0 AND j < 0.01 THEN 0.3 ELSE 0 END)) AS dp
  FROM (SELECT id, unnest(range(1, len(choices))) AS part, unnest(choices[2:]) AS c, {_words("coalesce(choices[1], '')")} AS a FROM q) q JOIN sh USING (id, part) JOIN pa USING (id, part) GROUP BY q.id),
bl AS (SELECT id, CASE {' '.join(f"WHEN regexp_matches(lower(stem), '\\b{v}\\b') THEN '{n}'" for v, n in _V)} END AS found FROM q),
sc AS (SELECT q.id, q.course, least(1.0, sh.j * 5) AS stem_grounding, CASE WHEN len(choices) = 0 THEN 1.0 ELSE coalesce(dp, 0) END AS distractor_plausibility,
CASE WHEN len(choices) = 0 THEN 0.8 WHEN len(regexp_extract_all(choices[1], '\\S+')) >= 5 THEN 1.0 WHEN len(regexp_extract_all(choices[1], '\\S+')) >= 2 THEN 0.6 ELSE 0.3 END AS answer_specificity,
CASE WHEN found IS NULL THEN 0.5 WHEN level IS NULL THEN 0.7 WHEN found = lower(level) THEN 1.0 ELSE 0.4 END AS bloom_alignment, 0.0 AS feedback_quality FROM q JOIN sh ON sh.id = q.id AND sh.part = 0 LEFT JOIN dp ON dp.id = q.id JOIN bl ON bl.id = q.id)"""


@query("question_quality", f"WITH {ONCE}, {_QS} SELECT id, course, " + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in Q.QUALITY_WEIGHTS) + " FROM sc")
def _(spark, d):
    s = Q.question_quality(_questions(spark, d), Q.vocabulary_of(_chunks(spark, d, "source", "text")))
    return s.select("id", "course", *[F.round(c, 6).alias(c) for c in Q.QUALITY_WEIGHTS])


@query("question_quality_gate", f"WITH {ONCE}, {_QS} SELECT course, round(" + " + ".join(f"{w} * avg({c}::DOUBLE)" for c, w in Q.QUALITY_WEIGHTS.items()) + ", 4) AS score, " + " + ".join(f"{w} * avg({c}::DOUBLE)" for c, w in Q.QUALITY_WEIGHTS.items()) + " >= 0.6 AS passed FROM sc GROUP BY course")
def _(spark, d):
    s = Q.question_quality(_questions(spark, d), Q.vocabulary_of(_chunks(spark, d, "source", "text")))
    return Q.quality_score(s, ["course"]).withColumn("score", F.round("score", 4))


@query("assessment_dimension", f"""WITH {ONCE}, {_Q}, {_LO}, dc AS (SELECT id, lower(trim(c, ' ')) AS c, count(*) AS k FROM (SELECT id, unnest(choices[2:]) AS c FROM q) GROUP BY ALL), pp AS (SELECT id, k / sum(k) OVER (PARTITION BY id) AS p FROM dc),
en AS (SELECT id, CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END AS e FROM pp GROUP BY id), cv AS (SELECT DISTINCT course, lower(r) AS lo FROM (SELECT course, unnest(refs) AS r FROM q)),
ht AS (SELECT lo.course, count(cv.lo) / count(*) AS coverage FROM lo LEFT JOIN cv ON cv.course = lo.course AND cv.lo = lo.lo GROUP BY lo.course),
g AS (SELECT course, count(*) AS n, count(DISTINCT lower(stem)) FILTER (stem <> '') / count(*) FILTER (stem <> '') AS stem_share, count(DISTINCT lower(choices[1])) / count(choices[1]) AS answer_share, avg(coalesce(e, 0)) AS distractor_entropy FROM q LEFT JOIN en USING (id) GROUP BY course)
SELECT course, n, round(stem_share, 3) AS stem_share, round(answer_share, 3) AS answer_share, round(distractor_entropy, 3) AS distractor_entropy, round(coalesce(coverage, 1), 3) AS coverage FROM g LEFT JOIN ht USING (course)""")
def _(spark, d):
    g = Q.assessment_dimension(_questions(spark, d), _targets(spark, d))
    return g.select("course", "n", *[F.round(c, 3).alias(c) for c in ("stem_share", "answer_share", "distractor_entropy", "coverage")])


@query("phantom_outcomes", f"WITH {ONCE}, {_Q}, rf AS (SELECT DISTINCT source.course_id AS course, lower(r) AS lo FROM (SELECT source, unnest(learning_outcome_refs) AS r FROM one WHERE chunk_type <> 'assessment_item')), n AS (SELECT DISTINCT id, course, lower(r) AS lo FROM (SELECT id, course, unnest(refs) AS r FROM q) WHERE r IS NOT NULL) SELECT id, lo FROM n WHERE NOT EXISTS (SELECT 1 FROM rf WHERE rf.course = n.course AND rf.lo = n.lo)")
def _(spark, d):
    taught = _chunks(spark, d, "source", "learning_outcome_refs", "chunk_type").where("chunk_type <> 'assessment_item'")
    return Q.phantom_outcomes(_questions(spark, d), taught.select(F.col("source.course_id").alias("course"), F.explode("learning_outcome_refs").alias("lo")))


@query("assessment_gate", f"WITH {ONCE}, {_Q}, s AS (SELECT course, lower(trim(stem, ' ')) AS s, count(*) AS n FROM q GROUP BY ALL), g AS (SELECT course, sum(n)::BIGINT AS questions, count(*) FILTER (n > 1 AND s <> '') AS repeated_stems FROM s GROUP BY course) SELECT *, round(1 - 0.05 * ((repeated_stems > 0)::INT + (questions < 5)::INT), 6)::DOUBLE AS score, 1 - 0.05 * ((repeated_stems > 0)::INT + (questions < 5)::INT) >= 0.85 AS passed FROM g")
def _(spark, d):
    return Q.assessment_gate(_questions(spark, d), ["course"]).withColumn("score", F.round("score", 6))


@query("level_mismatches", f"WITH {ONCE}, {_Q}, k AS (SELECT id, level, CASE WHEN len(choices) > 0 THEN 'multiple_choice' WHEN contains(stem, '_____') THEN 'fill_in_blank' WHEN regexp_matches(lower(stem), '\\b(discuss|evaluate|analy[sz]e|argue|critique)\\b') THEN 'essay' ELSE 'short_answer' END AS kind FROM q) SELECT id, kind, level FROM k WHERE level IS NOT NULL AND NOT CASE kind " + " ".join(f"WHEN '{k}' THEN level IN ({', '.join(repr(x) for x in v)})" for k, v in C.TYPES_OF_LEVEL.items()) + " ELSE true END")
def _(spark, d):
    return Q.level_mismatches(_questions(spark, d))


def _revealed(spark, d):
    """All texts with what gives an answer away; corrections of misconceptions stand for the feedback that texts lack."""
    return _chunks(spark, d, "text")


@query("answer_reveals", f"WITH {ONCE}, h AS (SELECT id, sign, len(regexp_extract_all(t, p)) AS n FROM (SELECT id, coalesce(text, '') AS t FROM one), (VALUES " + ", ".join(f"('{n}', '(?i){p}')" for p, n in Q.REVEALS) + f") v(sign, p)) SELECT id, sign, n::INT AS n FROM h WHERE n > 0 AND id NOT IN (SELECT id FROM one WHERE regexp_matches(text, '(?i){Q.EXPLAINS.replace(chr(39), chr(39) * 2)}'))")
def _(spark, d):
    """Texts that explain nothing anywhere; where one does, the places beside it are told apart, which a fixture tests."""
    c = _revealed(spark, d).where(~F.coalesce(F.col("text").rlike(f"(?i){Q.EXPLAINS}"), F.lit(False)))
    return Q.reveals(c)


@query("leak_batch", f"WITH {ONCE}, h AS (SELECT id FROM (SELECT id, coalesce(text, '') AS t FROM one WHERE NOT coalesce(regexp_matches(text, '(?i){Q.EXPLAINS.replace(chr(39), chr(39) * 2)}'), false)), (VALUES " + ", ".join(f"('(?i){p}')" for p, _ in Q.REVEALS) + ") v(p) WHERE regexp_matches(t, p)) SELECT count(DISTINCT id) AS failing, count(*) AS leaks, (SELECT count(*) FROM one)::INT AS examples, count(*) = 0 AS passed FROM h")
def _(spark, d):
    c = _revealed(spark, d)
    return Q.leak_batch([Q.reveals(c.where(~F.coalesce(F.col("text").rlike(f"(?i){Q.EXPLAINS}"), F.lit(False))))], c.count())


@query("multiple_choice", f"WITH {ONCE}, t AS (SELECT id, source.course_id AS course, k.term AS term, k.definition AS definition FROM (SELECT id, source, unnest(key_terms) AS k FROM one) WHERE k.term IS NOT NULL AND trim(k.term, ' ') <> '' AND k.definition IS NOT NULL AND trim(k.definition, ' ') <> ''), n AS (SELECT course, count(DISTINCT definition) AS n FROM t GROUP BY course) SELECT DISTINCT id, term, 'Which of these describes ' || trim(term, ' ') || '?' AS stem, definition AS answer, least(3, n - 1)::INT AS wrong, true AS proper FROM t JOIN n USING (course)")
def _(spark, d):
    """Of each question the number of wrong choices, and whether they are different, not the answer, and meanings of its own course."""
    c = _chunks(spark, d, "source", "key_terms").withColumn("course", F.col("source.course_id"))
    m = Q.multiple_choice(c).distinct()
    proper = (F.size(F.array_distinct("distractors")) == F.size("distractors")) & ~F.array_contains("distractors", F.col("answer"))
    return m.select("id", "term", "stem", "answer", F.size("distractors").alias("wrong"), proper.alias("proper"))


_STEMS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in Q.FREE_STEMS.items())


@query("free_questions", f"WITH {ONCE}, t AS (SELECT id, coalesce(bloom_level, 'understand') AS level, coalesce(([x FOR x IN concept_tags IF x IS NOT NULL AND trim(x, ' ') <> ''])[1], nullif(trim(source.section_heading, ' '), '')) AS topic FROM one) SELECT id, CASE WHEN level IN ('analyze', 'evaluate', 'create') THEN 'essay' ELSE 'short_answer' END AS kind, replace(coalesce(CASE level {_STEMS} END, '{Q.FREE_STEMS['understand']}'), '{{}}', regexp_replace(topic, '[-_]+', ' ', 'g')) AS prompt FROM t WHERE topic IS NOT NULL")
def _(spark, d):
    return Q.free_questions(_chunks(spark, d, "bloom_level", "concept_tags", F.col("source.section_heading").alias("section_heading")))


@query("augmented_questions", f"WITH {ONCE}, lo AS (SELECT course_code, unnest(learning_outcomes) AS x FROM courses), g AS (SELECT x.statement AS question FROM lo WHERE x.statement IS NOT NULL), c AS (SELECT m.misconception AS question FROM (SELECT unnest(misconceptions) AS m FROM one) WHERE m.misconception IS NOT NULL UNION ALL SELECT upper(question) FROM g), n AS (SELECT DISTINCT trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'), ' ') AS k FROM g) SELECT question, count(*) AS n FROM (SELECT question FROM g UNION ALL SELECT question FROM c WHERE trim(regexp_replace(lower(question), '[^a-z0-9]+', ' ', 'g'), ' ') NOT IN (SELECT k FROM n)) GROUP BY question")
def _(spark, d):
    """Outcomes' statements, and as curated questions the misconceptions and the same statements in capitals, which add nothing."""
    g = table(spark, d, "courses").select(F.explode("learning_outcomes").alias("x")).select(F.col("x.statement").alias("question")).where("question is not null")
    m = _chunks(spark, d, "misconceptions").select(F.explode("misconceptions").alias("m")).select(F.col("m.misconception").alias("question")).where("question is not null")
    return Q.augmented(g, m.unionByName(g.select(F.upper("question").alias("question")))).groupBy("question").agg(F.count("*").alias("n"))


@query("generated_assessment", f"""WITH {ONCE}, t AS (SELECT DISTINCT id, k.term AS term, k.definition AS definition FROM (SELECT id, unnest(key_terms) AS k FROM one) WHERE k.term IS NOT NULL AND trim(k.term, ' ') <> '' AND k.definition IS NOT NULL AND trim(k.definition, ' ') <> ''), c AS (SELECT DISTINCT id, 'multiple_choice' AS kind, trim(term, ' ') AS p, definition AS a FROM t),
m AS (SELECT id, m.misconception AS s FROM (SELECT id, unnest(misconceptions) AS m FROM one) WHERE m.misconception IS NOT NULL), tf AS (SELECT DISTINCT id, 'true_false', s, 'false' FROM m UNION SELECT id, 'true_false', s, 'true' FROM m WHERE regexp_matches(s, '\\b(is|are|can|has)\\b')),
g AS (SELECT DISTINCT id, 'fill_in_blank', substr(text, 1, position(lower(k.term) IN lower(text)) - 1) || '_____' || substr(text, position(lower(k.term) IN lower(text)) + length(k.term)), k.term FROM (SELECT id, text, unnest(key_terms) AS k FROM one) WHERE trim(k.term, ' ') <> '' AND position(lower(k.term) IN lower(text)) > 0),
fr AS (SELECT id, CASE WHEN coalesce(bloom_level, 'understand') IN ('analyze', 'evaluate', 'create') THEN 'essay' ELSE 'short_answer' END, '', '' FROM one WHERE coalesce(([x FOR x IN concept_tags IF x IS NOT NULL AND trim(x, ' ') <> ''])[1], nullif(trim(source.section_heading, ' '), '')) IS NOT NULL)
SELECT kind, count(*) AS n FROM (SELECT * FROM c UNION ALL SELECT * FROM tf UNION ALL SELECT * FROM g UNION ALL SELECT * FROM fr) GROUP BY kind""")
def _(spark, d):
    """How many questions of each kind the chunks give."""
    c = _chunks(spark, d, "source", "key_terms", "misconceptions", "text", "bloom_level", "concept_tags").withColumn("course", F.col("source.course_id")).withColumn("section_heading", F.col("source.section_heading"))
    return Q.assessment(c).groupBy("kind").agg(F.count("*").alias("n"))
