"""Queries of filters, checks and validations."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomspark.functions import scoring, text as T
from loomspark.operators import checks as C, retrieval as R, roles as O
from loomspark.plans.registry import ONCE, query
from loomspark.plans.text_queries import _V
from loomspark.tables import once_per_id, table


def _one(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


_LO = "o AS (SELECT course_code AS course, lower(x.id) AS lo, x.statement AS statement, x.hierarchy_level AS level, x.bloom_level AS bloom FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses) WHERE x.id IS NOT NULL), r AS (SELECT DISTINCT id, source.course_id AS course, lower(ref) AS lo FROM (SELECT id, source, unnest(learning_outcome_refs) AS ref FROM one))"


def _outcomes(spark, d):
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).where("x.id is not null")
    return o.select("course", F.lower("x.id").alias("lo"), F.col("x.statement").alias("statement"), F.col("x.hierarchy_level").alias("level"), F.col("x.bloom_level").alias("bloom"))


def _refs(spark, d):
    return _one(spark, d, "source", "learning_outcome_refs").select("id", F.col("source.course_id").alias("course"), F.explode("learning_outcome_refs").alias("ref")).select("id", "course", F.lower("ref").alias("lo")).distinct()


@query("chunks_of_terminal_outcomes", f"WITH {ONCE}, {_LO} SELECT DISTINCT r.id FROM r JOIN o USING (course, lo) WHERE lower(o.level) = 'terminal'")
def _(spark, d):
    return _refs(spark, d).join(_outcomes(spark, d).where("lower(level) = 'terminal'"), ["course", "lo"], "left_semi").select("id").distinct()


@query("outcome_question_set", f"WITH {ONCE}, {_LO} SELECT course, lo, count(DISTINCT id) AS n_relevant, min(id) AS first_relevant FROM o JOIN r USING (course, lo) GROUP BY course, lo")
def _(spark, d):
    return _outcomes(spark, d).select("course", "lo").distinct().join(_refs(spark, d), ["course", "lo"]).groupBy("course", "lo").agg(F.count_distinct("id").alias("n_relevant"), F.min("id").alias("first_relevant"))


_Q = "explain the working memory and the retrieval practice"


@query("statement_matches", f"WITH {ONCE}, {_LO}, j AS (SELECT course, lo, list_distinct(regexp_extract_all(lower(statement), '[a-z0-9]+(?:-[a-z0-9]+)*')) AS s, list_distinct(regexp_extract_all('{_Q}', '[a-z0-9]+(?:-[a-z0-9]+)*')) AS q FROM o WHERE statement IS NOT NULL) SELECT DISTINCT r.id, round(max(len(list_intersect(s, q)) / len(list_distinct(list_concat(s, q)))), 6) AS best FROM j JOIN r USING (course, lo) GROUP BY r.id")
def _(spark, d):
    toks = lambda c: F.array_distinct(T.find_all(c, "[a-z0-9]+(?:-[a-z0-9]+)*"))
    o = _outcomes(spark, d).where("statement is not null").select("course", "lo", T.jaccard(toks(F.lower("statement")), toks(F.lit(_Q))).alias("j"))
    return _refs(spark, d).join(o, ["course", "lo"]).groupBy("id").agg(F.round(F.max("j"), 6).alias("best"))


@query("bloom_alignment", f"WITH {ONCE}, {_LO}, l AS (SELECT course, lo, bloom, CASE " + " ".join(f"WHEN regexp_matches(lower(statement), '\\b{v}\\b') THEN '{n}'" for v, n in _V) + " END AS found FROM o) SELECT course, count(*) AS n, round(avg((found IS NOT NULL AND found = bloom)::INT), 6) AS aligned FROM l WHERE bloom IS NOT NULL GROUP BY course")
def _(spark, d):
    o = _outcomes(spark, d).where("bloom is not null").withColumn("found", scoring.detect_bloom(F.col("statement")))
    return o.groupBy("course").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("found") == F.col("bloom"), 1.0).otherwise(0.0)), 6).alias("aligned"))


_SLUG = "trim(regexp_replace(regexp_replace(lower(tag), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query("tag_verdicts", f"WITH {ONCE}, t AS (SELECT DISTINCT unnest(concept_tags) AS tag FROM one), s AS (SELECT tag, {_SLUG} AS slug FROM t WHERE tag IS NOT NULL), w AS (SELECT *, [x FOR x IN string_split(slug, '-') IF x <> ''] AS w FROM s) SELECT tag, slug, CASE WHEN slug = '' THEN 'empty' WHEN len([x FOR x IN w IF x NOT IN ({_STOP})]) = 0 THEN 'stop words only' WHEN NOT regexp_matches(slug, '^[a-z]') THEN 'no letter first' WHEN len(w) > 4 THEN 'too many words' WHEN contains(slug, '--') THEN 'format' END AS reason FROM w")
def _(spark, d):
    t = _one(spark, d, "concept_tags").select(F.explode("concept_tags").alias("tag")).where("tag is not null").distinct()
    slug, reason = C.tag_verdict(F.col("tag"))
    return t.select("tag", slug.alias("slug"), reason.alias("reason"))


@query("cleaned_tags")
def _(spark, d):
    return _one(spark, d, "concept_tags").select("id", C.clean_tags(F.col("concept_tags")).alias("tags"))


@query("scrap_terms", f"WITH {ONCE}, k AS (SELECT DISTINCT k.term AS term FROM (SELECT unnest(key_terms) AS k FROM one)) SELECT term, regexp_matches(trim(term, ' '), '{C.SCRAPS}') AS scrap FROM k WHERE term IS NOT NULL")
def _(spark, d):
    k = _one(spark, d, "key_terms").select(F.explode("key_terms.term").alias("term")).where("term is not null").distinct()
    return k.select("term", C.is_scrap(F.col("term")).alias("scrap"))


@query("schema_findings", f"WITH {ONCE}, f AS (SELECT id, unnest([x FOR x IN [CASE WHEN text IS NULL THEN 'text missing' END, CASE WHEN source.course_id IS NULL THEN 'course missing' END, CASE WHEN source.module_id IS NULL THEN 'module missing' END, CASE WHEN concept_tags IS NULL THEN 'tags missing' END, CASE WHEN learning_outcome_refs IS NULL THEN 'outcomes missing' END, CASE WHEN chunk_type IS NULL OR chunk_type NOT IN ('assessment_item', 'overview', 'summary', 'exercise', 'explanation', 'example') THEN 'unknown chunk type' END, CASE WHEN difficulty NOT IN ('foundational', 'intermediate', 'advanced') THEN 'unknown difficulty' END, CASE WHEN bloom_level NOT IN ('remember', 'understand', 'apply', 'analyze', 'evaluate', 'create') THEN 'unknown level' END, CASE WHEN tokens_estimate IS NULL THEN 'tokens missing' END, CASE WHEN word_count IS NULL THEN 'words missing' END, CASE WHEN coalesce(least(tokens_estimate, word_count), 0) < 0 THEN 'negative size' END] IF x IS NOT NULL]) AS finding FROM one) SELECT id, finding FROM f")
def _(spark, d):
    return C.schema_findings(once_per_id(table(spark, d, "chunks")))


@query("finding_samples", f"WITH {ONCE}, f AS (SELECT source.course_id AS course, id FROM one WHERE tokens_estimate IS NULL) SELECT course, id, count(*) OVER (PARTITION BY course) AS n, (row_number() OVER (PARTITION BY course ORDER BY id))::INT AS k FROM f QUALIFY k <= 3")
def _(spark, d):
    f = _one(spark, d, "source", "tokens_estimate").where("tokens_estimate is null").select(F.col("source.course_id").alias("course"), "id")
    return C.samples_and_rest(f, ["course"], "id")


@query("filter_preview", "SELECT 'quality' AS stage, count(*) FILTER (value >= 1) AS kept FROM events UNION ALL SELECT 'kind', count(*) FILTER (value >= 1 AND event_type <> 'error') FROM events UNION ALL SELECT 'named', count(*) FILTER (value >= 1 AND event_type <> 'error' AND user_id IS NOT NULL) FROM events")
def _(spark, d):
    return C.cumulative_counts(table(spark, d, "events"), [("quality", F.col("value") >= 1), ("kind", F.col("event_type") != "error"), ("named", F.col("user_id").isNotNull())])


_CH = "[lower(trim(regexp_replace(x, '^\\s*[A-H][).]\\s+', ''), ' ')) FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '^\\s*[A-H][).]\\s')]"


@query("question_findings", f"WITH {ONCE}, q AS (SELECT id, text, {_CH} AS c, trim(regexp_split_to_array(text, '\\n\\s*[A-H][).]\\s')[1], ' ') AS stem FROM one WHERE chunk_type = 'assessment_item' AND text IS NOT NULL), f AS (SELECT id, unnest([x FOR x IN [CASE WHEN len(c) < 3 THEN 'few choices' END, CASE WHEN len(list_distinct(c)) < len(c) THEN 'equal choices' END, CASE WHEN length(stem) < 20 THEN 'short stem' END, CASE WHEN NOT contains(text, '?') THEN 'no question' END, CASE WHEN regexp_matches(lower(text), 'plausible distractor|correct answer based on content|\\btodo\\b|\\btbd\\b') THEN 'placeholder' END] IF x IS NOT NULL]) AS finding FROM q) SELECT id, finding FROM f")
def _(spark, d):
    return C.question_findings(_one(spark, d, "chunk_type", "text"))


@query("repeated_choices", f"WITH {ONCE}, q AS (SELECT id, unnest(list_distinct({_CH})) AS choice FROM one WHERE chunk_type = 'assessment_item' AND text IS NOT NULL) SELECT choice, count(*) AS n_questions FROM q GROUP BY choice HAVING count(*) > 1")
def _(spark, d):
    return C.choice_use(_one(spark, d, "chunk_type", "text")).where("n_questions > 1")


@query("merged_results", f"WITH {ONCE}, a AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, 0 AS s FROM one WHERE difficulty = 'advanced'), b AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, 1 AS s FROM one WHERE chunk_type = 'example'), u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY s, pos) = 1) SELECT id FROM u ORDER BY s, pos, id LIMIT 2000")
def _(spark, d):
    one = _one(spark, d, "difficulty", "chunk_type")
    # places are made by a range sort of ids, which is their order
    a, b = one.where("difficulty = 'advanced'").select("id", F.col("id").alias("pos")), one.where("chunk_type = 'example'").select("id", F.col("id").alias("pos"))
    return C.merge_lists(a, b, 2000).select("id")


@query("fallback_results")
def _(spark, d):
    one = _one(spark, d, "difficulty", "chunk_type", "bloom_level", "source", "content_type_label", "concept_tags", "learning_outcome_refs", "tokens_estimate")
    strict = one.where(R.chunk_filter(chunk_type="example", difficulty="advanced", bloom_level="create"))
    looser = one.where(R.chunk_filter(chunk_type="example", difficulty="advanced"))
    return C.first_strategy([x.select("id") for x in (strict, looser, one)], 30)


@query("definition_before_use", f"WITH {ONCE}, u AS (SELECT source.module_id AS module, source.position_in_module AS pos, trim(regexp_replace(lower(t), '[ \\t\\n\\r\\x{{A0}}_\\-\\x{{2010}}-\\x{{2013}}]+', '-', 'g'), '-') AS c FROM (SELECT source, unnest(concept_tags) AS t FROM one) WHERE t IS NOT NULL), df AS (SELECT source.module_id AS module, source.position_in_module AS pos, trim(regexp_replace(lower(k.term), '[ \\t\\n\\r\\x{{A0}}_\\-\\x{{2010}}-\\x{{2013}}]+', '-', 'g'), '-') AS c FROM (SELECT source, unnest(key_terms) AS k FROM one) WHERE k.term IS NOT NULL), a AS (SELECT module, c, min(pos) AS used FROM u WHERE c <> '' GROUP BY ALL), b AS (SELECT module, c, min(pos) AS defined FROM df WHERE c <> '' GROUP BY ALL) SELECT module, c AS concept, used, defined, used < defined AS violation FROM a JOIN b USING (module, c)")
def _(spark, d):
    one = _one(spark, d, "source", "concept_tags", "key_terms")
    at = lambda col, name: one.select(F.col("source.module_id").alias("module"), F.col("source.position_in_module").alias("pos"), F.explode(col).alias("t")).select("module", "pos", T.slug_item(F.col("t")).alias("concept")).where("concept <> ''").groupBy("module", "concept").agg(F.min("pos").alias(name))
    return at("concept_tags", "used").join(at("key_terms.term", "defined"), ["module", "concept"]).withColumn("violation", F.col("used") < F.col("defined"))


@query("evaluation_questions", f"WITH {ONCE} SELECT id, CASE WHEN len([t FOR t IN concept_tags IF t IS NOT NULL]) > 0 THEN 'tags' WHEN text IS NOT NULL AND trim(text, ' ') <> '' THEN 'text' ELSE 'title' END AS strategy, CASE WHEN len([t FOR t IN concept_tags IF t IS NOT NULL]) > 0 THEN array_to_string([t FOR t IN concept_tags IF t IS NOT NULL], ' ') WHEN text IS NOT NULL AND trim(text, ' ') <> '' THEN regexp_extract(trim(text, ' '), '(?s)^[^.!?]*[.!?]?', 0) ELSE source.lesson_title END AS question FROM one")
def _(spark, d):
    one = _one(spark, d, "concept_tags", "text", "source")
    tags = F.filter("concept_tags", lambda t: t.isNotNull())
    has_tags, has_text = F.coalesce(F.size(tags) > 0, F.lit(False)), F.col("text").isNotNull() & (F.trim("text") != "")
    strategy = F.when(has_tags, "tags").when(has_text, "text").otherwise("title")
    return one.select("id", strategy.alias("strategy"), F.when(has_tags, F.array_join(tags, " ")).when(has_text, F.regexp_extract(F.trim("text"), r"(?s)^[^.!?]*[.!?]?", 0)).otherwise(F.col("source.lesson_title")).alias("question"))


@query("course_validation", f"WITH {ONCE}, {_LO}, c AS (SELECT source.course_id AS course, count(*) AS chunks, avg((len(learning_outcome_refs) > 0 AND learning_outcome_refs IS NOT NULL)::INT) AS covered FROM one GROUP BY 1), n AS (SELECT course, count(*) AS outcomes FROM o GROUP BY 1) SELECT course, coalesce(outcomes, 0) AS outcomes, chunks, round(covered, 6) AS covered, coalesce(outcomes, 0) BETWEEN 10 AND 25 AND covered >= 0.5 AS valid FROM c LEFT JOIN n USING (course)")
def _(spark, d):
    c = _one(spark, d, "source", "learning_outcome_refs").groupBy(F.col("source.course_id").alias("course")).agg(F.count("*").alias("chunks"), F.avg(F.when(F.size("learning_outcome_refs") > 0, 1.0).otherwise(0.0)).alias("covered"))
    n = _outcomes(spark, d).groupBy("course").agg(F.count("*").alias("outcomes"))
    j = c.join(n, "course", "left").withColumn("outcomes", F.coalesce("outcomes", F.lit(0)))
    return j.select("course", "outcomes", "chunks", F.round("covered", 6).alias("covered"), (F.col("outcomes").between(10, 25) & (F.col("covered") >= 0.5)).alias("valid"))


@query("index_consistency", f"WITH {ONCE}, a AS (SELECT DISTINCT source.course_id AS course FROM one), b AS (SELECT course_code AS course FROM courses) SELECT coalesce(a.course, b.course) AS course, CASE WHEN a.course IS NULL THEN 'no chunks' ELSE 'not in the catalog' END AS problem FROM a FULL JOIN b ON a.course = b.course WHERE a.course IS NULL OR b.course IS NULL")
def _(spark, d):
    a = _one(spark, d, "source").select(F.col("source.course_id").alias("course")).distinct().withColumn("x", F.lit(1))
    b = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.lit(1).alias("y"))
    j = a.join(b, "course", "full_outer").where("x is null or y is null")
    return j.select("course", F.when(F.col("x").isNull(), "no chunks").otherwise("not in the catalog").alias("problem"))


@query("latest_runs", f"WITH {ONCE}, r AS (SELECT run_id, count(*) AS n FROM one GROUP BY run_id) SELECT run_id, n FROM r WHERE run_id IS NOT NULL ORDER BY run_id DESC LIMIT 10")
def _(spark, d):
    return _one(spark, d, "run_id").where("run_id is not null").groupBy("run_id").agg(F.count("*").alias("n")).orderBy(F.desc("run_id")).limit(10)


@query("last_state_of_users", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS last_type, max(ts) AS ts FROM events WHERE event_type <> 'error' GROUP BY user_id")
def _(spark, d):
    return table(spark, d, "events").where("event_type <> 'error'").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.max("ts").alias("ts"))


@query("key_value_lines")
def _(spark, d):
    return C.key_values(table(spark, d, "documents"), "doc_id", "text")


@query("formula_counts", "SELECT doc_id, (len(regexp_extract_all(text, '\\$[^$\\n]+\\$|\\\\\\([^\\n]+?\\\\\\)')) + len(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_]* = [^.,;\\n]{1,60}')))::INT AS n FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(C.formulas(F.col("text"))).alias("n"))


@query("canonical_terms", f"WITH {ONCE} SELECT id, len(regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), '(?i)\\bself-explanation\\b', 'SE1', 'g'), '(?i)\\bworking memory\\b', 'WM1', 'g'), 'SE1|WM1'))::INT AS n FROM one")
def _(spark, d):
    c = C.canonical_names(F.coalesce("text", F.lit("")), {"working memory": "WM1", "self-explanation": "SE1"})
    return _one(spark, d, "text").select("id", F.size(T.find_all(c, "SE1|WM1")).alias("n"))


@query("concept_weights", f"WITH {ONCE}, f AS (SELECT source.course_id AS course, t AS tag, count(*) AS n, count(DISTINCT id) AS df FROM (SELECT id, source, unnest(concept_tags) AS t FROM one) WHERE t IS NOT NULL GROUP BY ALL) SELECT course, tag, n, df, round(n / max(n) OVER (PARTITION BY course), 6) AS weight FROM f")
def _(spark, d):
    f = _one(spark, d, "source", "concept_tags").select("id", F.col("source.course_id").alias("course"), F.explode("concept_tags").alias("tag")).where("tag is not null").groupBy("course", "tag").agg(F.count("*").alias("n"), F.count_distinct("id").alias("df"))
    return f.withColumn("weight", F.round(F.col("n") / F.max("n").over(Window.partitionBy("course")), 6))


@query("block_roles", "WITH b AS (SELECT DISTINCT ON (block_id) block_id, coalesce(text, '') AS t, extractor_hint AS h FROM raw_blocks WHERE block_id IS NOT NULL) SELECT block_id, coalesce(nullif(replace(h, '_', ' '), ''), CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for p, n in O.BLOCK_RULES) + " ELSE 'paragraph' END) AS role FROM b")
def _(spark, d):
    b = table(spark, d, "raw_blocks").where("block_id is not null").dropDuplicates(["block_id"])
    return b.select("block_id", O.block_role(F.col("text"), F.col("extractor_hint")).alias("role"))


@query("teaching_roles", f"WITH {ONCE}, s AS (SELECT id, content_type_label AS a, chunk_type AS b, source.position_in_module = 0 AS f FROM one), r AS (SELECT *, coalesce(CASE a " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.ROLE_OF.items()) + " END, CASE b " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in O.ROLE_OF.items()) + " END, 'elaborate') AS role FROM s) SELECT id, CASE WHEN role = 'elaborate' AND coalesce(f, false) AND coalesce(a, b) = 'explanation' THEN 'introduce' ELSE role END AS role FROM r")
def _(spark, d):
    one = _one(spark, d, "content_type_label", "chunk_type", "source")
    return one.select("id", O.teaching_role(F.col("content_type_label"), F.col("chunk_type"), F.col("source.position_in_module") == 0).alias("role"))
