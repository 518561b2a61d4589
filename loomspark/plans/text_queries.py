"""Queries of text, score and id expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import ids, scoring, text as T
from loomspark.plans.registry import ONCE, query
from loomspark.tables import once_per_id, table

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_TOKENS = f"[t FOR t IN regexp_extract_all(lower(coalesce(text, '')), '{T.TOKEN_RE}') IF length(t) > 1 AND t NOT IN ({_STOP})]"
_WS = "[ \\t\\n\\r\\x{A0}]"


@query("tokens", f"SELECT doc_id, len({_TOKENS})::INT AS n_tokens, sha256(array_to_string({_TOKENS}, ' ')) AS tokens_hash FROM documents")
def _(spark, d):
    toks = T.tokenize(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(toks).alias("n_tokens"), F.sha2(F.concat_ws(" ", toks), 256).alias("tokens_hash"))


@query("reference_folding", "SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)\\b(sc)\\s+([0-9]+(?:\\.[0-9]+){0,2})\\b', 'sc-\\2', 'g'), '(?i)\\b(wcag)\\s+([0-9]+(?:\\.[0-9]+){0,2})\\b', 'wcag-\\2', 'g') AS folded FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.fold_references(F.col("text")).alias("folded"))


@query(
    "title_trigrams",
    """WITH w AS (SELECT course_code, unnest([x FOR x IN regexp_split_to_array(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), ' +') IF length(x) >= 3]) AS w FROM courses)
SELECT course_code, count(DISTINCT substr(w, i::INT, 3))::INT AS n_trigrams FROM (SELECT course_code, w, unnest(range(1, length(w) - 1)) AS i FROM w) GROUP BY course_code""",
)
def _(spark, d):
    tri = T.char_trigrams(F.col("title"))
    return table(spark, d, "courses").where(F.size(tri) > 0).select("course_code", F.size(tri).alias("n_trigrams"))


@query(
    "bigram_similarity_of_neighbours",
    f"""WITH {ONCE}, t AS (SELECT id, follows_chunk, [x FOR x IN regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')] AS w FROM one),
b AS (SELECT id, follows_chunk, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM t)
SELECT x.id, round(CASE WHEN len(list_distinct(list_concat(x.g, y.g))) = 0 THEN 0 ELSE len(list_intersect(x.g, y.g)) / len(list_distinct(list_concat(x.g, y.g))) END, 6) AS similarity
FROM b x JOIN b y ON x.follows_chunk = y.id""",
)
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "follows_chunk", "text"))
    g = F.array_distinct(T.ngrams(T.find_all(F.lower(F.coalesce("text", F.lit(""))), "[a-z0-9]+"), 2))
    one = one.select("id", "follows_chunk", g.alias("g"))
    before = one.select(F.col("id").alias("bid"), F.col("g").alias("h"))
    return one.join(before, F.col("follows_chunk") == F.col("bid")).select("id", F.round(T.jaccard(F.col("g"), F.col("h")), 6).alias("similarity"))


@query(
    "slugs",
    """SELECT course_code, trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-') AS canonical,
trim(regexp_replace(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', '-', 'g'), '-'), '-+', '-', 'g'), '-') AS rule,
trim(substr(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), 1, 50), '-') AS url FROM courses""",
)
def _(spark, d):
    t = F.col("title")
    return table(spark, d, "courses").select("course_code", T.canonical_slug(t).alias("canonical"), T.rule_slug(t).alias("rule"), T.url_slug(t).alias("url"))


@query(
    "tag_normalization",
    f"""WITH {ONCE}, s AS (SELECT DISTINCT x AS tag, trim(regexp_replace(regexp_replace(lower(x), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-') AS c FROM (SELECT unnest(concept_tags) AS x FROM one) WHERE x IS NOT NULL),
n AS (SELECT tag, array_to_string(([w FOR w IN string_split(c, '-') IF w <> ''])[1:4], '-') AS s FROM s)
SELECT tag, CASE WHEN regexp_matches(s, '^[a-z]') THEN s ELSE '' END AS normalized FROM n""",
)
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "concept_tags"))
    tags = one.select(F.explode("concept_tags").alias("tag")).where("tag is not null").distinct()
    return tags.select("tag", T.normalize_tag(F.col("tag")).alias("normalized"))


@query("sentence_counts", "SELECT doc_id, len([s FOR s IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(s, ' ') <> ''])::INT AS n_sentences FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.sentences(F.col("text"))).alias("n_sentences"))


@query("plain_text", f"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '{_WS}+', ' ', 'g'), ' ') AS plain FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.strip_tags(F.col("text")).alias("plain"))


@query("week_of_module", f"WITH {ONCE} SELECT id, try_cast(nullif(regexp_extract(source.module_title, '(?i)week[_\\-\\s]?([0-9]+)', 1), '') AS INT) AS title_week, try_cast(nullif(regexp_extract(source.module_id, '_w([0-9]+)$', 1), '') AS INT) AS id_week FROM one")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "source"))
    id_week = F.nullif(F.regexp_extract("source.module_id", "_w([0-9]+)$", 1), F.lit("")).cast("int")
    return one.select("id", T.week_number(F.col("source.module_title")).alias("title_week"), id_week.alias("id_week"))


@query("message_masks", "SELECT event_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(props), '" + "', '".join([]) + "[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}', '<uuid>', 'g'), '[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}:[0-9]{2}', '<timestamp>', 'g'), '[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}', '<ip>', 'g'), '/[a-z0-9_./-]+', '<path>', 'g'), '[0-9]{4,}', '<number>', 'g'), '[ \\t\\n\\r\\x{A0}]+', ' ', 'g')) AS masked FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", T.mask_message(F.col("props")).alias("masked"))


@query("entities", f"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{T.EMAIL_RE}')))::INT AS emails, len(list_distinct(regexp_extract_all(text, '{T.URL_RE}')))::INT AS urls, len(list_distinct(regexp_extract_all(text, '{T.PHONE_RE}')))::INT AS phones FROM documents WHERE text IS NOT NULL""")
def _(spark, d):
    e = T.entities(F.col("text"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", *[F.size(e[n]).alias(n) for n in ("emails", "urls", "phones")])


_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"


@query(
    "readability",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w, greatest(1, len([s FOR s IN regexp_split_to_array(coalesce(text, ''), '[.!?]+') IF trim(s, ' ') <> ''])) AS s FROM documents),
y AS (SELECT doc_id, len(w) AS n, s, list_sum([CASE WHEN length(x) <= 3 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN suffix(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END) END FOR x IN w]) AS y FROM w)
SELECT doc_id, n::INT AS words, coalesce(y, 0)::INT AS syllables, round(CASE WHEN n > 0 THEN greatest(0, least(100, 206.835 - 1.015 * (n / s) - 84.6 * (y / n))) ELSE 0 END, 4) AS flesch FROM y""",
)
def _(spark, d):
    words = T.find_all(F.lower(F.coalesce("text", F.lit(""))), "[a-z]+")
    parts = F.greatest(F.lit(1), F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "[.!?]+"), lambda s: F.trim(s) != "")))
    count = F.aggregate("w", F.lit(0), lambda a, w: a + scoring.syllables(w))
    rows = table(spark, d, "documents").select("doc_id", words.alias("w"), parts.alias("s")).select("doc_id", F.size("w").alias("words"), "s", count.alias("syllables"))
    return rows.select("doc_id", "words", "syllables", F.round(scoring.flesch(F.col("words"), F.col("s"), F.col("syllables")), 4).alias("flesch"))


_B = {k: r"\b(?:" + "|".join(v) + r")\b" for k, v in scoring.BLOOM_VERBS.items()}


@query("bloom_verbs", f"WITH {ONCE} SELECT id, " + ", ".join(f"len(regexp_extract_all(lower(coalesce(text, '')), '{p}'))::INT AS n_{k}" for k, p in _B.items()) + " FROM one")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "text"))
    return one.select("id", *[c.alias(f"n_{k}") for k, c in scoring.bloom_counts(F.col("text")).items()])


_V = sorted(((v, level) for level, vs in scoring.BLOOM_VERBS.items() for v in vs), key=lambda x: (-len(x[0]), -scoring.BLOOM_WEIGHT[x[1]], x[0]))


@query(
    "bloom_detection",
    "WITH o AS (SELECT course_code, unnest(learning_outcomes) AS o FROM courses), l AS (SELECT course_code, o.id AS lo_id, CASE " + " ".join(f"WHEN regexp_matches(lower(o.statement), '\\b{v}\\b') THEN '{level}'" for v, level in _V) + " END AS level FROM o) SELECT course_code, lo_id, level, CASE level " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in scoring.BLOOM_DOMAIN.items()) + " END AS domain FROM l",
)
def _(spark, d):
    o = table(spark, d, "courses").select("course_code", F.explode("learning_outcomes").alias("o"))
    o = o.select("course_code", F.col("o.id").alias("lo_id"), scoring.detect_bloom(F.col("o.statement")).alias("level"))
    return o.withColumn("domain", scoring.bloom_to_domain(F.col("level")))


@query("token_estimates", f"WITH {ONCE} SELECT id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x{{A0}}]+'))::BIGINT AS words, (len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x{{A0}}]+')) * 13 // 10)::BIGINT AS tokens FROM one")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "text"))
    words = T.word_count(F.col("text")).cast("long")
    return one.select("id", words.alias("words"), scoring.token_estimate(words).alias("tokens"))


@query("chunk_ids", f"WITH {ONCE} SELECT id, lower(source.course_id) || '_chunk_' || left(sha256(coalesce(text, '') || '|' || source.lesson_id || '|v4'), 16) AS minted, left(sha256(coalesce(source.position_in_module, 0)::VARCHAR || ':' || coalesce(text, '')), 16) AS block_hash FROM one")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "text", "source"))
    t = F.coalesce("text", F.lit(""))
    minted = ids.chunk_id(F.concat(F.lower("source.course_id"), F.lit("_chunk_")), t, F.col("source.lesson_id"))
    return one.select("id", minted.alias("minted"), ids.block_id(t, F.coalesce("source.position_in_module", F.lit(0))).alias("block_hash"))


@query(
    "misconception_entities",
    f"""WITH {ONCE}, m AS (SELECT id, unnest(misconceptions) AS m, concept_tags[1] AS concept FROM one),
h AS (SELECT id, m.misconception AS misconception, m.correction AS correction, concept, 'mc_' || left(sha256(lower(trim(m.misconception)) || '|' || lower(trim(coalesce(m.correction, '')))), 16) AS mc_id FROM m WHERE m.misconception IS NOT NULL)
SELECT mc_id, misconception, correction, concept, id AS chunk_id FROM h QUALIFY row_number() OVER (PARTITION BY mc_id ORDER BY id, misconception, correction) = 1""",
)
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "misconceptions", "concept_tags"))
    m = one.select("id", F.explode("misconceptions").alias("m"), F.get("concept_tags", F.lit(0)).alias("concept")).where("m.misconception is not null")
    m = m.select(F.col("id").alias("chunk_id"), "m.misconception", "m.correction", "concept", ids.misconception_id(F.col("m.misconception"), F.col("m.correction")).alias("mc_id"))
    first = F.min_by(F.struct("misconception", "correction", "concept", "chunk_id"), F.struct("chunk_id", "misconception", F.coalesce("correction", F.lit("￿"))))
    return m.groupBy("mc_id").agg(first.alias("r")).select("mc_id", "r.*")


@query("rationale_quality", "WITH r AS (SELECT doc_id, text, lower(text) AS t, coalesce(length(text), 0) AS n FROM documents), s AS (SELECT doc_id, n, least(0.3, n / 300) + least(0.4, (" + " + ".join(f"contains(t, '{w}')::INT" for w in scoring.REASONING) + ") * 0.05) + (" + " + ".join("(" + " OR ".join(f"contains(t, '{w}')" for w in g) + ")::INT" for g in scoring.PEDAGOGY) + ") * 0.05 AS s FROM r) SELECT doc_id, round(CASE WHEN n > 0 THEN least(1, s) ELSE 0 END, 4) AS depth, CASE WHEN n >= 100 AND doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'exemplary' WHEN n >= 50 AND (doc_id % 2 = 0 OR doc_id % 3 = 0) THEN 'proficient' WHEN n >= 20 OR (doc_id % 5 = 0 AND n > 0) THEN 'developing' ELSE 'inadequate' END AS level FROM s")
def _(spark, d):
    n = F.coalesce(F.length("text"), F.lit(0))
    level = scoring.quality_level(n, F.col("doc_id") % 2 == 0, F.col("doc_id") % 3 == 0, F.col("doc_id") % 5 == 0)
    return table(spark, d, "documents").select("doc_id", F.round(scoring.rationale_depth(F.col("text")), 4).alias("depth"), level.alias("level"))


@query("resource_classes", "SELECT DISTINCT source.section_heading AS heading, CASE " + " ".join(f"WHEN regexp_matches(lower(source.section_heading), '{p}') THEN '{n}'" for p, n in ids.HEADINGS) + " ELSE 'explanation' END AS kind FROM chunks WHERE source.section_heading IS NOT NULL")
def _(spark, d):
    h = table(spark, d, "chunks").select(F.col("source.section_heading").alias("heading")).where("heading is not null").distinct()
    return h.select("heading", ids.first_match(F.col("heading"), ids.HEADINGS, "explanation").alias("kind"))


@query("course_codes", "SELECT course_code, CASE WHEN length(regexp_extract(title, '([A-Za-z]+)', 1)) >= 2 THEN upper(regexp_extract(title, '([A-Za-z]+)', 1)) ELSE rpad(upper(regexp_extract(title, '([A-Za-z]+)', 1)), 2, 'X') END || '_' || lpad(left(regexp_extract(title, '([0-9]+)', 1), 3), 3, '0') AS code, regexp_matches(course_code, '^[A-Z]{2,}-[0-9]{2,}$') AS is_lo_id FROM courses")
def _(spark, d):
    return table(spark, d, "courses").select("course_code", ids.course_code(F.col("title")).alias("code"), ids.valid_lo_id(F.col("course_code")).alias("is_lo_id"))


@query("retry_delays", "SELECT DISTINCT o_orderpriority, left(o_orderpriority, 1)::INT AS attempt, least(60.0, pow(2.0, left(o_orderpriority, 1)::INT)) AS delay FROM orders")
def _(spark, d):
    a = F.left("o_orderpriority", F.lit(1)).cast("int")
    return table(spark, d, "orders").select("o_orderpriority", a.alias("attempt"), scoring.backoff(a).alias("delay")).distinct()


@query("key_term_text", f"WITH {ONCE} SELECT id, array_to_string([coalesce(x.term, '') || ' ' || coalesce(x.definition, '') FOR x IN key_terms], ' ') AS terms FROM one WHERE len(key_terms) > 0")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "key_terms")).where(F.size("key_terms") > 0)
    return one.select("id", F.array_join(F.transform("key_terms", lambda x: F.concat(F.coalesce(x["term"], F.lit("")), F.lit(" "), F.coalesce(x["definition"], F.lit("")))), " ").alias("terms"))
