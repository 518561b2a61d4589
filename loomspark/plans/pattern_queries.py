"""Queries of what stands in texts, and of their cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import patterns as P, scoring, text as T
from loomspark.plans.registry import ONCE, query
from loomspark.plans.text_queries import _V
from loomspark.tables import once_per_id, table


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def _one(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


@query("text_misconceptions", "WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '" + P.MISCONCEPTION_OPENINGS[0] + "')) + len(regexp_extract_all(text, '" + P.MISCONCEPTION_OPENINGS[1] + "')) AS n FROM documents) SELECT doc_id, n > 0 AS found FROM x WHERE n IS NOT NULL")
def _(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", (F.size(P.misconceptions(F.col("text"))) > 0).alias("found"))


@query("text_objectives", f"SELECT doc_id, list_distinct([p FOR p IN [trim(x, ' ') FOR x IN flatten([regexp_split_to_array(trim(s, ' '), ',\\s*(?:and\\s+)?|\\band\\b') FOR s IN regexp_extract_all(text, '{P.OBJECTIVE_OPENING}', 1)])] IF length(p) BETWEEN 15 AND 280])::VARCHAR AS objectives FROM documents WHERE regexp_matches(text, '{P.OBJECTIVE_OPENING}')")
def _(spark, d):
    o = P.objectives(F.col("text"))
    return _docs(spark, d).where(F.col("text").rlike(P.OBJECTIVE_OPENING)).select("doc_id", F.concat(F.lit("["), F.array_join(o, ", "), F.lit("]")).alias("objectives"))


_ITEM = "'^\\s*(?:[-*+]|\\d+[.)])\\s+\\S'"


@query("list_procedures", f"WITH i AS (SELECT doc_id, [trim(regexp_replace(x, '^\\s*[-*+]\\s+', ''), ' ') FOR x IN string_split(text, chr(10)) IF regexp_matches(x, {_ITEM})] AS items FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(items)::INT AS items, len(items) > 0 AND len([x FOR x IN items IF regexp_matches(trim(x, ' '), '{P.ACTION}')]) * 2 >= len(items) AS procedure FROM i")
def _(spark, d):
    i = _docs(spark, d).where("text is not null").select("doc_id", P.list_items(F.col("text")).alias("items"))
    return i.select("doc_id", F.size("items").alias("items"), P.is_procedure(F.col("items")).alias("procedure"))


_MARKS = lambda marks: " + ".join(f"coalesce(regexp_matches(text, '{m}'), false)::INT" for m in marks)


@query("text_formats", f"SELECT doc_id, CASE WHEN {_MARKS(P.HTML_MARKS)} > {_MARKS(P.MARKDOWN_MARKS)} THEN 'html' ELSE 'markdown' END AS format FROM documents")
def _(spark, d):
    return _docs(spark, d).select("doc_id", P.detect_format(F.col("text")).alias("format"))


@query("cleaned_texts", "SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, 'ﬁ', 'fi'), 'ﬂ', 'fl'), chr(12), chr(10) || chr(10)), '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')) AS hash FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", F.sha2(P.clean_text(F.col("text")), 256).alias("hash"))


_URL = T.URL_RE


@query("linked_urls", f"SELECT doc_id, len(regexp_extract_all(text, '{_URL}'))::INT AS urls, length(regexp_replace(text, '({_URL})', '<a href=\"\\1\">\\1</a>', 'g'))::INT AS length FROM documents WHERE regexp_matches(text, '{_URL}')")
def _(spark, d):
    c = _docs(spark, d).where(F.col("text").rlike(_URL))
    return c.select("doc_id", F.size(T.find_all(F.col("text"), _URL)).alias("urls"), F.length(P.linkify(F.col("text"))).alias("length"))


_FORM = "trim(regexp_replace(lower(x), '[0-9]+', '#', 'g'), ' ')"


@query("blanked_lines", f"WITH b AS (SELECT DISTINCT ON (block_id) block_id, source_pdf, text FROM raw_blocks WHERE block_id IS NOT NULL AND text IS NOT NULL), f AS (SELECT source_pdf, {_FORM} AS form FROM (SELECT source_pdf, unnest(string_split(text, chr(10))) AS x FROM b) WHERE trim(x, ' ') <> '' GROUP BY ALL HAVING count(*) >= 5), g AS (SELECT source_pdf, list(form) AS forms FROM f GROUP BY 1) SELECT block_id, sha256(array_to_string([CASE WHEN trim(x, ' ') <> '' AND list_contains(coalesce(forms, []), {_FORM}) THEN '' ELSE x END FOR x IN string_split(text, chr(10))], chr(10))) AS hash FROM b LEFT JOIN g ON g.source_pdf IS NOT DISTINCT FROM b.source_pdf")
def _(spark, d):
    """Lines that stand five times or more in a file left empty; a file has few such forms."""
    b = table(spark, d, "raw_blocks").where("block_id is not null and text is not null").select("block_id", F.coalesce("source_pdf", F.lit("")).alias("file"), "text").dropDuplicates(["block_id"])
    each = b.select("file", F.explode(F.split("text", "\n", -1)).alias("x")).where(F.trim("x") != "").groupBy("file", F.trim(F.regexp_replace(F.lower("x"), "[0-9]+", "#")).alias("form")).agg(F.count("*").alias("n")).where("n >= 5")
    forms = each.groupBy("file").agg(F.collect_list("form").alias("forms"))
    return b.join(forms, "file", "left").select("block_id", F.sha2(P.blank_lines(F.col("text"), F.coalesce("forms", F.array().cast("array<string>"))), 256).alias("hash"))


_VERBS = "|".join(sorted({v for vs in scoring.BLOOM_VERBS.values() for v in vs}, key=lambda v: (-len(v), v)))


@query("bare_objectives", f"WITH o AS (SELECT DISTINCT x.statement AS statement FROM (SELECT unnest(learning_outcomes) AS x FROM courses) WHERE x.statement IS NOT NULL), s AS (SELECT statement, trim(regexp_replace(trim(regexp_replace(statement, '(?i)^(?:students?\\s+(?:will|should|can)\\s+(?:be\\s+able\\s+to\\s+)?)?', ''), ' '), '(?i)^(?:{_VERBS})\\s+', ''), ' ') AS bare FROM o) SELECT statement, CASE WHEN bare = '' THEN statement ELSE bare END AS bare FROM s")
def _(spark, d):
    o = table(spark, d, "courses").select(F.explode("learning_outcomes").alias("x")).select(F.col("x.statement").alias("statement")).where("statement is not null").distinct()
    return o.select("statement", P.strip_preamble(F.col("statement")).alias("bare"))


_S = "[trim(regexp_replace(s, '[ \\t\\n\\r\\x{A0}]+', ' ', 'g'), ' ') FOR s IN regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF trim(s, ' ') <> '']"


@query("review_questions", f"WITH {ONCE}, q AS (SELECT id, unnest(list_distinct([s FOR s IN {_S} IF suffix(s, '?')])) AS question FROM one) SELECT id, question, CASE " + " ".join(f"WHEN regexp_matches(lower(question), '\\b{v}\\b') THEN '{n}'" for v, n in _V) + " END AS level FROM q")
def _(spark, d):
    return _one(spark, d, "text").select("id", F.explode(P.review_questions(F.col("text"))).alias("q")).select("id", "q.*")


_PAT = ", ".join(f"struct_pack(n := {' + '.join(f'contains(low, {s!r})::INT' for s in signs)}, o := {-i}, name := '{n}')" for i, (n, signs) in enumerate(P.TEACHING_SIGNS.items()))


@query("teaching_patterns", f"WITH {ONCE}, p AS (SELECT id, list_max([{_PAT}]) AS best FROM (SELECT id, lower(coalesce(text, '')) AS low FROM one)) SELECT id, CASE WHEN best.n >= 2 THEN best.name ELSE 'direct_instruction' END AS pattern FROM p")
def _(spark, d):
    return _one(spark, d, "text").select("id", P.teaching_pattern(F.col("text")).alias("pattern"))


_COUNTS = {k: f"len(regexp_extract_all(lower(coalesce(text, '')), '\\b(?:{'|'.join(v)})\\b'))" for k, v in scoring.BLOOM_VERBS.items()}


@query("text_difficulty", f"""WITH {ONCE}, b AS (SELECT id, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+') AS w, greatest(len({_S}), 1) AS s, coalesce(len(key_terms), 0) AS kt, coalesce(len(concept_tags), 0) AS ct, {' + '.join(_COUNTS.values())} AS total, {' + '.join(f'{w} * {_COUNTS[k]}' for k, w in P.LEVEL_DIFFICULTY.items())} AS weighted FROM one),
m AS (SELECT *, len(w) AS n, list_sum([length(x) FOR x IN w]) AS chars FROM b)
SELECT id, round(CASE WHEN n = 0 THEN 0 ELSE least(1.0, greatest(0.0, 0.25 * (least(1.0, greatest(0.0, (chars / n - 4) / 4)) + kt / n * 5) / 2 + 0.25 * least(1.0, greatest(0.0, (n / s - 10) / 15)) + 0.25 * least(1.0, greatest(0.0, ct * 100 / n / 5)) + 0.25 * CASE WHEN total > 0 THEN weighted / total ELSE 0 END)) END, 6)::DOUBLE AS difficulty FROM m""")
def _(spark, d):
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    one = _one(spark, d, "text", "key_terms", "concept_tags")
    return one.select("id", F.round(P.difficulty(F.col("text"), size("key_terms"), size("concept_tags")), 6).cast("double").alias("difficulty"))


_DL = "CASE {} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.DIFFICULTY_OF_LEVEL.items()) + " END"


@query("difficulty_cascade", f"""WITH {ONCE}, wk AS (SELECT source.module_id AS m, bloom_level AS b, count(*) AS n FROM one WHERE bloom_level IS NOT NULL GROUP BY ALL), wm AS (SELECT m, arg_max(b, (n, b)) AS b FROM wk GROUP BY m),
x AS (SELECT id, lower(coalesce(text, '')) AS low, chunk_type, {_DL.format('one.bloom_level')} AS a, {_DL.format('wm.b')} AS w FROM one LEFT JOIN wm ON wm.m = source.module_id),
g AS (SELECT id, chunk_type, coalesce(a, w, CASE WHEN contains(low, 'basic') OR contains(low, 'introduction') OR contains(low, 'overview') OR contains(low, 'what is') OR contains(low, 'define') THEN 'foundational' WHEN contains(low, 'evaluate') OR contains(low, 'create') OR contains(low, 'design') OR contains(low, 'critique') OR contains(low, 'justify') THEN 'advanced' ELSE 'intermediate' END) AS got FROM x)
SELECT id, CASE WHEN coalesce(chunk_type IN ('overview', 'summary'), false) AND got = 'advanced' THEN 'intermediate' ELSE got END AS difficulty FROM g""")
def _(spark, d):
    """The chunk's own level, its module's most frequent one, then words."""
    one = _one(spark, d, "text", "bloom_level", "chunk_type", F.col("source.module_id").alias("m"))
    n = one.where("bloom_level is not null").groupBy("m", "bloom_level").agg(F.count("*").alias("n"))
    week = n.groupBy("m").agg(F.max_by("bloom_level", F.struct("n", "bloom_level")).alias("w"))
    return one.join(week, "m", "left").select("id", P.difficulty_cascade(F.col("bloom_level"), F.col("w"), F.lit(None).cast("string"), F.col("text"), F.col("chunk_type")).alias("difficulty"))


_LOW = [r"^(?:table of )?contents$|^(?:preface|foreword|acknowledge?ments?|copyright|index|glossary|bibliography|references|appendix(?: [a-z0-9]+)?|about the authors?|dedication|colophon)$", r"^by [a-z.' -]+$|^(?:page|p\.) ?\d+$|^[\d.\s]+$|^(?:try it|your turn|check your (?:understanding|answers)|think about it|activity|exercise|figure|table) ?[\d.]*:?$"]


@query("low_signal_headings", f"WITH {ONCE}, h AS (SELECT DISTINCT source.section_heading AS heading, lower(trim(source.section_heading, ' ')) AS h FROM one) SELECT heading, coalesce(h = '' OR " + " OR ".join("regexp_matches(h, '" + p.replace("'", "''") + "')" for p in _LOW) + " OR length(regexp_replace(h, '[^=+*/^<>∑√∫]', '', 'g')) * 4 >= length(h), true) AS low FROM h")
def _(spark, d):
    h = _one(spark, d, "source").select(F.col("source.section_heading").alias("heading")).distinct()
    return h.select("heading", P.low_signal_heading(F.col("heading")).alias("low"))


@query("salient_phrases", f"WITH {ONCE}, w AS (SELECT id, list_distinct([lower(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+(?: [A-Z][a-z]+)+')]) AS r0, [lower(x) FOR x IN regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]+(?: [A-Z][a-z]+)+')] AS r, [x FOR x IN regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{6,}}') IF x NOT IN ({', '.join(repr(x) for x in T.STOP_WORDS)})] AS ws FROM one), c AS (SELECT id, x, count(*) AS n FROM (SELECT id, unnest(ws) AS x FROM w) GROUP BY ALL), k AS (SELECT id, x, row_number() OVER (PARTITION BY id ORDER BY n DESC, x) AS k FROM c), t AS (SELECT id, list(x ORDER BY k) AS best FROM k WHERE k <= 5 GROUP BY id) SELECT w.id, len(r0)::INT AS runs, CASE WHEN len(r0) = 0 THEN array_to_string(best, '|') END AS words FROM w LEFT JOIN t USING (id)")
def _(spark, d):
    """Texts without title-case runs show their words' order."""
    runs = F.size(F.array_distinct(F.transform(T.find_all(F.col("text"), r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), lambda x: F.lower(x))))
    words = F.array_join(P.salient_phrases(F.col("text")), "|")
    return _one(spark, d, "text").select("id", runs.alias("runs"), F.when(runs == 0, F.nullif(words, F.lit(""))).alias("words"))


@query("false_claims")
def _(spark, d):
    """Counts that texts state wrongly; none of the driver's texts states one, a fixture tests it."""
    return _docs(spark, d).select("doc_id", F.explode(P.claims(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query("joined_urls")
def _(spark, d):
    """Texts in which a cut URL was joined, with how many characters went."""
    c = _docs(spark, d).where("text is not null").select("doc_id", "text", P.join_urls(F.col("text")).alias("t"))
    return c.where("t <> text").select("doc_id", (F.length("text") - F.length("t")).alias("removed"))


@query("linked_references")
def _(spark, d):
    return _docs(spark, d).where("text is not null").select("doc_id", (F.length(P.link_references(F.col("text"))) - F.length("text")).alias("added")).where("added > 0")
