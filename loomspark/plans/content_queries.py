"""Queries of chunking, extraction and markup over the text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import ids, text as T
from loomspark.operators import chunking as K, extraction as X
from loomspark.plans.registry import ONCE, query
from loomspark.session import shared_dir
from loomspark.sources import markup as M
from loomspark.streaming import decisions
from loomspark.tables import once_per_id, table


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _one(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


_S = "s AS (SELECT doc_id AS id, trim(regexp_replace(x, '[ \\t\\n\\r\\x{A0}]+', ' ', 'g'), ' ') AS s FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS x FROM documents) WHERE trim(x, ' ') <> '')"


@query("example_sentences", f"WITH {_S} SELECT id, count(*) AS n FROM s WHERE regexp_matches(s, '{X.EXAMPLE}') GROUP BY id")
def _(spark, d):
    return X.examples(_docs(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


@query("factual_statements", f"WITH {_S} SELECT id, count(DISTINCT s) AS n FROM s WHERE length(s) BETWEEN 20 AND 300 AND regexp_matches(s, '{X.FACT}') AND regexp_matches(s, '^[A-Z]') AND NOT suffix(s, '?') GROUP BY id")
def _(spark, d):
    return X.facts(_docs(spark, d)).groupBy("id").agg(F.count("*").alias("n"))


@query("text_relations", f"WITH {_S}, r AS (SELECT id, CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN {i}" for i, (_, p) in enumerate(X.RELATIONS)) + " END AS k, CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN struct_pack(relation := '{n}', l := regexp_extract(s, '{p}', 1), r := regexp_extract(s, '{p}', 2))" for n, p in X.RELATIONS) + " END AS h FROM s) SELECT DISTINCT id, h.relation AS relation, h.l AS \"left\", h.r AS \"right\" FROM r WHERE k IS NOT NULL")
def _(spark, d):
    return X.relations(_docs(spark, d))


@query("term_definitions", f"WITH {_S}, n AS (SELECT *, row_number() OVER () AS pos FROM s), h AS (SELECT id, pos, CASE " + " ".join(f"WHEN regexp_matches(s, '{p}') THEN struct_pack(t := regexp_extract(s, '{p}', 1), d := regexp_extract(s, '{p}', 2))" for p in X.DEFINITIONS) + " END AS h FROM n) SELECT id, h.t AS term, count(*) > 0 AS found FROM h WHERE h IS NOT NULL GROUP BY id, h.t")
def _(spark, d):
    return X.definitions(_docs(spark, d)).select("id", "term", F.lit(True).alias("found"))


@query("content_profiles", """WITH w AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w, lower(coalesce(text, '')) AS t FROM documents) SELECT id, len(w)::INT AS words, len([x FOR x IN w IF length(x) > 6])::INT AS long_words, len(regexp_extract_all(t, '\\bstep\\b|\\bfirst\\b|\\bthen\\b'))::INT AS procedural FROM w""")
def _(spark, d):
    p = X.content_profile(F.col("text"))
    return _docs(spark, d).select("id", p["words"].alias("words"), p["long_words"].alias("long_words"), F.regexp_count(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"\bstep\b|\bfirst\b|\bthen\b")).alias("procedural"))


@query("content_kinds")
def _(spark, d):
    p = X.content_profile(F.col("text"))
    return _docs(spark, d).select("id", p["kind"].alias("kind"), p["bloom_level"].alias("bloom_level"))


@query("chunk_summaries")
def _(spark, d):
    one = _one(spark, d, "text", F.col("key_terms.term").alias("terms"))
    return one.select("id", X.summary(F.col("text"), F.col("terms")).alias("summary"))


@query("negated_statements", f"WITH {ONCE}, m AS (SELECT id, unnest(misconceptions) AS m FROM one) SELECT id, m.misconception AS statement, CASE " + " ".join(f"WHEN regexp_matches(m.misconception, '\\b{v}\\b') THEN regexp_replace(m.misconception, '^(.*?)\\b{v}\\b', '\\1{v} not')" for v in ("is", "are", "can", "has")) + " ELSE m.misconception END AS negated FROM m WHERE m.misconception IS NOT NULL")
def _(spark, d):
    m = _one(spark, d, "misconceptions").select("id", F.explode("misconceptions").alias("m")).where("m.misconception is not null")
    return m.select("id", F.col("m.misconception").alias("statement"), X.negate(F.col("m.misconception")).alias("negated"))


@query("fill_in_blanks", f"WITH {ONCE}, k AS (SELECT id, unnest(key_terms) AS k, text FROM one) SELECT DISTINCT id, k.term AS term, substr(text, 1, position(lower(k.term) IN lower(text)) - 1) || '_____' || substr(text, position(lower(k.term) IN lower(text)) + length(k.term)) AS question FROM k WHERE k.term IS NOT NULL AND k.term <> '' AND text IS NOT NULL AND position(lower(k.term) IN lower(text)) > 0")
def _(spark, d):
    k = _one(spark, d, "key_terms", "text").select("id", "text", F.explode("key_terms").alias("k")).where("k.term is not null and k.term <> ''")
    return k.select("id", F.col("k.term").alias("term"), X.blank_out(F.col("text"), F.col("k.term")).alias("question")).where("question is not null").distinct()


@query("rebuilt_chunks")
def _(spark, d):
    """Chunks of the chunk table's own lessons, built anew from their sections."""
    one = _one(spark, d, "text", "source").where("text is not null")
    parsed = one.select(F.col("source.course_id").alias("course"), F.col("source.module_id").alias("module"), F.col("source.lesson_id").alias("lesson"), F.struct("source.position_in_module", "id").alias("pos"), F.col("source.section_heading").alias("heading"), "text")
    return K.build_chunks(parsed).select("id", "chunk_type", "word_count", "tokens_estimate", "follows_chunk")


@query("page_issues")
def _(spark, d):
    """Documents as pages: each paragraph a `p`, headings as marked."""
    html = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?m)^#\s+(.+)$", "<h1>$1</h1>"), r"(?m)^##\s+(.+)$", "<h2>$1</h2>")
    return M.page_issues(M.parse_html(_docs(spark, d).select("id", html.alias("html"))))


_LN = "ln AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL)"
_MD = f"""{_LN}, fm AS (SELECT a.id, min(b.i) AS stop FROM ln a JOIN ln b ON b.id = a.id AND b.i > 1 AND trim(b.line, ' \t\r') = '---' WHERE a.i = 1 AND trim(a.line, ' \t\r') = '---' GROUP BY a.id),
bd AS (SELECT ln.id, line, i FROM ln LEFT JOIN fm ON fm.id = ln.id WHERE stop IS NULL OR i > stop), fc AS (SELECT *, sum(regexp_matches(line, '^[ \\t]*```')::INT) OVER (PARTITION BY id ORDER BY i) AS fences FROM bd)"""


@query("markdown_blocks", f"WITH {_MD} SELECT id, count(*) AS headings FROM fc WHERE fences % 2 = 0 AND regexp_matches(line, '^#{{1,6}}[ \\t]+') GROUP BY id")
def _(spark, d):
    """Headings of all documents, those in code and front matter left out."""
    return M.parse_markdown(_docs(spark, d)).where("kind = 'heading'").groupBy("id").agg(F.count("*").alias("headings"))


@query("markdown_block_kinds")
def _(spark, d):
    return M.parse_markdown(_docs(spark, d)).groupBy("id", "kind").agg(F.count("*").alias("blocks"))


@query("streamed_event_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    """The events read as a stream to its end; the result is what a batch gives."""
    import uuid

    name = "counts_" + uuid.uuid4().hex
    state = f"{shared_dir(spark)}/loomspark/{name}"
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).format("parquet").option("pathGlobFilter", "events.parquet").load(d)
    q = decisions.phase_counts(stream, "event_type").writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("finalized_session", "SELECT count(DISTINCT event_type) AS logs, count(*) AS records, true AS valid FROM events")
def _(spark, d):
    """The events as one session: read to their end, chained, stored, and the stored chains verified."""
    import uuid

    from loomspark.operators import events as E

    ev = table(spark, d, "events")
    payload = ids.canonical_json({c: F.col(c) for c in ("event_id", "event_type", "user_id", "value")})
    name = f"{shared_dir(spark)}/loomspark/session-{uuid.uuid4().hex}"
    E.append_chain(ev.withColumn("payload", payload), "event_type", "event_id", "payload").write.parquet(f"{name}/in")
    stored = spark.read.parquet(f"{name}/in")
    stream = spark.readStream.schema(stored.schema).parquet(f"{name}/in")
    v = decisions.finalize(stream, f"{name}/log", f"{name}/state")
    return v.agg(F.count("*").alias("logs"), F.sum("n").alias("records"), F.bool_and("valid").alias("valid"))
