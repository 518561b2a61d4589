"""Queries of event logs, joins, leaks and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomspark.functions import ids, text as T
from loomspark.operators import aggregate as A, events as E, joins as J, training as X
from loomspark.plans.registry import ONCE, query
from loomspark.tables import once_per_id, spread, table


def _events(spark, d):
    return table(spark, d, "events")


@query("trailing_failures", "SELECT event_id, count(*) OVER (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 300 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def _(spark, d):
    return E.trailing_count(_events(spark, d), ["event_type", "user_id"], "ts", 300).select("event_id", "recent")


@query("error_summary", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_tasks, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY event_type")
def _(spark, d):
    return E.error_summary(_events(spark, d), "event_type", "ts", "user_id")


@query("silent_workers", "WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events) SELECT user_id, last_seen FROM l, n WHERE epoch_us(now) - epoch_us(last_seen) > 86400 * 1000000::BIGINT")
def _(spark, d):
    ev = _events(spark, d)
    now = F.lit(ev.agg(F.max("ts")).first()[0])
    return E.silent_since(ev, "user_id", "ts", now, 86400).select("user_id", "last_seen")


@query("user_sessions", "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800 * 1000000::BIGINT THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts)::BIGINT AS session FROM g) SELECT user_id, session, count(*) AS n, min(ts) AS start, max(ts) AS \"end\" FROM s GROUP BY ALL")
def _(spark, d):
    return E.sessions(_events(spark, d), "user_id", "ts", 1800)


@query("event_rate", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    return _events(spark, d).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


@query("decision_counts", "SELECT event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY event_type")
def _(spark, d):
    from pyspark.sql import Window

    g = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


@query("value_distribution", "SELECT event_type, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS p75 FROM events GROUP BY event_type")
def _(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = _events(spark, d).groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), q.alias("q"))
    return g.select("event_type", *[F.round(c, 6).alias(c) for c in ("low", "high", "mean")], *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p25", "median", "p75"))])


@query("phase_completeness", "WITH m(phase, minimum) AS (VALUES ('click', 100), ('view', 100), ('purchase', 100000), ('absent', 1)), g AS (SELECT event_type AS phase, count(*) AS n, avg(CASE WHEN value >= 1 THEN 0.0 ELSE 1.0 END) AS b FROM events GROUP BY 1) SELECT phase, minimum, coalesce(n, 0) AS n, round(coalesce(b, 0), 6) AS inadequate_share, coalesce(n, 0) >= minimum AND coalesce(b, 0) <= 0.2 AS complete FROM m LEFT JOIN g USING (phase)")
def _(spark, d):
    minima = spark.createDataFrame([("click", 100), ("view", 100), ("purchase", 100000), ("absent", 1)], "phase string, minimum int")
    return A.completeness(_events(spark, d), "event_type", minima, F.col("value") >= 1).withColumn("inadequate_share", F.round("inadequate_share", 6))


@query("distinct_decisions", "SELECT event_id, left(sha256(event_type || chr(31) || user_id::VARCHAR || chr(31) || left(coalesce(props, ''), 100)), 12) AS content_hash FROM events QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY ts, event_id) = 1")
def _(spark, d):
    return E.first_records(_events(spark, d), [F.col("event_type"), F.col("user_id"), F.left(F.coalesce("props", F.lit("")), F.lit(100))], ["ts", "event_id"]).select("event_id", "content_hash")


@query("error_classes", "SELECT event_id, CASE " + " ".join(f"WHEN regexp_matches(lower(props), '{p}') THEN '{n}'" for p, n in ids.ERRORS) + " ELSE 'unknown' END AS class, left(sha256(event_type || ':' || coalesce(props, '')), 16) AS pattern FROM events")
def _(spark, d):
    return _events(spark, d).select("event_id", ids.first_match(F.col("props"), ids.ERRORS, "unknown").alias("class"), ids.pattern_hash(F.col("event_type"), F.coalesce("props", F.lit(""))).alias("pattern"))


@query("hash_chain_verification")
def _(spark, d):
    ev = _events(spark, d).withColumn("payload", ids.canonical_json({c: F.col(c) for c in ("event_id", "event_type", "user_id", "value")}))
    return E.verify_chain(E.append_chain(ev, "event_type", "event_id", "payload"))


@query("run_difference", "WITH a AS (SELECT user_id, count(*) AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT user_id, count(*) AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(a.user_id, b.user_id) AS user_id, a.v AS before, b.v AS after, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' WHEN a.v = b.v THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b ON a.user_id = b.user_id")
def _(spark, d):
    """Two runs' counts compared; the two halves of the log stand for the runs, together the whole table."""
    ev = _events(spark, d)
    half = lambda k: ev.where(F.col("event_id") % 2 == k).groupBy("user_id").agg(F.count("*").alias("v"))
    return E.full_diff(half(0), half(1), ["user_id"], "v")


@query("interval_join", "SELECT o_orderkey, i.band FROM orders JOIN (SELECT b AS band, b * 5000.0 AS low, b * 5000.0 + 7500.0 AS high FROM range(0, 120) r(b)) i ON o_totalprice >= low AND o_totalprice <= high")
def _(spark, d):
    bands = spark.range(120).select(F.col("id").alias("band"), (F.col("id") * 5000.0).alias("low"), (F.col("id") * 5000.0 + 7500.0).alias("high"), F.lit(1).alias("k"))
    return J.interval_join(table(spark, d, "orders").withColumn("k", F.lit(1)), bands, "o_totalprice", "low", "high", ["k"], 10_000).select("o_orderkey", "band")


@query("block_spans", """WITH b AS (SELECT DISTINCT ON (block_id) source_pdf, page, block_id, bbox[2] AS b0, bbox[4] AS b1 FROM raw_blocks WHERE bbox IS NOT NULL AND page IS NOT NULL), j AS (SELECT block_id, span_id, least(b1, s.bbox[4]) - greatest(b0, s.bbox[2]) AS overlap, s.bbox[2] AS s0 FROM b JOIN text_spans s USING (source_pdf, page))
SELECT block_id AS block, arg_max(span_id, (overlap, -s0)) AS span, max(overlap) AS overlap FROM j WHERE overlap > 0 GROUP BY block_id""")
def _(spark, d):
    y = lambda i: F.get("bbox", F.lit(i))
    b = table(spark, d, "raw_blocks").where("bbox is not null and page is not null").dropDuplicates(["block_id"]).select("source_pdf", "page", F.col("block_id").alias("block"), y(1).alias("y0"), y(3).alias("y1"))
    s = table(spark, d, "text_spans").select("source_pdf", "page", F.col("span_id").alias("span"), y(1).alias("y0"), y(3).alias("y1"))
    return J.best_overlap(b, s, ["source_pdf", "page"]).select("block", "span", "overlap")


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _w(c: str) -> str:
    return f"[t FOR t IN regexp_extract_all(lower(coalesce({c}, '')), '{T.TOKEN_RE}') IF length(t) > 1 AND t NOT IN ({_STOP})]"



@query("outcome_links", f"""WITH {ONCE}, t AS (SELECT source.course_id AS course, id, {_w('text')} AS w FROM one), o AS (SELECT course_code AS course, x.id AS target, {_w('x.statement')} AS w FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses) WHERE x.id IS NOT NULL),
n AS (SELECT course, count(*) AS n FROM o GROUP BY 1), tf AS (SELECT course, target, l, term, count(*) AS tf FROM (SELECT course, target, len(w) AS l, unnest(w) AS term FROM o) GROUP BY ALL), idf AS (SELECT course, term, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tf JOIN n USING (course) GROUP BY course, term, n),
w2 AS (SELECT course, target, term, tf / l * idf AS w2 FROM tf JOIN idf USING (course, term)), n2 AS (SELECT course, target, sqrt(sum(w2 * w2)) AS n2 FROM w2 GROUP BY ALL),
tt AS (SELECT course, id, l, term, count(*) AS tf FROM (SELECT course, id, len(w) AS l, unnest(w) AS term FROM t) GROUP BY ALL), w1 AS (SELECT course, id, term, tf / l * idf AS w1 FROM tt JOIN idf USING (course, term)), n1 AS (SELECT course, id, sqrt(sum(w1 * w1)) AS n1 FROM w1 GROUP BY ALL),
s AS (SELECT course, id, target, round(sum(w1 * w2) / (n1 * n2), 9) AS s FROM w1 JOIN w2 USING (course, term) JOIN n1 USING (course, id) JOIN n2 USING (course, target) GROUP BY course, id, target, n1, n2)
SELECT course, id, target, round(s, 6) AS similarity FROM s WHERE s >= 0.15 QUALIFY row_number() OVER (PARTITION BY course, id ORDER BY s DESC, target) <= 3""")
def _(spark, d):
    t = once_per_id(spread(table(spark, d, "chunks").select("id", "text", "source"))).select(F.col("source.course_id").alias("course"), "id", T.tokenize(F.coalesce("text", F.lit(""))).alias("toks"))
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).where("x.id is not null").select("course", F.col("x.id").alias("target"), T.tokenize(F.coalesce("x.statement", F.lit(""))).alias("toks"))
    return J.tfidf_links(t, o, ["course"]).withColumn("similarity", F.round("similarity", 6))


_ANS = f"a AS (SELECT DISTINCT id AS question, trim(regexp_replace(regexp_replace(lower(m.correction), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS answer_norm FROM (SELECT id, unnest(misconceptions) AS m FROM one) WHERE m.correction IS NOT NULL AND length(trim(m.correction)) >= 3)"


def _answers(spark, d):
    m = once_per_id(table(spark, d, "chunks").select("id", "misconceptions")).select("id", F.explode("misconceptions").alias("m"))
    return J.register_answers(m.select("id", F.col("m.correction").alias("answer")).where("answer is not null"), "id", "answer")


def _prompts(spark, d):
    """Texts of the corpus, and of chunks that quote their own correction."""
    one = once_per_id(table(spark, d, "chunks").select("id", "text", "misconceptions"))
    return one.select("id", F.concat_ws("\n", "text", F.get(F.col("misconceptions.correction"), F.lit(0))).alias("text"))


_PR = "p AS (SELECT id, CASE WHEN text IS NULL THEN coalesce(misconceptions[1].correction, '') WHEN misconceptions[1].correction IS NULL THEN text ELSE text || chr(10) || misconceptions[1].correction END AS text FROM one)"


@query("exact_answer_leaks", f"""WITH {ONCE}, {_ANS}, {_PR}, s AS (SELECT DISTINCT id, trim(regexp_replace(regexp_replace(lower(trim(x, ' ')), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g'), ' ') AS n FROM (SELECT id, unnest(regexp_split_to_array(text, '[.!?\\n;•]+')) AS x FROM p) WHERE length(trim(x, ' ')) >= 10) SELECT DISTINCT s.id, a.question FROM s JOIN a ON s.n = a.answer_norm WHERE a.answer_norm <> ''""")
def _(spark, d):
    return J.exact_leaks(_prompts(spark, d), _answers(spark, d))


@query("contained_answer_leaks")
def _(spark, d):
    return J.contained_leaks(_prompts(spark, d), _answers(spark, d))


@query("instruction_pairs", f"""WITH {ONCE}, r AS (SELECT id, 'From the course material: ' || replace(CASE bloom_level {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TEMPLATES.items())} ELSE '{X.TEMPLATES['understand']}' END, '{{0}}', regexp_replace(coalesce(concept_tags[1], source.section_heading, 'this topic'), '[-_]+', ' ', 'g')) AS prompt, regexp_extract(left(coalesce(text, ''), 600), '(?s)^(.*[.!?])', 1) AS completion FROM one WHERE len(learning_outcome_refs) > 0)
SELECT id, prompt, length(completion)::INT AS completion_length, CASE WHEN NOT length(prompt) BETWEEN 40 AND 400 THEN 'prompt length' WHEN NOT length(completion) BETWEEN 50 AND 600 THEN 'completion length' WHEN len([i FOR i IN range(1, length(prompt) - 48) IF contains(completion, substr(prompt, i::INT, 50))]) > 0 THEN 'leak' END AS reason FROM r""")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "text", "source", "bloom_level", "concept_tags", "learning_outcome_refs"))
    return X.instruction_pairs(X.eligible(one)).select("id", "prompt", F.length("completion").alias("completion_length"), "reason")


@query("preference_pairs", f"""WITH {ONCE}, m AS (SELECT id, m.misconception AS rejected, m.correction AS chosen FROM (SELECT id, unnest(misconceptions) AS m FROM one) WHERE m.misconception IS NOT NULL AND m.correction IS NOT NULL), s AS (SELECT *, list_distinct(regexp_extract_all(lower(chosen), '[a-z0-9]+')) AS a, list_distinct(regexp_extract_all(lower(rejected), '[a-z0-9]+')) AS b FROM m)
SELECT id, 'Is this right? ' || rejected AS prompt, chosen, rejected, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS similarity FROM s WHERE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) <= 0.7""")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "misconceptions"))
    return X.preference_pairs(one).withColumn("similarity", F.round("similarity", 6))


@query("synthesis_reasons", f"""WITH {ONCE}, r AS (SELECT id, length(regexp_extract(left(coalesce(text, ''), 600), '(?s)^(.*[.!?])', 1)) AS n FROM one WHERE len(learning_outcome_refs) > 0) SELECT CASE WHEN n BETWEEN 50 AND 600 THEN 'kept' ELSE 'completion length' END AS reason, count(*) AS n FROM r GROUP BY 1""")
def _(spark, d):
    one = once_per_id(table(spark, d, "chunks").select("id", "text", "source", "bloom_level", "concept_tags", "learning_outcome_refs"))
    return X.instruction_pairs(X.eligible(one)).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


_J = lambda c: f"to_json({c})::VARCHAR"


@query("chat_records", f"""WITH {ONCE}, m AS (SELECT id, unnest(misconceptions) AS m FROM one) SELECT id, sha256('{{"messages":[{{"role":"system","content":"Answer from the course."}},{{"role":"user","content":' || {_J('m.misconception')} || '}},{{"role":"assistant","content":' || {_J('m.correction')} || '}}]}}') AS record_hash FROM m WHERE m.misconception IS NOT NULL AND m.correction IS NOT NULL""")
def _(spark, d):
    """A record for every misconception."""
    one = once_per_id(table(spark, d, "chunks").select("id", "misconceptions")).select("id", F.explode("misconceptions").alias("m")).where("m.misconception is not null and m.correction is not null")
    return one.select("id", F.sha2(X.chat(F.lit("Answer from the course."), F.col("m.misconception"), F.col("m.correction")), 256).alias("record_hash"))


@query("export_filter", "SELECT event_type, count(*) AS n FROM events WHERE value >= 1 AND event_type IN ('click', 'view') GROUP BY event_type")
def _(spark, d):
    rank = F.floor("value")
    return _events(spark, d).where(X.passes(rank, 1, F.col("event_type"), ["click", "view"])).groupBy("event_type").agg(F.count("*").alias("n"))


# plain relational checks of the wider tables: grouping sets, semi and anti joins, set operations


@query("nation_revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(spark, d):
    li, o, c, n = (table(spark, d, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("customers_without_orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def _(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")
