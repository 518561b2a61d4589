"""Queries of statistics, quality reports, order and boilerplate over the chunk tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from loomspark.functions import text as T
from loomspark.operators import aggregate as A, ngram_boilerplate as N, sequence as S
from loomspark.plans.registry import ONCE, query
from loomspark.tables import once_per_id, spread, table


def _one(spark, d, *cols):
    return once_per_id(table(spark, d, "chunks").select("id", *cols))


@query("corpus_statistics", f"""WITH {ONCE}, f AS (SELECT coalesce(chunk_type, 'unspecified') AS a, coalesce(difficulty, 'unspecified') AS b, coalesce(bloom_level, 'unspecified') AS c, tokens_estimate AS t FROM one)
SELECT CASE WHEN grouping(a) = 0 THEN 'chunk_type' WHEN grouping(b) = 0 THEN 'difficulty' WHEN grouping(c) = 0 THEN 'bloom_level' ELSE 'total' END AS dimension, coalesce(a, b, c, 'all') AS value, count(*) AS n, sum(t)::BIGINT AS tokens FROM f GROUP BY GROUPING SETS ((a), (b), (c), ())""")
def _(spark, d):
    return A.grouped_counts(_one(spark, d, "chunk_type", "difficulty", "bloom_level", "tokens_estimate"), ["chunk_type", "difficulty", "bloom_level"], {"tokens": F.col("tokens_estimate")})


@query("catalog_statistics", """SELECT CASE WHEN grouping(a) = 0 THEN 'division' WHEN grouping(b) = 0 THEN 'domain' ELSE 'total' END AS dimension, coalesce(a, b, 'all') AS value, count(*) AS n, sum(o)::BIGINT AS outcomes FROM (SELECT coalesce(division, 'unspecified') AS a, coalesce("domain", 'unspecified') AS b, coalesce(len(learning_outcomes), 0) AS o FROM courses) GROUP BY GROUPING SETS ((a), (b), ())""")
def _(spark, d):
    return A.grouped_counts(table(spark, d, "courses"), ["division", "domain"], {"outcomes": F.coalesce(F.size("learning_outcomes"), F.lit(0))})


@query("catalog_search", """SELECT course_code FROM courses WHERE contains(lower(title), 'the') OR "domain" = 'statistics' OR division = 'STEM'""")
def _(spark, d):
    return table(spark, d, "courses").where(F.contains(F.lower("title"), F.lit("the")) | (F.col("domain") == "statistics") | (F.col("division") == "STEM")).select("course_code")


@query("domain_index", """SELECT "domain", count(*) AS n, string_agg(course_code, ',' ORDER BY course_code) AS courses FROM courses WHERE "domain" IS NOT NULL GROUP BY "domain" """)
def _(spark, d):
    g = table(spark, d, "courses").where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("course_code")).alias("c"))
    return g.select("domain", "n", F.array_join("c", ",").alias("courses"))


@query("quality_report", f"""WITH {ONCE}, w AS (SELECT source.course_id AS course, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\x{{A0}}]+')) AS words, coalesce(len(concept_tags), 0) AS tags, bloom_level, coalesce(len(learning_outcome_refs), 0) AS refs FROM one),
g AS (SELECT course, count(*) AS n, avg((words BETWEEN 100 AND 800)::INT) AS size_ok, avg((tags > 0)::INT) AS tagged, avg((bloom_level IS NOT NULL)::INT) AS with_bloom, avg((refs > 0)::INT) AS with_outcome FROM w GROUP BY course)
SELECT course, n, round(size_ok, 6) AS size_ok, round(tagged, 6) AS tagged, round(with_bloom, 6) AS with_bloom, round(with_outcome, 6) AS with_outcome, round(0.25 * size_ok + 0.25 * tagged + 0.25 * with_bloom + 0.25 * with_outcome, 6) AS score FROM g""")
def _(spark, d):
    words = T.word_count(F.col("text"))
    rows = _one(spark, d, "text", "source", "concept_tags", "bloom_level", "learning_outcome_refs").groupBy(F.col("source.course_id").alias("course")).agg(
        F.count("*").alias("n"), *A.share_where(size_ok=words.between(100, 800), tagged=F.size("concept_tags") > 0, with_bloom=F.col("bloom_level").isNotNull(), with_outcome=F.size("learning_outcome_refs") > 0))
    names = ["size_ok", "tagged", "with_bloom", "with_outcome"]
    return rows.select("course", "n", *[F.round(c, 6).alias(c) for c in names], F.round(sum(F.col(c) * 0.25 for c in names), 6).alias("score"))


@query("flow_metrics", f"""WITH {ONCE} SELECT round(sum(len([k FOR k IN key_terms IF k.definition IS NOT NULL AND k.definition <> ''])) / sum(len(key_terms)), 6) AS defined_terms, round(avg((follows_chunk IS NOT NULL)::INT), 6) AS linked, round(avg((len(misconceptions) > 0 AND len(misconceptions) IS NOT NULL)::INT), 6) AS with_misconception, round(avg((content_type_label IS NOT NULL)::INT), 6) AS labelled FROM one""")
def _(spark, d):
    rows = _one(spark, d, "key_terms", "follows_chunk", "misconceptions", "content_type_label")
    defined = F.sum(F.size(F.filter("key_terms", lambda k: k["definition"].isNotNull() & (k["definition"] != "")))) / F.sum(F.size("key_terms"))
    shares = A.share_where(linked=F.col("follows_chunk").isNotNull(), with_misconception=F.size("misconceptions") > 0, labelled=F.col("content_type_label").isNotNull())
    out = rows.agg(defined.alias("defined_terms"), *shares)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_FIELDS = ["bloom_level", "content_type_label", "difficulty", "chunk_type"]


@query("enrichment_trace", f"WITH {ONCE}, u AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, coalesce({f}, 'missing') AS value FROM one" for f in _FIELDS) + ") SELECT field, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY field), 6) AS share FROM u GROUP BY field, value")
def _(spark, d):
    rows = _one(spark, d, *_FIELDS)
    long = rows.select("id", *[F.coalesce(f, F.lit("missing")).alias(f) for f in _FIELDS]).unpivot("id", _FIELDS, "field", "value")
    g = long.groupBy("field", "value").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("field")), 6))


_LEVELS = ["remember", "understand", "apply", "analyze", "evaluate", "create"]


@query("bloom_by_module", f"WITH {ONCE} SELECT source.module_id AS module, " + ", ".join(f"count(*) FILTER (bloom_level = '{x}') AS {x}" for x in _LEVELS) + " FROM one GROUP BY source.module_id")
def _(spark, d):
    rows = _one(spark, d, "source", "bloom_level")
    return rows.groupBy(F.col("source.module_id").alias("module")).pivot("bloom_level", _LEVELS).count().na.fill(0, _LEVELS)


@query("vocabulary_analysis", f"WITH {ONCE}, t AS (SELECT unnest(concept_tags) AS tag FROM one) SELECT count(*) AS total, count(DISTINCT tag) AS distinct_tags, count(*) FILTER (regexp_matches(tag, '^[a-z][a-z0-9]*(-[a-z0-9]+){{0,3}}$')) AS valid FROM t WHERE tag IS NOT NULL")
def _(spark, d):
    t = _one(spark, d, "concept_tags").select(F.explode("concept_tags").alias("tag")).where("tag is not null")
    return t.agg(F.count("*").alias("total"), F.count_distinct("tag").alias("distinct_tags"), F.count_if(F.col("tag").rlike("^[a-z][a-z0-9]*(-[a-z0-9]+){0,3}$")).alias("valid"))


@query("top_tags", f"WITH {ONCE}, t AS (SELECT unnest(concept_tags) AS tag FROM one) SELECT tag, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY tag ORDER BY n DESC, tag LIMIT 20")
def _(spark, d):
    t = _one(spark, d, "concept_tags").select(F.explode("concept_tags").alias("tag")).where("tag is not null")
    return t.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(20)


@query("tag_entropy", f"WITH {ONCE}, t AS (SELECT source.course_id AS course, difficulty FROM one WHERE difficulty IS NOT NULL), c AS (SELECT course, difficulty, count(*) AS c FROM t GROUP BY ALL), p AS (SELECT course, c / sum(c) OVER (PARTITION BY course) AS p FROM c) SELECT course, count(*) AS n_values, round(-sum(p * log2(p)), 6) AS entropy, round(CASE WHEN count(*) > 1 THEN -sum(p * log2(p)) / log2(count(*)) ELSE 0 END, 6) AS normalized FROM p GROUP BY course")
def _(spark, d):
    rows = _one(spark, d, "source", "difficulty").where("difficulty is not null").select(F.col("source.course_id").alias("course"), "difficulty")
    return A.entropy(rows, ["course"], "difficulty").withColumn("entropy", F.round("entropy", 6)).withColumn("normalized", F.round("normalized", 6))


@query("broken_outcome_refs", f"""WITH {ONCE}, r AS (SELECT id, source.course_id AS course, unnest(learning_outcome_refs) AS ref FROM one), o AS (SELECT course_code, lower(x.id) AS lo FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses)) SELECT DISTINCT id, ref FROM r WHERE ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM o WHERE o.course_code = r.course AND o.lo = lower(r.ref))""")
def _(spark, d):
    refs = _one(spark, d, "source", "learning_outcome_refs").select("id", F.col("source.course_id").alias("course"), F.explode("learning_outcome_refs").alias("ref")).where("ref is not null")
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).select("course", F.lower("x.id").alias("lo"))
    return refs.withColumn("lo", F.lower("ref")).join(o, ["course", "lo"], "left_anti").select("id", "ref").distinct()


@query("outcome_coverage", f"""WITH {ONCE}, r AS (SELECT DISTINCT source.course_id AS course, lower(x) AS lo FROM (SELECT source, unnest(learning_outcome_refs) AS x FROM one)), o AS (SELECT DISTINCT course_code AS course, lower(x.id) AS lo FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses)) SELECT o.course, count(*) AS outcomes, count(r.lo) AS covered, round(count(r.lo) / count(*), 6) AS share FROM o LEFT JOIN r ON r.course = o.course AND r.lo = o.lo GROUP BY o.course""")
def _(spark, d):
    r = _one(spark, d, "source", "learning_outcome_refs").select(F.col("source.course_id").alias("course"), F.explode("learning_outcome_refs").alias("x")).select("course", F.lower("x").alias("lo")).distinct().withColumn("hit", F.lit(1))
    o = table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).select("course", F.lower("x.id").alias("lo")).distinct()
    return o.join(r, ["course", "lo"], "left").groupBy("course").agg(F.count("*").alias("outcomes"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 6).alias("share"))


@query("uncovered_outcomes", f"""WITH {ONCE} SELECT course_code AS course, lower(x.id) AS lo FROM (SELECT course_code, unnest(learning_outcomes) AS x FROM courses) EXCEPT SELECT source.course_id, lower(r) FROM (SELECT source, unnest(learning_outcome_refs) AS r FROM one)""")
def _(spark, d):
    r = _one(spark, d, "source", "learning_outcome_refs").select(F.col("source.course_id").alias("course"), F.explode("learning_outcome_refs").alias("x")).select("course", F.lower("x").alias("lo"))
    return table(spark, d, "courses").select(F.col("course_code").alias("course"), F.explode("learning_outcomes").alias("x")).select("course", F.lower("x.id").alias("lo")).subtract(r)


@query("follows_violations", f"""WITH {ONCE} SELECT c.id, CASE WHEN p.id IS NULL THEN 'dangling' ELSE 'other lesson' END AS problem FROM one c LEFT JOIN one p ON c.follows_chunk = p.id WHERE c.follows_chunk IS NOT NULL AND (p.id IS NULL OR p.source.lesson_id IS DISTINCT FROM c.source.lesson_id)""")
def _(spark, d):
    c = _one(spark, d, "follows_chunk", F.col("source.lesson_id").alias("lesson"))
    p = c.select(F.col("id").alias("pid"), F.col("lesson").alias("plesson"))
    j = c.where("follows_chunk is not null").join(p, F.col("follows_chunk") == F.col("pid"), "left").where(F.col("pid").isNull() | ~F.col("plesson").eqNullSafe(F.col("lesson")))
    return j.select("id", F.when(F.col("pid").isNull(), "dangling").otherwise("other lesson").alias("problem"))


@query("chain_depths", f"""WITH RECURSIVE {ONCE}, c(id, root, depth) AS (SELECT id, id, 0 FROM one WHERE follows_chunk IS NULL OR follows_chunk NOT IN (SELECT id FROM one) UNION ALL SELECT o.id, c.root, c.depth + 1 FROM one o JOIN c ON o.follows_chunk = c.id) SELECT id, root, depth::BIGINT AS depth FROM c""")
def _(spark, d):
    return S.chain_depth(_one(spark, d, F.col("follows_chunk").alias("parent")))


@query("lesson_links", f"""WITH {ONCE} SELECT id, lag(id) OVER (PARTITION BY source.lesson_id ORDER BY source.position_in_module, id) AS follows, (row_number() OVER (PARTITION BY source.module_id ORDER BY source.position_in_module, id) - 1)::INT AS position FROM one""")
def _(spark, d):
    rows = _one(spark, d, "source")
    return S.link_and_number(rows, F.col("source.lesson_id"), F.col("source.module_id"), ["source.position_in_module", "id"]).select("id", "follows", "position")


@query("first_seen_concepts", f"""WITH {ONCE}, t AS (SELECT source.module_id AS module, source.position_in_module AS pos, id, unnest(list_distinct(concept_tags)) AS tag FROM one) SELECT module, tag, min(pos) AS first_pos, arg_min(id, (pos, id)) AS first_id, count(*) AS n FROM t GROUP BY module, tag""")
def _(spark, d):
    t = _one(spark, d, "source", "concept_tags").select(F.col("source.module_id").alias("module"), F.col("source.position_in_module").alias("pos"), "id", F.explode(F.array_distinct("concept_tags")).alias("tag")).where("tag is not null")
    return t.groupBy("module", "tag").agg(F.min("pos").alias("first_pos"), F.min_by("id", F.struct("pos", "id")).alias("first_id"), F.count("*").alias("n"))


@query("packed_lessons")
def _(spark, d):
    rows = _one(spark, d, "source", T.word_count(F.col("text")).alias("words"))
    g = rows.groupBy(F.col("source.lesson_id").alias("lesson")).agg(F.array_sort(F.collect_list(F.struct(F.col("source.position_in_module").alias("pos"), "id", "words"))).alias("x"))
    g = g.select("lesson", "x", S.pack_greedily(F.col("x.words"), 800).alias("g"))
    return g.select("lesson", F.explode(F.arrays_zip("x", "g")).alias("z")).select("lesson", F.col("z.x.id").alias("id"), F.col("z.x.words").alias("words"), F.col("z.g").alias("section"))


@query("type_runs", f"""WITH {ONCE}, c AS (SELECT id, source.module_id AS module, source.position_in_module AS pos, chunk_type, CASE WHEN chunk_type IS NOT DISTINCT FROM lag(chunk_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM one WINDOW w AS (PARTITION BY source.module_id ORDER BY source.position_in_module)) SELECT id, module, sum(c) OVER (PARTITION BY module ORDER BY pos)::BIGINT AS run FROM c""")
def _(spark, d):
    rows = _one(spark, d, "source", "chunk_type").select("id", F.col("source.module_id").alias("module"), F.col("source.position_in_module").alias("pos"), "chunk_type")
    return S.runs(rows, ["module"], "pos", F.col("chunk_type")).select("id", "module", "run")


@query("neighbour_context", "WITH b AS (SELECT DISTINCT ON (block_id) * FROM raw_blocks) SELECT block_id, length(lag(coalesce(text, ''), 1, '') OVER w)::INT AS before, length(lead(coalesce(text, ''), 1, '') OVER w)::INT AS after FROM b WINDOW w AS (PARTITION BY source_pdf ORDER BY block_no, block_id)")
def _(spark, d):
    b = table(spark, d, "raw_blocks").dropDuplicates(["block_id"]).withColumn("text", F.coalesce("text", F.lit("")))
    n = S.with_neighbours(b, ["source_pdf"], ["block_no", "block_id"], "text")
    return n.select("block_id", F.length("prev_text").alias("before"), F.length("next_text").alias("after"))


@query("median_font_sizes", "SELECT source_pdf, median(font_size) AS body_size, count(*) FILTER (is_bold) AS bold FROM text_spans GROUP BY source_pdf")
def _(spark, d):
    return table(spark, d, "text_spans").groupBy("source_pdf").agg(F.median("font_size").alias("body_size"), F.count_if("is_bold").alias("bold"))


_LN = "trim(regexp_replace(lower(line), '[0-9]+', '#', 'g'), ' ')"


@query("page_chrome", f"""WITH s AS (SELECT source_pdf, page, {_LN.replace('line', 'text')} AS form, row_number() OVER (PARTITION BY source_pdf, page ORDER BY span_no) AS a, row_number() OVER (PARTITION BY source_pdf, page ORDER BY span_no DESC) AS b FROM text_spans), n AS (SELECT source_pdf, count(DISTINCT page) AS pages FROM text_spans GROUP BY 1), e AS (SELECT source_pdf, form, count(DISTINCT page) AS on_pages FROM s WHERE (a <= 3 OR b <= 3) AND form <> '' GROUP BY ALL)
SELECT source_pdf, form, on_pages, pages FROM e JOIN n USING (source_pdf) WHERE pages >= 3 AND on_pages >= greatest(2, round_even(0.3 * pages, 0))""")
def _(spark, d):
    form = F.trim(F.regexp_replace(F.lower("text"), "[0-9]+", "#"))
    w = Window.partitionBy("source_pdf", "page")
    s = table(spark, d, "text_spans").select("source_pdf", "page", form.alias("form"), F.row_number().over(w.orderBy("span_no")).alias("a"), F.row_number().over(w.orderBy(F.desc("span_no"))).alias("b"))
    n = s.groupBy("source_pdf").agg(F.count_distinct("page").alias("pages"))
    e = s.where("(a <= 3 or b <= 3) and form <> ''").groupBy("source_pdf", "form").agg(F.count_distinct("page").alias("on_pages"))
    return e.join(n, "source_pdf").where((F.col("pages") >= 3) & (F.col("on_pages") >= F.greatest(F.lit(2), F.bround(F.lit(0.3) * F.col("pages")))))


_DOCGRAM = "w AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+') IF x <> ''] AS w FROM documents), g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)), f AS (SELECT gram, count(*) AS n_docs FROM g GROUP BY gram HAVING count(*) >= greatest(2, round_even(0.005 * (SELECT count(*) FROM documents), 0)))"


@query("repeated_ngrams", f"WITH {_DOCGRAM} SELECT gram, n_docs FROM f")
def _(spark, d):
    return N.repeated_ngrams(spread(table(spark, d, "documents").select("doc_id", "text")), n=8, share=0.005, id_col="doc_id")


@query("ngram_contamination", f"WITH {_DOCGRAM} SELECT round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents), 6) AS rate FROM g WHERE gram IN (SELECT gram FROM f)")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return N.contamination(docs, N.repeated_ngrams(docs, 8, 0.005, id_col="doc_id"), 8, id_col="doc_id").select(F.round("rate", 6).alias("rate"))


@query("boilerplate_issues", f"WITH {_DOCGRAM}, t AS (SELECT count(*) AS t FROM documents) SELECT gram, round(n_docs / t, 6) AS share, CASE WHEN n_docs / t >= 0.5 THEN 'high' ELSE 'medium' END AS severity FROM f, t WHERE n_docs / t > 0.006")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return N.boilerplate_issues(docs, N.repeated_ngrams(docs, 8, 0.005, id_col="doc_id"), 0.006).withColumn("share", F.round("share", 6))


@query("repeated_spans")
def _(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return N.spans(docs, N.repeated_ngrams(docs, 8, 0.005, id_col="doc_id"), 8, id_col="doc_id")


@query("duplicate_contents", "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id, (sum(length(text)) - max(length(text)))::BIGINT AS chars_saved FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(spark, d):
    h = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("hash"), "doc_id", F.length("text").alias("n_chars"))
    return h.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), (F.sum("n_chars") - F.max("n_chars")).alias("chars_saved")).where("n > 1")


@query("content_store_statistics", "WITH h AS (SELECT sha256(text) AS h, length(text) AS n FROM documents WHERE text IS NOT NULL) SELECT count(DISTINCT h) AS blobs, sum(n)::BIGINT AS chars, count(DISTINCT left(h, 2)) AS shards FROM h")
def _(spark, d):
    h = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    return h.agg(F.count_distinct("h").alias("blobs"), F.sum("n").alias("chars"), F.count_distinct(F.left("h", F.lit(2))).alias("shards"))


@query("stratified_sample")
def _(spark, d):
    rows = _one(spark, d, "chunk_type")
    n = rows.count()
    alloc = rows.groupBy("chunk_type").agg(F.greatest(F.lit(1), F.bround(F.count("*") * (100 / max(n, 1)))).cast("int").alias("k"))
    w = Window.partitionBy("chunk_type").orderBy(F.xxhash64("id", F.lit(42)), "id")
    return rows.join(alloc, "chunk_type").withColumn("r", F.row_number().over(w)).where("r <= k").select("id", "chunk_type")


@query("weeks_of_topics", "SELECT doc_id, least(ceil(row_number() OVER (PARTITION BY source ORDER BY doc_id) / 12), 8)::INT AS week FROM documents WHERE source IS NOT NULL")
def _(spark, d):
    return S.weeks_of(table(spark, d, "documents").where("source is not null"), ["source"], "doc_id", 8).select("doc_id", "week")


@query("key_concept_flags", f"""WITH {ONCE}, f AS (SELECT source.course_id AS course, t AS tag, count(*) AS n FROM (SELECT source, unnest(concept_tags) AS t FROM one) WHERE t IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY course ORDER BY n DESC, tag) AS k, count(*) OVER (PARTITION BY course) AS m FROM f) SELECT course, tag, n, k <= greatest(1, m // 5) AS is_key FROM r""")
def _(spark, d):
    f = _one(spark, d, "source", "concept_tags").select(F.col("source.course_id").alias("course"), F.explode("concept_tags").alias("tag")).where("tag is not null").groupBy("course", "tag").agg(F.count("*").alias("n"))
    w = Window.partitionBy("course")
    k = F.row_number().over(w.orderBy(F.desc("n"), "tag"))
    return f.withColumn("k", k).withColumn("m", F.count("*").over(w)).select("course", "tag", "n", (F.col("k") <= F.greatest(F.lit(1), F.floor(F.col("m") / 5))).alias("is_key"))


@query("median_difficulty", f"""WITH {ONCE}, b AS (SELECT source.module_id AS module, CASE bloom_level WHEN 'remember' THEN 1 WHEN 'understand' THEN 2 WHEN 'apply' THEN 3 WHEN 'analyze' THEN 4 WHEN 'evaluate' THEN 5 WHEN 'create' THEN 6 END AS w FROM one), l AS (SELECT module, list_sort(list(w)) AS l FROM b WHERE w IS NOT NULL GROUP BY module) SELECT module, l[len(l) // 2 + 1]::INT AS median FROM l""")
def _(spark, d):
    from loomspark.functions.scoring import BLOOM_WEIGHT

    w = F.create_map(*[F.lit(x) for kv in BLOOM_WEIGHT.items() for x in kv])[F.col("bloom_level")]
    rows = _one(spark, d, "source", "bloom_level").select(F.col("source.module_id").alias("module"), w.alias("w")).where("w is not null")
    return rows.groupBy("module").agg(A.upper_median("w", [1, 2, 3, 4, 5, 6]).alias("median"))


@query("merkle_root")
def _(spark, d):
    return A.merkle_root(table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "doc_id", "h")
