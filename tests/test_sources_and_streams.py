import json
import zipfile

from pyspark.sql import functions as F

from loomspark.operators import events as E, extraction as X
from loomspark.sources import markup as M, readers as R, writers as W
from loomspark.streaming import decisions as D


def test_chunk_lines_and_arrays(spark, tmp_path):
    d = tmp_path / "course-a" / "corpus"
    d.mkdir(parents=True)
    (d / "chunks.jsonl").write_text('{"id": "1", "text": "t", "source": {"course_id": "A"}, "concept_tags": ["x"]}\n\nnot json\n{"id": "2", "text": null}\n')
    (tmp_path / "chunks.json").write_text(json.dumps([{"id": "3"}, {"id": "4"}]))
    got = R.read_chunks(spark, str(tmp_path / "*/corpus/chunks.jsonl")).select("id", "course_slug").collect()
    assert sorted(map(tuple, got)) == [("1", "course-a"), ("2", "course-a")]
    assert R.read_chunks(spark, str(tmp_path / "chunks.json"), array_file=True).count() == 2


def test_questions_objectives_and_files(spark, tmp_path):
    (tmp_path / "gold.jsonl").write_text('# note\n{"id": "q", "query": "what", "relevant_chunk_ids": ["1"]}\n\n')
    assert [r.query for r in R.read_questions(spark, str(tmp_path / "gold.jsonl")).collect()] == ["what"]
    (tmp_path / "objectives.json").write_text(json.dumps({"terminal_objectives": [{"id": "TO-01", "statement": "s", "bloomLevel": "apply"}], "chapter_objectives": [{"chapter": "1", "week_range": [1, 2], "objectives": [{"id": "CO-01", "statement": "c", "bloomLevel": None}]}]}))
    got = {r.id: (r.hierarchy_level, r.week_lo, r.week_hi) for r in R.read_objectives(spark, str(tmp_path / "objectives.json")).collect()}
    assert got == {"TO-01": ("terminal", None, None), "CO-01": ("chapter", 1, 2)}
    assert R.read_files(spark, str(tmp_path), "*.json").count() == 1


def test_writers(spark, tmp_path):
    cat = spark.createDataFrame([("a", "X", "d1"), ("b", None, "d2")], "slug string, division string, domain string")
    W.write_indexes(cat, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/division").where("by_division = 'unspecified'").first().slug == "b"
    assert json.loads(W.jsonld(cat, "ctx", "slug", ["domain"]).first().document)["@context"] == "ctx"


def test_page_parsing_and_issues(spark):
    html = '<h1>T</h1><p>See <b>term</b> <a href="#x">x</a><a href="#gone">y</a></p><h3>Skip</h3><img src="a"><ul></ul><div>TODO write<script type="application/ld+json">{"a": 1}</script>'
    pages = M.parse_html(spark.createDataFrame([(1, html + '<i id="x"></i>'), (2, None)], "id int, html string"))
    r = {x.id: x for x in pages.collect()}
    assert r[1].terms == ["term"] and [s.heading for s in r[1].sections] == ["T", "Skip"] and r[1].jsonld == '{"a": 1}' and r[2].sections == []
    got = {(x.id, x["check"]) for x in M.page_issues(pages).collect()}
    assert {c for i, c in got if i == 1} == {"heading level skipped", "thin content", "image without text", "empty list", "anchor without target", "unbalanced tags", "placeholder text"}
    assert {c for i, c in got if i == 2} == {"no headings", "thin content"}
    assert M.gate(M.page_issues(pages), 2).first().passed is False


def test_markdown_qti_and_packages(spark, tmp_path):
    md = "---\ntitle: x\n---\n# A\ntext\nmore\n\n- one\n  - two\n```\n# no\n```\n"
    got = [(r.kind, r.level, r.text) for r in M.parse_markdown(spark.createDataFrame([(1, md)], "id int, text string")).orderBy("block").collect()]
    assert got == [("front matter", 0, "title: x"), ("heading", 1, "A"), ("paragraph", 0, "text more"), ("item", 1, "one"), ("item", 2, "two"), ("code", 0, "# no")]
    qti = '<q xmlns="u"><item ident="i1"><mattext>Stem?</mattext><response_label>A</response_label><response_label>B</response_label><varequal>A</varequal></item></q>'
    r = M.parse_qti(spark.createDataFrame([(1, qti), (2, "<broken"), (3, None)], "id int, xml string")).collect()
    assert [(x.item, x.stem, x.choices, x.correct) for x in r] == [("i1", "Stem?", ["A", "B"], ["A"])]
    with zipfile.ZipFile(tmp_path / "p.imscc", "w") as z:
        z.writestr("imsmanifest.xml", "<m>canvas instructure</m>")
        z.writestr("w1/page.html", "<h1>x</h1>")
    spark.dataSource.register(M.PackageSource)
    rows = spark.read.format("course_package").option("suffix", ".html").load(f"{tmp_path}/*.imscc").collect()
    assert [(r.member, r.lms) for r in rows] == [("w1/page.html", "canvas")]


def test_extraction(spark):
    df = spark.createDataFrame([(1, "A buffer is defined as a store. Rain causes erosion. For example, clay holds water."), (2, None)], "id int, text string")
    assert [(r.term, r.definition) for r in X.definitions(df).collect()] == [("A buffer", "a store.")]
    assert [(r.relation, r["left"]) for r in X.relations(df).collect()] == [("causes", "Rain")]
    assert X.examples(df).count() == 1
    s = spark.createDataFrame([("Clay is wet.", "clay")], "s string, t string").select(X.negate(F.col("s")), X.blank_out(F.col("s"), F.col("t"))).first()
    assert tuple(s) == ("Clay is not wet.", "_____ is wet.")


def run_stream(df, mode, tmp_path, name):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"k{i % 3}", float(i * 40), f"p{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "seq int, k string, t double, payload string").withColumn("ts", F.timestamp_seconds("t"))
    for a in (0, 15):
        df.where((F.col("seq") >= a) & (F.col("seq") < a + 15)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: D.read_stream(spark, str(tmp_path / "in"), df.schema.simpleString()[7:-1].replace(":", " "), "parquet", maxFilesPerTrigger="1")
    run_stream(D.chain(stream(), "k", "seq", "payload"), "append", tmp_path, "chained")
    assert sorted(map(tuple, spark.table("chained").collect())) == sorted(map(tuple, E.append_chain(df, "k", "seq", "payload").collect()))
    run_stream(D.trailing_failures(stream(), "k", "ts", 300, 3), "append", tmp_path, "trailing")
    want = sorted((r.k, r.recent) for r in E.trailing_count(df, ["k"], "ts", 300).collect())
    assert sorted((r.key, r.recent) for r in spark.table("trailing").collect()) == want
    run_stream(D.phase_counts(stream(), "k"), "complete", tmp_path, "phases")
    assert {r.k: r.n for r in spark.table("phases").collect()} == {"k0": 10, "k1": 10, "k2": 10}


def _tables(spark, path, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(path / f"{name}.parquet"))
    return str(path)


def test_markdown_queries_take_all_documents(spark, tmp_path):
    from loomspark.plans.catalog import queries

    fence, front = "# A\n```\n# no heading\n```\n## B\n- one\n\ntext", "---\ntitle: t\n---\n# C"
    d = _tables(spark, tmp_path, documents=([(1, fence), (2, front), (3, "# D"), (4, None), (5, "plain")], "doc_id long, text string"))
    assert {(r.id, r.headings) for r in queries()["markdown_blocks"](spark, d).collect()} == {(1, 2), (2, 1), (3, 1)}
    assert {(r.id, r.kind, r.blocks) for r in queries()["markdown_block_kinds"](spark, d).collect()} == {(1, "heading", 2), (1, "code", 1), (1, "item", 1), (1, "paragraph", 1), (2, "front matter", 1), (2, "heading", 1), (3, "heading", 1), (5, "paragraph", 1)}


def _teaching(spark, path):
    text = "Explain the long winded name of a most particular thing. " * 3
    tag = lambda s: [s]
    rows = [("a", text, tag("soil"), SAID), ("b", text, tag("x" * 500), None), ("c", "From the course material: Explain soil in your own words. And so on.", tag("soil"), []), ("d", "Short.", tag("soil"), None)]
    schema = "id string, text string, concept_tags array<string>, misconceptions array<struct<misconception:string,correction:string>>, source struct<section_heading:string>, bloom_level string, learning_outcome_refs array<string>"
    return _tables(spark, path, chunks=([(*r, ("h",), "understand", ["lo"]) for r in rows], schema))


SAID = [("A.", "B."), ('He "said" it\\.', "No\nnever é."), (None, "x")]


def test_chat_records_keep_quotes_and_all_misconceptions(spark, tmp_path):
    import hashlib
    import json

    from loomspark.plans.catalog import queries

    record = lambda u, v: json.dumps({"messages": [{"role": "system", "content": "Answer from the course."}, {"role": "user", "content": u}, {"role": "assistant", "content": v}]}, separators=(",", ":"), ensure_ascii=False)
    assert {(r.id, r.record_hash) for r in queries()["chat_records"](spark, _teaching(spark, tmp_path)).collect()} == {("a", hashlib.sha256(record(*m).encode()).hexdigest()) for m in SAID[:2]}


def test_synthesis_reasons_by_the_default_gates(spark, tmp_path):
    from loomspark.plans.catalog import queries

    assert {r.reason: r.n for r in queries()["synthesis_reasons"](spark, _teaching(spark, tmp_path)).collect()} == {"kept": 1, "prompt length": 1, "leak": 1, "completion length": 1}
