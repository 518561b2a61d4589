"""Fixtures for what no table of the driver shows: markup, packages, hooks, text patterns, runs and questions."""

import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import ids, patterns as P
from loomspark.operators import aggregate as A, alignment as L, assessment as Q, decompose as D, graph as G, retrieval as R, runs as U, synthesis as Y
from loomspark.sources import markup as M, readers, writers
from loomspark.streaming import decisions  # noqa: F401  (importable beside the rest)


def one(spark, value, c):
    return spark.createDataFrame([(value,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]


def test_intents_and_concepts():
    for q, want in (("What is a routing table?", "definition"), ("why does it matter", "explanation"), ("Give an example of recursion", "example"), ("how to split a text", "procedure"), ("Compare X and Y", "comparison"), ("when should I use it", "application"), ("components of a cell", "analysis"), ("combine both", "synthesis"), ("routing", "explanation")):
        assert D.intent(q) == want, q
    assert D.concepts('Compare "spaced review" and mastery learning') == ["spaced review", "mastery learning"]
    assert D.concepts("the of") == [] and D.decompose("")[0][1] == "importance of "
    rows = D.decompose("Compare retrieval practice and worked example")
    assert [r[2] for r in rows] == ["what", "what", "related"] and abs(sum(r[3] for r in rows) - 1) < 1e-9
    assert "udl" in D.domains("Multiple means of engagement") and D.bloom_level("design and list") == "create"
    assert D.objective_concepts("Students will be able to explain how osmosis works") == "osmosis works"


def test_error_classes(spark):
    for m, want in (("Disk full", "poison_pill"), ("504 Gateway Timeout", "transient"), ("ECONNRESET by peer", "transient"), ("403 Forbidden", "permanent"), ("Access denied", "permanent"), ("hm", "unknown"), ("out of memory, retry later", "poison_pill"), (None, "unknown")):
        assert one(spark, m, lambda c: ids.first_match(c, ids.ERRORS, "unknown")) == want, m


def test_reveals_beside_explanations(spark):
    text = "The correct answer is B. " + "x" * 120 + " the correct answer is C. The reason is that it must be so."
    got = {r.sign: r.n for r in Q.reveals(spark.createDataFrame([("a", text), ("b", None), ("c", "")], "id string, text string")).collect()}
    assert got == {"answer_reveal": 1}  # the second place, and `must be`, are explained


def test_claims(spark):
    get = lambda t: [(r.claim, r.observed, r.expected) for r in one(spark, t, P.claims)]
    assert get("It lists 78 success criteria. It has 86 success criteria.") == [("success criteria", 78, 86)]
    assert get("WCAG 2.0 had 61 success criteria.") == [] and get(None) == [] and get("") == []
    assert get("There are 13 guidelines: 4, 3, 5 and 2 here.") == [("sum", 14, 13)] and get("There are 14 guidelines: 4, 3, 5 and 2.") == []


def test_text_repairs(spark):
    assert one(spark, "see https://a.example/\npath/x\nnext\nword a\nnd more", P.join_urls) == "see https://a.example/path/x\nnext\nword a\nnd more"
    assert one(spark, "https://a.example/?id=1\n23\nText", P.join_urls) == "https://a.example/?id=123\nText"
    assert one(spark, "https://a.example/\n\nText", P.join_urls) == "https://a.example/\n\nText"
    assert one(spark, "See Chapter 3, Figure 2.1 and [4].", P.link_references) == 'See <a href="#chapter-3">Chapter 3</a>, <a href="#figure-2.1">Figure 2.1</a> and <a href="#ref-4">[4]</a>.'
    assert one(spark, '<label data-correct="true">A</label><div class="sc-feedback">no</div>', P.strip_feedback) == "<label>A</label>"
    assert one(spark, " \n", P.clean_text) == "" and one(spark, "a\x0cb", P.clean_text) == "a\n\nb"
    assert one(spark, "Page 3\nText\npage 4", lambda c: P.blank_lines(c, F.array(F.lit("page #")))) == "\nText\n"
    assert one(spark, "Step 1: Open it. Step 2: Close it.", P.steps) == ["Open it.", "Close it."] and one(spark, "Step 1: alone", P.steps) == [] and one(spark, None, P.steps) == []
    assert one(spark, "A common misconception: plants eat soil. a common misconception: plants eat soil.", P.misconceptions) == ["plants eat soil."]
    assert one(spark, "You will be able to describe the water cycle, compare two rivers and draw a map of both.", P.objectives) == ["describe the water cycle", "compare two rivers", "draw a map of both"]
    assert one(spark, "Working Memory and the Routing Table hold tables tables tables", P.salient_phrases)[:3] == ["working memory", "routing table", "tables"]
    assert one(spark, None, P.salient_phrases) == [] and one(spark, "", P.salient_phrases) == []


PAGE = """<html><head><title>T</title></head><body><h1 id="a">One</h1><p>text one</p><h2>Part</h2><ul><li>x</li><li>y</li></ul>
<h1>Two</h1><section data-source-id="s1" data-confidence="0.9"><p>more</p></section><section data-source-id=""><img src="i.png"></section>
<a href="u">click here</a><table><tr><td>1</td></tr></table><input id="q" type="text"><p id="a">again</p></body></html>"""


def test_elements_structure_and_access(spark):
    df = spark.createDataFrame([("p", PAGE, 1), ("n", None, 2), ("e", "", 3)], "id string, html string, tag int")
    at = {r.xpath: r for r in M.xpath_index(df).collect() if r.id == "p"}
    assert at["/html[1]/body[1]/h1[2]"].text == "Two" and at["/html[1]/body[1]/ul[1]/li[2]"].text == "y" and at["/html[1]/body[1]/section[2]/img[1]"].attributes == {"src": "i.png"}
    s = [(r.chapter, r.section, r.kind, r.text) for r in M.textbook_structure(df).orderBy("chapter", "section", "block").collect()]
    assert s[:3] == [(0, -1, "chapter", "One"), (0, -1, "paragraph", "text one"), (0, 0, "section", "Part")] and (1, -1, "chapter", "Two") in s and (0, 0, "item", "y") in s
    f = {(r.check, r.n) for r in M.accessibility(df).collect()}
    assert f == {("image without text", 1), ("page without language", 1), ("link says nothing", 1), ("table without headers", 1), ("field without label", 1), ("repeated id", 1)}
    fixed = M.accessibility_report(M.accessibility(df.withColumn("html", F.replace("html", F.lit("click here"), F.lit("the handbook")))), M.accessibility(df)).first()
    assert fixed.failures == 5 and fixed.fixed == 1
    marks = {r.id: (r.sections, r.marked, r.passed) for r in M.provenance_marks(df).collect()}
    assert marks == {"p": (2, 1, False), "n": (0, 0, True), "e": (0, 0, True)}
    assert M.topics(M.parse_html(df), least_words=1).count() > 0


def test_packages(spark, tmp_path):
    for name, files in (("good", {"imsmanifest.xml": '<m><file href="a.html"/></m> instructure', "a.html": "<p>x</p>", "q.xml": "<questestinterop/>"}), ("bad", {"imsmanifest.xml": '<m><file href="gone.html"/></m>', "e.html": ""}), ("none", {"x.txt": "y"})):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for k, v in files.items():
                z.writestr(k, v)
    spark.dataSource.register(M.PackageSource)
    for path in (f"{tmp_path}/*.zip", f"file://{tmp_path}/*.zip", str(tmp_path)):
        m = spark.read.format("course_package").load(path)
        assert m.select("package").distinct().count() == 3
    m = m.withColumn("package", F.regexp_extract("package", "([^/]+)$", 1)).cache()
    assert {(r.package, r.finding) for r in M.package_findings(m).collect()} == {("bad.zip", "missing gone.html"), ("bad.zip", "empty e.html"), ("none.zip", "no manifest")}
    inv = {r.package: (r.pages, r.quizzes, r.passed) for r in M.package_inventory(m).collect()}
    assert inv == {"good.zip": (1, 1, True), "bad.zip": (1, 0, True), "none.zip": (0, 0, False)}
    assert m.where("lms = 'canvas'").select("package").distinct().count() == 1


def test_readers_and_writers(spark, tmp_path):
    doc = {"courseObjectives": [{"objectiveId": "C1", "statement": "s", "bloomLevel": "apply"}], "chapters": [{"chapterId": "k", "chapterObjectives": [{"objectiveId": "H1", "statement": "s"}], "sections": [{"sectionId": "z", "sectionObjectives": [{"objectiveId": "S1", "statement": "s"}, {"objectiveId": None, "statement": "s"}], "subsections": [{"subsectionId": "u", "subsectionObjectives": [{"objectiveId": "U1", "statement": "s", "keyConcepts": ["a"]}]}]}]}, {"chapterId": "empty"}]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    got = {(r.id, r.bloom_level, r.hierarchy_level, r.parent) for r in readers.read_nested_objectives(spark, str(tmp_path / "o.json")).collect()}
    assert got == {("C1", "apply", "course", None), ("H1", "understand", "chapter", "k"), ("S1", "understand", "section", "z"), ("U1", "understand", "subsection", "u")}
    (tmp_path / "ped").mkdir()
    (tmp_path / "ped" / "a.json").write_text('{"x": 1}')
    (tmp_path / "ped" / "b.json").write_text("broken")
    assert sorted(r.model for r in readers.read_pedagogy(spark, str(tmp_path / "ped")).collect()) == ['{"x": 1}', "{}"]
    run = tmp_path / "runs" / "r1" / "checkpoints"
    run.mkdir(parents=True)
    (run / "a_checkpoint.json").write_text('{"run_id": "r1", "phase_name": "a", "status": "completed", "index": 0}')
    (run / "b_checkpoint.json").write_text('{"run_id": "r1", "phase_name": "b", "status": "started", "index": 1}')
    c = readers.read_checkpoints(spark, str(tmp_path / "runs"))
    assert {r.dir_run for r in c.collect()} == {"r1"} and U.resumable(c, "run_id", "index", "status", "phase_name").first().phase == "b"
    assert [(r.severity, r.category) for r in U.checkpoint_issues(c).collect()] == [("warning", "incomplete phase")]
    df = spark.createDataFrame([("a", ["x", "y"], 2), ("b", ["x"], 1)], "concept string, courses array<string>, total_courses int")
    writers.write_cross_references(df, str(tmp_path / "xref"))
    assert spark.read.json(str(tmp_path / "xref/shared_concepts")).count() == 1
    writers.write_artifacts({"stats": df.withColumn("course_id", F.lit("c"))}, str(tmp_path / "art"))
    writers.write_report(df.limit(1), df, str(tmp_path / "rep"))
    writers.append_chunks(df, str(tmp_path / "app"))
    writers.append_chunks(df, str(tmp_path / "app"))
    writers.import_course(spark.createDataFrame([("p", 3, "h")], "path string, length long, sha256 string"), "c1", str(tmp_path / "lib"), division="STEM")
    assert spark.read.json(str(tmp_path / "app")).count() == 4 and spark.read.json(str(tmp_path / "lib/c1/manifest")).first().division == "STEM"
    (tmp_path / "h.html").write_text("<p>x</p>")
    assert [r.id for r in readers.read_pages(spark, str(tmp_path)).collect()] == ["h"]


def test_hooks(spark):
    c = spark.createDataFrame([("a", "alpha text " * 5), ("b", None)], "id string, text string")
    fallback = F.coalesce(F.upper("text"), F.lit("none"))
    assert {r.id: r.summary for r in Y.summaries(c, fallback, lambda s: s.str.slice(0, 50)).collect()} == {"a": ("alpha text " * 5)[:50], "b": "none"}

    def fails(s):
        raise RuntimeError("no")

    assert {r.summary for r in Y.summaries(c, fallback, fails).collect()} == {("alpha text " * 5).upper(), "none"}
    nodes = spark.createDataFrame([("x",), ("y",)], "concept string")
    edges = Y.propose_edges(c, nodes, lambda pdf: pd.DataFrame({"source": ["x", "x"], "target": ["y", "gone"], "type": ["is-a", "is-a"]}))
    assert [(r.source, r.target, r.rule) for r in edges.collect()] == [("x", "y", "proposed")] and Y.propose_edges(c, nodes, None) is None
    assert [r.role for r in Y.classify_blocks(c, F.lit("rule"), lambda pdf: pd.Series(["own", None])).orderBy("id").collect()] in (["own", "rule"], ["own", "own"])
    reg = Y.Registry()
    reg.register("up", lambda x: F.upper(x), 1)
    assert c.select(reg.call("up", F.lit("q")).alias("x")).first().x == "Q"
    with pytest.raises(ValueError):
        reg.register("up", lambda x: x, 1)
    assert Y.audited(c, "seen", ids=F.count("id")).count() == 2


def test_synthesis(spark):
    t = "Write to Dr. Ada Byron (ada@uni.example, 555-123-4567).\nAlan Turing, Director\n" + "x" * 400 + " far@uni.example"
    got = {r.name: (r.email, r.phone, r.confidence) for r in Y.contacts(spark.createDataFrame([(1, t), (2, None)], "id int, text string"), "id", "text").collect()}
    assert got["Dr. Ada Byron"] == ("ada@uni.example", "555-123-4567", 0.9) and got["Alan Turing"][2] > 0.4
    r = {x.name: x.role for x in Y.roster(spark.createDataFrame([(1, "- Ada Byron - Chair\nAlan Turing: Reader\nAda Byron - Other\nno role here")], "id int, text string"), "id", "text").collect()}
    assert r == {"Ada Byron": "Chair", "Alan Turing": "Reader"}
    parts = [("k", "table", "Room 1", None), ("k", "ocr", "room  1", None), ("k", "text", "Room 7", None), ("k", "text", None, None)]
    m = Y.merge_sources(spark.createDataFrame(parts, "k string, source string, value string, confidence double"), ["k"]).first()
    assert m.value == "Room 1" and m.agree == 2 and abs(m.confidence - 0.91) < 1e-9
    with pytest.raises(ValueError):
        U.phase_order(spark, {"a": ["b"], "b": ["a"]})
    assert U.replay(spark.createDataFrame([(1, "x"), (2, "y")], "id int, kind string"), {"x": lambda d: d.select("id", F.lit("ran").alias("outcome"))}, "kind", dry=True).where("outcome = 'pending'").count() == 1


def test_graph_aware_boosts(spark):
    c = spark.createDataFrame([("a", ["CO-01"]), ("b", ["co-02"]), ("c", None), ("d", [])], "id string, learning_outcome_refs array<string>")
    e = spark.createDataFrame([("co-01", "heat", "apply"), ("co-01", "flow", None), ("co-02", "salt", "apply")], "source string, target string, bloom_level string")
    q = spark.createDataFrame([(1, "heat"), (1, "wind")], "query_id int, concept string")
    assert [(r.id, round(r.boost, 6)) for r in R.targets_boost(c, e, q, "apply").collect()] == [("a", 0.4)]
    assert [(r.id, round(r.boost, 6)) for r in R.targets_boost(c, e, q, "create").collect()] == [("a", round(1 / 3, 6))]
    nodes = spark.createDataFrame([("color-contrast",), ("body",)], "concept string")
    got = R.concepts_of_queries(spark.createDataFrame([(1, "Color contrast, body text"), (2, None)], "query_id int, query string"), nodes)
    assert {(r.query_id, r.concept) for r in got.collect()} == {(1, "color-contrast"), (1, "body")}


def test_ranking_within_courses_is_ranking_each_course_alone(spark):
    rows = [("x", "1", "salt water water"), ("x", "2", "salt"), ("x", "3", None), ("y", "4", "water salt river"), ("y", "5", "river")]
    docs = spark.createDataFrame(rows, "course string, id string, text string")
    terms = spark.createDataFrame([(c, 1, "water", 1) for c in "xy"], "course string, query_id int, term string, mult long")
    got = {r.id: r.score for r in R.bm25(docs, terms, within=("course",)).collect()}
    for c in "xy":
        alone = R.bm25(docs.where(F.col("course") == c).select("id", "text"), terms.where(F.col("course") == c).drop("course"))
        for r in alone.collect():
            assert abs(got[r.id] - r.score) < 1e-9
    assert set(got) == {"1", "4"}


def test_numbers_in_groups_and_medians(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, (i * 37) % 101) for i in range(101)], "g string, v int").repartition(7)
    for g, rows in {"a": None, None: None}.items():
        own = [r for r in A.number_in_groups(df, ["g"], "v").collect() if r.g == g]
        assert [r.i for r in sorted(own, key=lambda r: r.v)] == list(range(len(own)))
    m = spark.createDataFrame([("a", v) for v in (1, 1, 2, 6)] + [("b", 3), ("c", None)], "g string, v int").groupBy("g").agg(A.upper_median("v", [1, 2, 3, 4, 5, 6]).alias("m"))
    assert {r.g: r.m for r in m.collect()} == {"a": 2, "b": 3, "c": None}


def test_betweenness_of_a_path(spark):
    n = spark.createDataFrame([("c", x) for x in "abcd"], "course string, concept string")
    e = spark.createDataFrame([("c", "a", "b", 1), ("c", "b", "c", 1), ("c", "c", "d", 1)], "course string, source string, target string, weight int")
    for block in (256, 2):
        assert {r.concept: r.score for r in G.betweenness(n, e, block).collect()} == {"a": 0.0, "b": 1.0, "c": 1.0, "d": 0.0}


def test_resolution_and_empty_tables(spark):
    refs = spark.createDataFrame([("c", "1", "CO-01"), ("c", "2", "W03-co-01"), ("c", "3", "zz")], "course string, id string, ref string")
    known = spark.createDataFrame([("c", "co-01")], "course string, lo string")
    assert {r.id: r.status for r in L.resolve_refs(refs, known).collect()} == {"1": "direct", "2": "parent", "3": "orphan"}
    assert L.resolve_refs(refs.limit(0), known).count() == 0
    ids_ = L.nested_ids(spark.createDataFrame([(1, '{"a": [{"sourceId": "x"}, {"b": {"sourceId": 3}}]}'), (2, "broken"), (3, None)], "id int, t string"), "id", "t")
    assert {(r.id, r.value) for r in ids_.collect()} == {(1, "x"), (1, "3")}
    q = Q.questions_of(spark.createDataFrame([], "id string, source struct<course_id:string>, bloom_level string, learning_outcome_refs array<string>, text string, chunk_type string"))
    vocabulary = spark.createDataFrame([], "course string, word string")
    assert Q.question_quality(q, vocabulary).count() == 0 and Q.assessment_gate(q, ["course"]).count() == 0
