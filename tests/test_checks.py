from pyspark.sql import functions as F

from loomspark.operators import aggregate as A, checks as C, extraction as X, retrieval as R

CHUNK = "id string, text string, chunk_type string, difficulty string, bloom_level string, content_type_label string, source struct<course_id:string,module_id:string>, concept_tags array<string>, learning_outcome_refs array<string>, tokens_estimate long, word_count long"


def chunk(i, **over):
    base = {"id": i, "text": "t", "chunk_type": "example", "difficulty": "advanced", "bloom_level": "apply", "content_type_label": None, "source": ("K", "m_w02"), "concept_tags": ["a"], "learning_outcome_refs": ["co-01"], "tokens_estimate": 10, "word_count": 8}
    return tuple((base | over).values())


def test_tags(spark):
    df = spark.createDataFrame([(["Good Tag", "good tag", None, "the of", "3d", "one two three four five", "x"],), ([],), (None,)], "tags array<string>")
    assert [r[0] for r in df.select(C.clean_tags(F.col("tags"))).collect()] == [["good-tag", "x"], [], None]


def test_schema_findings(spark):
    rows = [chunk("ok"), chunk("bad", text=None, chunk_type="odd", difficulty="hard", source=(None, None), concept_tags=None, tokens_estimate=None), chunk("null", difficulty=None, bloom_level=None, word_count=-1)]
    got = {(r.id, r.finding) for r in C.schema_findings(spark.createDataFrame(rows, CHUNK)).collect()}
    assert got == {("bad", x) for x in ("text missing", "unknown chunk type", "unknown difficulty", "course missing", "module missing", "tags missing", "tokens missing")} | {("null", "negative size")}


def test_filter_treats_missing_as_zero_and_zero_as_off(spark):
    df = spark.createDataFrame([chunk("a"), chunk("b", tokens_estimate=None), chunk("c", tokens_estimate=99, difficulty=None)], CHUNK)
    ids = lambda **k: sorted(r.id for r in df.where(R.chunk_filter(**k)).collect())
    assert ids() == ids(min_tokens=0) == ["a", "b", "c"]
    assert ids(min_tokens=5) == ["a", "c"] and ids(max_tokens=50) == ["a", "b"] and ids(difficulty="advanced") == ["a", "b"]
    assert ids(week=2) == ["a", "b", "c"] and ids(week=3) == [] and ids(concept_tags=["z"]) == []


def test_strategies_and_lists(spark):
    one = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    assert sorted(r.id for r in C.first_strategy([one("a"), one("a", "b"), one("c")], 2).collect()) == ["a", "b"]
    assert sorted(r.id for r in C.first_strategy([one("a"), one("c")], 9).collect()) == ["c"]
    p, s = spark.createDataFrame([("a", 1), ("b", 2)], "id string, pos int"), spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "id string, pos int")
    assert [r.id for r in C.merge_lists(p, s, 3).collect()] == ["a", "b", "c"]


def test_key_values(spark):
    df = spark.createDataFrame([(1, "Title: A long\n  story\nAuthor: B\n\nloose line\nEmpty:\n"), (2, None)], "id int, text string")
    assert {(r.key, r.value) for r in C.key_values(df, "id", "text").collect()} == {("Title", "A long story"), ("Author", "B")}


def test_questions(spark):
    q = "Which one of these fits the best?\nA) yes\nB) Yes\nC) no"
    df = spark.createDataFrame([("a", "assessment_item", q), ("b", "assessment_item", "Say.\nA) x"), ("c", "example", "x"), ("d", "assessment_item", None)], "id string, chunk_type string, text string")
    assert {(r.id, r.finding) for r in C.question_findings(df).collect()} == {("a", "equal choices"), ("b", "few choices"), ("b", "short stem"), ("b", "no question")}
    assert {(r.choice, r.n_questions) for r in C.choice_use(df).collect()} == {("yes", 1), ("no", 1), ("x", 1)}


def test_profiles_and_summaries(spark):
    text = "Clay holds water well in most soils. " + "A filler sentence stands here. " * 3 + "The rain gauge and the drainage tile work together. Last words are here."
    df = spark.createDataFrame([(text, ["rain gauge", "drainage tile"]), ("Tiny.", None), (None, [])], "text string, terms array<string>")
    got = [r[0] for r in df.select(X.summary(F.col("text"), F.col("terms"), most=2)).collect()]
    assert got[0] == "Clay holds water well in most soils. The rain gauge and the drainage tile work together." and got[1] == "Tiny." and got[2] == ""
    p = X.content_profile(F.col("text"))
    kinds = [r[0] for r in spark.createDataFrame([("First do this, then that.",), ("It means so.",), ("",), (None,)], "text string").select(p["kind"]).collect()]
    assert kinds == ["procedure", "definition", "exposition", "exposition"]


def test_statistics(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 2), ("b", "x", 3)], "k string, v string, n int")
    got = {(r.dimension, r.value): (r.n, r.total) for r in A.grouped_counts(df, ["k", "v"], {"total": F.col("n")}).collect()}
    assert got == {("k", "a"): (2, 3), ("k", "b"): (1, 3), ("v", "x"): (2, 4), ("v", "unspecified"): (1, 2), ("total", "all"): (3, 6)}
    e = {r.k: r for r in A.entropy(df.na.fill("y", ["v"]), ["k"], "v").collect()}
    assert e["a"].normalized == 1.0 and e["b"].entropy == 0.0 and e["b"].normalized == 0.0
    assert A.grouped_counts(df.limit(0), ["k"], {}).where("dimension <> 'total'").count() == 0
