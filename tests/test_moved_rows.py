"""What is moved between tasks must follow the input, not the product of what meets."""

from collections import defaultdict

import pytest

from loomspark.operators import alignment as L, graph as G, joins as J, retrieval as R


def moved(spark, run):
    """(result, rows written to shuffles) of a call, without joins by broadcasts that nobody asked for."""
    sc = spark.sparkContext
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        seq = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {seq.apply(i).stageId(): seq.apply(i).shuffleWriteRecords() for i in range(seq.size())}

    before = max(stages(), default=-1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = run().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    return got, sum(n for k, n in stages().items() if k > before)


def test_chunks_do_not_meet_every_concept_of_their_outcomes(spark):
    n = 300
    chunks = spark.createDataFrame([(f"c{i}", ["CO-01", None] if i % 2 else ["co-02", "co-01", "co-01"]) for i in range(n)] + [("none", ["co-09"])], "id string, learning_outcome_refs array<string>")
    edges = spark.createDataFrame([("co-01", f"k{j}", "apply" if j == 7 else None) for j in range(n)] + [("Co-02", f"k{j}", None) for j in range(n // 2, 2 * n)], "source string, target string, bloom_level string")
    concepts = spark.createDataFrame([(1, "k7"), (1, "k599"), (2, "k8"), (2, "other")], "query_id int, concept string")
    rows, records = moved(spark, lambda: R.targets_boost(chunks, edges, concepts, "apply"))
    want = {}
    for i in range(n):
        want |= {(1, f"c{i}"): 1 / (300 + 2 - 1) * 1.2 if i % 2 else 2 / 600 * 1.2, (2, f"c{i}"): 1 / (300 + 2 - 1) if i % 2 else 1 / (600 + 2 - 1)}
    assert {(r.query_id, r.id): pytest.approx(r.boost) for r in rows} == want
    assert records < 20_000  # chunks times concepts are 135,000


def test_texts_are_not_moved_to_find_answers_in_them(spark, monkeypatch):
    words = [f"w{i}x" for i in range(300)]
    texts = [(f"p{i}", " ".join(words[i:] + words[:i]) + (f". It supports the common matter {i} only" if i % 3 == 0 else " It supports the")) for i in range(60)] + [("null", None), ("blank", " !"), ("end", "say photosynthesis everywhere"), ("part", "photosynthesis everywhereelse")]
    own = [(f"q{i}", f"It supports the common matter {i}") for i in range(60)] + [("two", "Photosynthesis everywhere"), ("three", "w1x w2x and w3xyzzy"), ("exact", "w250x w251x w252x"), ("cut", "w250x w251x w25"), ("start", "w260x w261x w262x w26")]
    prompts = spark.createDataFrame(texts, "id string, text string")
    answers = J.register_answers(spark.createDataFrame(own, "q string, a string"), "q", "a")
    rows, records = moved(spark, lambda: J.contained_leaks(prompts, answers))
    place = {q: i for i, (q, _) in enumerate(own)}
    want = {(f"p{i}", f"q{j}") for i in range(0, 60, 3) for j in range(60) if str(i).startswith(str(j))} | {(f"p{i}", q) for i in range(60) for q in ("exact", "start")} | {("end", "two")}
    assert {(r.id, r.question) for r in rows} == want and len(rows) == len(want) and len(place) == len(own)
    assert records < 5_000  # runs of words are 50,000
    monkeypatch.setattr(J, "HEADS", 3)
    assert {(r.id, r.question) for r in J.contained_leaks(prompts, answers).collect()} == want


def test_concepts_do_not_meet_every_neighbour(spark, monkeypatch):
    n = 150
    tags = {f"c{i:03}": ["hub", f"k{i % 40}", f"k{i * 7 % 90}", f"k{i * i % 97}", f"x{i}", "due"] for i in range(n)}
    place = {c: (None if i % 50 == 49 else f"m{i // 30}", i * 11 % 30, c) for i, c in enumerate(tags)}
    chunks = spark.createDataFrame([(c, "A", m, p) for c, (m, p, _) in place.items()], "id string, course string, module string, pos int")
    mentions = spark.createDataFrame([("A", c, k) for c, own in tags.items() for k in own], "course string, id string, concept string")
    nodes, edges = G.tag_graph(mentions)
    rows, records = moved(spark, lambda: L.prerequisites_before(chunks, mentions, nodes, edges))
    key = {c: (m is not None, m or "", p, c) for c, (m, p, _) in place.items()}
    seen, near = {}, defaultdict(list)
    for c, own in tags.items():
        for k in own:
            seen[k] = min(seen.get(k, key[c]), key[c])
    frequency = {r.concept: r.frequency for r in nodes.collect()}
    for r in edges.collect():
        for a, b in ((r.source, r.target), (r.target, r.source)):
            near[a].append((b, round(r.weight / frequency[b] ** 0.5, 9)))
    want, last = {}, defaultdict(list)
    for c in sorted(tags, key=key.get):
        own = {k for k in tags[c] if k != "due"}
        best = {}
        for k in own:
            for t, s in near[k]:
                if t != "due" and t not in own and seen[t] < key[c]:
                    best[t] = max(best.get(t, 0), s)
        before = last[place[c][0]]
        want[c] = sorted(best, key=lambda t: (-best[t], t))[:5] or [t for t in before if t not in own][:5]
        last[place[c][0]] = sorted(own)
    assert {r.id: r.prereqs for r in rows} == want
    assert records < 15_000  # chunks times the hub's neighbours alone are 15,000, and as many for the others
    monkeypatch.setattr(L, "MENTIONS_PER_PART", 10)
    assert {r.id: r.prereqs for r in L.prerequisites_before(chunks, mentions, nodes, edges).collect()} == want
