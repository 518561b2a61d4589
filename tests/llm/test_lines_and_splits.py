import random
from collections import defaultdict

from pyspark.sql import functions as F

from loomspark.llm import boilerplate as B, splitting as S


def brute_lines(rows, least):
    seen, lines = defaultdict(set), []
    once = {}
    for i, s, t in rows:
        if i is not None:
            once.setdefault(i, (s, t))
    for i, (s, t) in once.items():
        for n, f in enumerate(B.normal_lines(t or "")):
            if f:
                seen[s, f].add(i)
                lines.append((i, n, s, f))
    return {(i, n) for i, n, s, f in lines if len(seen[s, f]) >= least}


def test_repeated_lines_against_brute_force(spark):
    random.seed(4)
    notes = ["© 2021  Press. All rights reserved", "Share", "a", "x" * 700, "Chapter 12 of 30 - see\tthe site", "é" * 40]
    rows = []
    for i in range(150):
        own = [f"line {random.choice('abcdefgh')}{random.randint(0, 3)} " + "word " * random.randint(0, 90) for _ in range(random.randint(0, 4))]
        own += [random.choice([n, n.upper(), "  " + n + " \r"]).replace("2021", str(2000 + i)) for n in notes if random.random() < 0.3]
        random.shuffle(own)
        rows.append((f"d{i}", random.choice(["s1", "s2", None]), "\n".join(own)))
    rows += [rows[0], ("n", "s1", None), ("e", "s1", ""), (None, "s1", notes[0])]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    got = B.repeated_lines(df.withColumn("piece", F.lit(1)), 10)
    want = brute_lines(rows, 10)
    assert want and {(r.id, r.line_no) for r in got.collect()} == want
    clean = {r.id: r for r in B.without_lines(df, got).collect()}
    assert clean["n"].text is None and clean["e"].text == "" and len(clean) == 152
    for i, _, t in rows[:150]:
        assert clean[i].text == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in want)


def test_places_depend_on_what_is_near():
    import numpy as np

    passage = b"the same notice stands here in every document of this one source and goes on for long enough to be cut into pieces "
    cut = lambda raw: B.cut_places(np.frombuffer(raw, dtype=np.uint8), np.array([0]), 16)
    alone, shifted = cut(passage), cut(b"something else " + passage + b"and more") - 15
    near = B.WINDOW + B.LEAST
    assert [x for x in shifted if near <= x < len(passage)] == [x for x in alone if near <= x < len(passage)] != []
    two = B.cut_places(np.frombuffer(passage * 2, dtype=np.uint8), np.array([0, len(passage)]), 16)
    assert two.tolist() == [*alone.tolist(), *(alone + len(passage)).tolist()]


def test_passages_without_line_feeds(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghijklmnop") for _ in range(random.randint(3, 9)))
    notice = "All rights are reserved by the press in 2021, no part of this course may be copied, lent or sold without a written permit from the editors of the series."
    rows = []
    for i in range(60):
        body = [word() for _ in range(120)]
        at = random.randint(0, 120)
        rows.append((f"d{i}", "s", " ".join(body[:at] + [notice.replace("2021", str(1900 + i))] * (i % 2) + body[at:])))
    rows += [("n", "s", None), ("e", "s", ""), (None, "s", notice)]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    got = {r.id: (r.first_word, r.end_word) for r in B.repeated_passages(df, 10).collect()}
    texts = {i: t for i, _, t in rows}
    assert set(got) == {f"d{i}" for i in range(60) if i % 2}
    for i, (a, b) in got.items():
        words = texts[i].split(" ")
        assert " ".join(words[a:b]) in texts[i] and set(words[a:b]) <= set(notice.split(" ")) | {str(1900 + int(i[1:])) + ","}
        assert b - a >= 14  # of 28 words: both ends lose a piece at most
    clean = {r.id: r for r in B.without_passages(df, B.repeated_passages(df, 10)).collect()}
    assert clean["n"].text is None and clean["e"].text == "" and clean["d0"].text == texts["d0"]
    for i, (a, b) in got.items():
        words = texts[i].split(" ")
        assert clean[i].text.split() == words[:a] + words[b:] and clean[i].words_cut == b - a


def test_more_hot_pieces_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(B, "BROADCAST_ROWS", 0)
    rows = [(f"d{i}", "s", f"own {i} line {'x' * i}\nThe same notice stands at the foot of every document here, and it is long enough to be cut.\nShare") for i in range(12)]
    df = spark.createDataFrame(rows, "id string, source string, text string")
    assert {(r.id, r.line_no) for r in B.repeated_lines(df, 10).collect()} == brute_lines(rows, 10) != set()


def test_no_lines_and_empty_table(spark):
    assert B.repeated_lines(spark.createDataFrame([], "id string, source string, text string")).count() == 0


def test_split_properties():
    random.seed(3)
    for _ in range(200):
        text = "".join(random.choice(["w ", "word ", "end. ", "x\n", "y\n\n", " z\t"]) for _ in range(random.randint(0, 400)))
        limit = random.randint(5, 60)
        overlap = random.randint(0, limit - 1)
        pieces, words = S.split_text(text, limit, overlap), S._WORD.findall(text)
        if len(words) <= limit:
            assert pieces == [text]
            continue
        got = [S._WORD.findall(p) for p in pieces]
        assert all(len(g) <= limit for g in got)
        whole = list(got[0])
        for a, b in zip(got, got[1:]):
            n = min(overlap, len(a))
            assert b[:n] == a[len(a) - n :]
            whole += b[n:]
        assert whole == words


def test_weak_boundaries_go_first():
    text = "\n\n".join(" ".join(f"s{i}w{j}" + ("." if j % 5 == 4 else "") for j in range(20)) for i in range(6))
    pieces = S.split_text(text, 45, 5)
    assert all("s" in p for p in pieces)
    starts = [p.split()[5] if k else p.split()[0] for k, p in enumerate(pieces)]
    assert all(s.endswith("w0") for s in starts)  # every cut is at a blank line


def test_chunks_relinked(spark):
    long = " ".join(f"w{i}." for i in range(2000))
    rows = [("a", long, None, 1), ("a", long, None, 1), ("b", "short one", "a", 1), ("c", None, "b", 1), ("d", "x " * 900, "gone", 1), (None, long, None, 1), ("e", "", "d", 1)]
    out = {r.id: r for r in S.split_chunks(spark.createDataFrame(rows, "id string, text string, follows_chunk string, cut_n int")).collect()}
    n = max(r.piece_no for r in out.values() if r.source_id == "a")
    assert out["b"].follows_chunk == f"a#{n}" and out["a#1"].follows_chunk == "a#0" and out["a#0"].follows_chunk is None
    assert out["d#0"].follows_chunk == "gone" and out["e"].follows_chunk == f"d#{out['d#0'].n_pieces - 1}"
    assert out["c"].text is None and out["c"].word_count == 0 and out["c"].tokens_estimate == 0
    assert all(r.word_count <= 800 and r.tokens_estimate == r.word_count * 13 // 10 for r in out.values())
    assert S.split_chunks(spark.createDataFrame([], "id string, text string, follows_chunk string")).count() == 0
