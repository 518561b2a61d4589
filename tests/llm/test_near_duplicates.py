import random
from itertools import combinations

import numpy as np
from hypothesis import given, settings, strategies as st

from loomspark.llm import nearduplicate as D


def sets_of(texts, k):
    out = []
    for t in texts:
        w = D._WORDS((t or "").lower())
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    return out


def corpus(n=120):
    random.seed(8)
    voc = [f"v{i}" for i in range(40)]
    rows = []
    for i in range(n):
        if rows and random.random() < 0.6:
            w = random.choice(rows)[1].split()
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(voc)
            if random.random() < 0.2:
                w = w[: random.randint(3, len(w))]
        else:
            w = [random.choice(voc) for _ in range(random.randint(20, 120))]
        rows.append((f"id{i:03d}", " ".join(w)))
    return rows + [rows[0], ("null", None), ("blank", " \n"), ("two", "only two"), (None, rows[1][1]), ("é", "Ça été l'été Ça été l'été"), ("É", "ÇA ÉTÉ L'ÉTÉ ÇA ÉTÉ L'ÉTÉ")]


def test_pairs_and_groups_against_brute_force(spark):
    rows = corpus()
    once = dict(r for r in reversed(rows) if r[0] is not None)
    ids = sorted(once)
    sets = dict(zip(ids, sets_of([once[i] for i in ids], 3)))
    want = {(a, b) for a, b in combinations(ids, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    df = spark.createDataFrame([(*r, 1) for r in rows], "id string, text string, key int")
    got = {(r.id_a, r.id_b) for r in D.near_duplicate_pairs(df, 3, 0.7).collect()}
    assert len(want) > 50 and got == want
    groups = {r.id: r for r in D.near_duplicate_groups(df, 3, 0.7).collect()}
    assert set(groups) == {i for i in ids if sets[i]}
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id
    assert groups["é"].copies == 2 and groups["é"].group_id == groups["É"].group_id


def test_hot_tokens_are_cut_into_blocks(spark):
    base = [f"h{i}" for i in range(30)]
    random.seed(2)
    rows = [(f"r{i}", " ".join(base[:15] + [random.choice("xyz")] + base[15:])) for i in range(60)] + [(f"u{i}", " ".join(base[:14] + [f"z{i}"] + base[14:])) for i in range(30)]
    texts = spark.createDataFrame(rows, "id string, text string")
    stage = D._sets_stage(texts, 3)
    docs = stage.where("id is not null")
    freq = spark.sparkContext.broadcast(D._sum_blocks(stage.where("id is null")))
    small = {(r.ka, r.kb) for r in D.candidate_pairs(texts, docs, freq, 3, 0.7, most=4).collect()}
    large = {(r.ka, r.kb) for r in D.candidate_pairs(texts, docs, freq, 3, 0.7).collect()}
    sets = {D.set_key(s): s for s in D.shingle_sets([t for _, t in rows], 3, D._WordHash())}
    true = {(min(a, b), max(a, b)) for a, b in combinations(sets, 2) if len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.7}
    assert len(true) > 100 and true <= small and true <= large


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, text string")
    assert D.near_duplicate_pairs(df).count() == 0 and D.near_duplicate_groups(df).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=400), st.sets(st.integers(0, 2**64 - 1), max_size=30), st.integers(0, 30))
def test_sketch_distance_is_a_lower_bound(a, extra, drop):
    b = set(sorted(a)[min(drop, len(a) - 1) :]) | extra
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
    sx, sy = D.sketch(x), D.sketch(y)
    p, q = int.from_bytes(sx), int.from_bytes(sy)
    n, m = 8 * len(sx), 8 * len(sy)
    while n > m:
        p, n = D.fold_bits(p, n), n // 2
    while m > n:
        q, m = D.fold_bits(q, m), m // 2
    assert (p ^ q).bit_count() <= len(a ^ b)
    assert p == int.from_bytes(D.sketch(x, n)) and q == int.from_bytes(D.sketch(y, n))


def test_bk_tree_finds_all_within():
    random.seed(5)
    items = [random.getrandbits(64) for _ in range(300)]
    items += [x ^ (1 << random.randrange(64)) for x in items[:50]]
    tree = D.BKTree()
    for i, x in enumerate(items):
        tree.add(x, i)
    for x in items[:40]:
        for radius in (0, 3, 20):
            assert sorted(i for i, _ in tree.within(x, radius)) == [i for i, y in enumerate(items) if (x ^ y).bit_count() <= radius]


def test_sizes_that_differ_by_more_than_two(spark):
    w = [f"q{i}" for i in range(400)]
    cuts = [400, 390, 300, 180, 150, 131, 110, 66, 60, 34]
    rows = [(f"{c:03d}", " ".join(w[:c])) for c in cuts]
    sets = dict(zip((r[0] for r in rows), sets_of([r[1] for r in rows], 3)))
    want = {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.3}
    assert any(len(sets[b]) > 2 * len(sets[a]) for a, b in want)
    assert {(r.id_a, r.id_b) for r in D.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), 3, 0.3).collect()} == want


def test_common_runs_of_words_do_not_bring_texts_together(spark, monkeypatch):
    """Texts of few words share most single runs with others; what is compared must follow the similar pairs, not the texts squared."""
    random.seed(11)
    voc = [f"w{i}" for i in range(20)]
    rows = [(f"t{i:03d}", " ".join(random.choice(voc) for _ in range(300))) for i in range(300)]
    for i in range(0, 40, 2):
        w = rows[i][1].split()
        w[150] = "edited"
        rows[i + 1] = (rows[i + 1][0], " ".join(w))
    written, real = {}, D.materialize

    def recorded(df, name):
        out = real(df, name)
        lists = [f"size({c})" for c, kind in out.dtypes if kind == "array<bigint>"]
        written[name] = out.selectExpr(f"coalesce(sum({' + '.join(lists) or 1}), 0) AS n").first()[0]
        return out

    monkeypatch.setattr(D, "materialize", recorded)
    got = {(r.id_a, r.id_b) for r in D.near_duplicate_pairs(spark.createDataFrame(rows, "id string, text string"), 3, 0.7).collect()}
    ids = [i for i, _ in rows]
    sets = dict(zip(ids, sets_of([t for _, t in rows], 3)))
    want = {(a, b) for a, b in combinations(ids, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    assert len(want) == 20 and got == want
    assert sum(n for name, n in written.items() if name != "sets") < 10 * len(rows), written


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), min_size=1, max_size=120), st.sets(st.integers(0, 2**64 - 1), max_size=40), st.integers(0, 40), st.sampled_from([0.3, 0.5, 0.55, 0.7, 0.9, 1.0]), st.integers(0, 255))
def test_similar_sets_meet(base, extra, drop, t, seed):
    b = set(sorted(base, key=lambda x: x * 0x9E3779B97F4A7C15 % 2**64)[min(drop, len(base) - 1) :]) | extra
    x, y = (np.array(sorted(s), dtype=np.uint64) for s in (base, b))
    if len(base & b) < t * len(base | b) or base == b:
        return
    sig, row, need = D._signatures([x, y], t)
    order = lambda v: (v ^ np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)).tolist()
    kept = [set(sorted(order(sig[row == r]))[: need[r]]) for r in range(4)]
    assert len(kept[0] & kept[2]) >= D.SAME or kept[1] & kept[3]


def test_words_are_letters_and_digits():
    assert D._WORDS("a_b-c d1 é́x²٣ 語\n½") == ["a", "b", "c", "d1", "é", "x²٣", "語", "½"]
