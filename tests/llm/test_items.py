import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import cooccurrence as C, frequency as Q
from loomspark.llm.items import item_mentions

SCHEMA = "id string, concept_tags array<string>, key_terms array<struct<term:string,definition:string>>, field int, items string"
ROWS = [
    ("a", ["Flow_Rate", "flow - rate", None, " ", "heat"], [("  Wind  farm ", "x"), (None, "y")], 1, "?"),
    ("a", ["Flow_Rate", "flow - rate", None, " ", "heat"], [("  Wind  farm ", "x"), (None, "y")], 1, "?"),
    ("b", ["heat", "flow‑rate", "salt"], None, 2, None),
    ("c", [], [], 3, None), ("d", None, None, 4, None), (None, ["heat"], None, 5, None),
]


def exact_tail(n, q, m):
    """P(X >= n) by convolution of all trials."""
    dist = np.array([1.0])
    for qi, mi in zip(q, m):
        for _ in range(int(mi)):
            dist = np.convolve(dist, [1 - qi, qi])
    return dist[n:].sum()


def test_normalisation_and_clashing_columns(spark):
    got = {(r.id, r.field): sorted(r["items"]) for r in item_mentions(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert got[("a", "concept_tags")] == ["flow-rate", "flow-rate", "heat"]
    assert got[("a", "key_terms")] == ["wind farm"]
    assert got[("b", "concept_tags")] == ["flow-rate", "heat", "salt"]
    assert got[("c", "concept_tags")] == got[("d", "key_terms")] == []
    assert len(got) == 8  # ids once, the null id left out


def test_frequency_counts_occurrences_and_records(spark):
    freq = Q.item_frequency(item_mentions(spark.createDataFrame(ROWS, SCHEMA)))
    got = {(r.field, r["item"]): (r.occurrences, r.records) for r in freq.collect()}
    assert got == {("concept_tags", "flow-rate"): (3, 2), ("concept_tags", "heat"): (2, 2), ("concept_tags", "salt"): (1, 1), ("key_terms", "wind farm"): (1, 1)}


def test_frequency_splits_oversized_radix_parts(spark):
    rows = [(str(i), "f", [f"t{i % 700}", "hot", "hot"]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, field string, items array<string>").repartition(3)
    parts = Q.partial_counts(df)
    assert max(d for d, _ in Q.radix_parts(parts, 3)) > 1  # prefixes were split further
    got = {r["item"]: (r.occurrences, r.records) for r in Q.item_frequency(df, most_rows=3).collect()}
    assert got["hot"] == (6000, 3000) and len(got) == 701
    assert got == {"hot": (6000, 3000)} | {k: (v, v) for k, v in Counter(f"t{i % 700}" for i in range(3000)).items()}


def test_marks_compare_whole_numbers(spark):
    df = spark.createDataFrame([("f", "x", 9, 2), ("f", "y", 9, 3), ("f", "z", 9, 4), ("f", "w", 9, 5)], "field string, item string, occurrences long, records long")
    got = {r["item"]: r.mark for r in Q.mark_extremes(df, 200).collect()}
    assert got == {"x": "rare", "y": None, "z": None, "w": "common"}  # 4 of 200 is exactly 2 %


def test_empty_tables(spark):
    empty = item_mentions(spark.createDataFrame([], SCHEMA))
    assert Q.item_frequency(empty).count() == 0
    assert C.surprising_pairs(empty).count() == 0


def test_null_keeps_frequencies_and_sizes():
    d, k, s, m = np.array([1.0, 4, 30]), np.array([50.0, 20, 3]), np.array([1.0, 3, 8]), np.array([60.0, 32, 8])
    s = s * (d * k).sum() / (s * m).sum()
    x, y = C.fit_null(d, k, s, m)
    p = np.outer(x, y) / (1 + np.outer(x, y))
    assert np.allclose(p @ m, d, rtol=1e-6) and np.allclose(k @ p, s, rtol=1e-6)


@pytest.mark.parametrize("n", [1, 2, 4, 8, 15])
def test_tails_against_convolution(n):
    q, m = np.array([0.002, 0.01, 0.08]), np.array([100.0, 60, 20])
    mu, lp = C.upper_tail(np.array([n]), q[None, :], m)
    assert mu[0] == pytest.approx(q @ m)
    exact = exact_tail(n, q, m)
    if n > mu[0]:
        assert lp[0] == pytest.approx(math.log10(exact), abs=0.03)


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(3)
    baskets = [(f"c{i:03d}", "f", [f"w{int(x)}" for x in rng.zipf(1.6, rng.integers(0, 7)) if x < 60] + (["p", "q"] if i % 40 == 0 else [])) for i in range(400)]
    got = {(r.item_a, r.item_b): r for r in C.surprising_pairs(spark.createDataFrame(baskets, "id string, field string, items array<string>"), 5).collect()}
    n1, n2 = Counter(), Counter()
    for _, _, xs in baskets:
        u = sorted(set(xs))
        n1.update(u)
        n2.update(combinations(u, 2))
    want = {p: n for p, n in n2.items() if n >= 5}
    assert {p: r.n for p, r in got.items()} == want
    assert all(got[p].n_a == n1[p[0]] and got[p].n_b == n1[p[1]] for p in want)
    assert got[("p", "q")].discovery and got[("p", "q")].surprise > 6
    assert got[("p", "q")].baskets == sum(1 for b in baskets if b[2])


def test_pairs_of_large_baskets(spark):
    random.seed(12)
    sets = [sorted(random.sample([f"i{k:03d}" for k in range(700)], n)) for n in (600, 520, 300, 40, 2, 1)]
    want = {}
    for s in sets:
        for p in combinations(s, 2):
            want[p] = want.get(p, 0) + 1
    rows = [(f"b{i}", "f", s) for i, s in enumerate(sets)]
    baskets = spark.createDataFrame(rows, "bid string, field string, items array<string>")
    counts = baskets.select("field", F.explode("items").alias("item")).groupBy("field", "item").agg(F.count("*").alias("n"))
    got = {(r.item_a, r.item_b): r.n for r in C.pair_counts(baskets, 2, counts).collect()}
    often = {i for i in {x for s in sets for x in s} if sum(i in s for s in sets) >= 2}
    assert got == {p: n for p, n in want.items() if n >= 2 and set(p) <= often}


def test_the_null_meets_its_margins_or_says_so():
    d, k, s, m = np.array([2.0, 5.0, 9.0]), np.array([20.0, 6.0, 2.0]), np.array([1.0, 3.0, 8.0]), np.array([16.0, 10.0, 5.25])
    x, y = C.fit_null(d, k, s, m)
    assert C.null_residual(d, k, s, m, x, y) < 1e-6
    with pytest.raises(ValueError):
        C.fit_null(d, k, s, m, rounds=1)
