"""Problem 1: items that appear together, and how far that exceeds chance.

Method: exact pair counts against a fitted bipartite configuration model. The
null has one parameter per item frequency and one per basket size; an item of
frequency d is in a basket of size s with probability x_d y_s / (1 + x_d y_s),
fitted so that expected frequencies and sizes equal the observed ones. Under it
the number of baskets with both items is Poisson-binomial; its upper tail comes
from the saddlepoint (Lugannani-Rice) formula, and Benjamini-Hochberg control
over all possible pairs of a field turns the tails into discoveries.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from loomspark.session import BROADCAST_ROWS, materialize

#: Values up to EXACT have a class of their own; larger ones share logarithmic classes 0.1 % wide,
#: so that the null has at most some 20,000 classes whatever the size of the data.
EXACT, WIDTH = 1024, 0.001
#: Larger baskets are cut into blocks of so many items, and every pair of blocks is a row of its own.
BLOCK = 256
#: Most that an expected frequency or size of the fitted null may be off, as a share.
OFF = 1e-3


def _class(c):
    """The class of a frequency or size: itself, or a negative number for a logarithmic class."""
    return F.when(c <= EXACT, c.cast("long")).otherwise(-F.floor(F.log(c / F.lit(float(EXACT))) / WIDTH) - 1)


def fit_null(d: np.ndarray, k: np.ndarray, s: np.ndarray, m: np.ndarray, rounds: int = 2000, tol: float = 1e-9) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (x, y): k items of frequency d, m baskets of size s; fixed-point iteration.

    Raises if the expected frequencies or sizes are still off by more than OFF. An item
    in every basket, and a basket of every item, has no finite parameter and is not measured.
    """
    total = float((d * k).sum()) or 1.0
    x, y = d / math.sqrt(total), s / math.sqrt(total)
    for _ in range(rounds):
        nx = d / ((m * y)[None, :] / (1 + np.outer(x, y))).sum(axis=1)
        ny = s / ((k * nx)[:, None] / (1 + np.outer(nx, y))).sum(axis=0)
        nx, ny = np.minimum(nx, 1e12), np.minimum(ny, 1e12)  # an item in every basket has no finite parameter
        off = max(np.max(np.abs(nx / x - 1), initial=0), np.max(np.abs(ny / y - 1), initial=0))
        x, y = nx, ny
        if off < tol:
            break
    residual = null_residual(d, k, s, m, x, y)
    if residual > OFF:
        raise ValueError(f"the null did not converge: margins are off by {residual:.2e} after {rounds} rounds")
    return x, y


def null_residual(d, k, s, m, x, y) -> float:
    """The largest relative difference of expected and observed frequencies and sizes."""
    p = np.outer(x, y) / (1 + np.outer(x, y))
    rows, cols = np.abs(p @ m / d - 1)[(d < m.sum() - 0.5) & (x < 1e11)], np.abs(k @ p / s - 1)[(s < k.sum() - 0.5) & (y < 1e11)]
    return float(max(np.max(rows, initial=0.0), np.max(cols, initial=0.0)))


def _log_mills_term(w: np.ndarray, u: np.ndarray) -> np.ndarray:
    """log(Q(w) / phi(w) + 1/u - 1/w) for w > 0."""
    t = 1.0 / (1.0 + 0.5 * w / math.sqrt(2))  # argument z = w / sqrt(2)
    poly = -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))
    mills = t * np.exp(poly) * math.sqrt(math.pi / 2)  # from exp(z^2) erfc(z), relative error under 1.2e-7
    excess = np.where(w > 12, -1 / w**3 + 3 / w**5, mills - 1 / w)
    return np.log(np.maximum(1 / u + excess, 1e-300))


def upper_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(expected count, log10 P(X >= n)) for X a sum over classes of Binomial(m, q); q is (rows, classes)."""
    mu = q @ m
    out = np.zeros(len(n))
    above = n > mu + 1e-9
    if not above.any():
        return mu, out
    qa, na = q[above], n[above].astype(float)
    certain = na >= m.sum() - 0.5
    odds = qa / np.maximum(1 - qa, 1e-15)
    nt = np.minimum(na, m.sum() - 0.5)  # the tail's point has an infinite saddlepoint only at the very end
    t = np.log(nt / np.maximum(mu[above], 1e-300))
    for _ in range(60):
        e = odds * np.exp(np.minimum(t, 300))[:, None]
        p = e / (1 + e)
        k1, k2 = p @ m, (p * (1 - p)) @ m
        step = (k1 - nt) / np.maximum(k2, 1e-300)
        t = np.maximum(t - np.clip(step, -2, 2), 1e-9)
        if np.max(np.abs(step)) < 1e-10:
            break
    e = odds * np.exp(np.minimum(t, 300))[:, None]
    p = e / (1 + e)
    k0 = (np.log1p(e) - np.log1p(odds)) @ m
    k2 = np.maximum((p * (1 - p)) @ m, 1e-300)
    w = np.sqrt(np.maximum(2 * (t * nt - k0), 1e-18))
    u = -np.expm1(-t) * np.sqrt(k2)
    log_p = -w * w / 2 - 0.5 * math.log(2 * math.pi) + _log_mills_term(w, u)
    every = np.log(np.maximum(qa, 1e-300)) @ m
    log_p = np.where(certain, every, log_p)
    near = w < 0.05  # the formula is 0/0 at the mean
    log_p = np.where(near, math.log(0.5), log_p)
    out[above] = np.minimum(log_p, 0) / math.log(10)
    return mu, out


def _pairs_within(rows: DataFrame) -> DataFrame:
    """(field, item_a, item_b) of the pairs inside each row's sorted items."""
    first = rows.select("field", "items", F.posexplode("items").alias("i", "item_a")).where(F.col("i") + 1 < F.size("items"))
    return first.select("field", "item_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("item_b"))


def pair_counts(baskets: DataFrame, min_count: int, counts: DataFrame) -> DataFrame:
    """(field, item_a, item_b, n): baskets holding both, item_a < item_b by code point, n >= min_count.

    Items in fewer than `min_count` baskets cannot be in such a pair and are left
    out first; the rest are counted with map-side aggregation.
    """
    often = counts.where(F.col("n") >= min_count).select(F.col("field").alias("f2"), F.col("item").alias("i2"))
    n = often.count()
    side = F.broadcast(often) if n <= BROADCAST_ROWS else often
    one = baskets.select("bid", "field", F.explode("items").alias("item"))
    kept = one.join(side, (F.col("field") == F.col("f2")) & (F.col("item") == F.col("i2")), "left_semi")
    again = kept.groupBy("bid", "field").agg(F.array_sort(F.collect_list("item")).alias("items")).where(F.size("items") > 1)
    within = _pairs_within(again.where(F.size("items") <= BLOCK))
    # larger baskets: the pairs inside each block, and those across two blocks, dealt out to tasks
    large = again.where(F.size("items") > BLOCK)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("items") - 1) / BLOCK).cast("int")), lambda k: F.slice("items", k * BLOCK + 1, F.lit(BLOCK)))
    own = large.select("bid", "field", F.posexplode(blocks).alias("k", "items"))
    two = large.select("bid", "field", blocks.alias("b")).select("bid", "field", "b", F.posexplode("b").alias("k", "left"))
    two = two.select("bid", "field", "k", "left", F.posexplode("b").alias("j", "right")).where("j > k").repartition("bid", "k", "j")
    across = two.select("field", F.explode("left").alias("item_a"), "right").select("field", "item_a", F.explode("right").alias("item_b"))
    pairs = within.unionByName(_pairs_within(own.repartition("bid", "k"))).unionByName(across)
    return pairs.groupBy("field", "item_a", "item_b").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def surprising_pairs(mentions: DataFrame, min_count: int = 5, alpha: float = 0.05) -> DataFrame:
    """Every pair of items that shares at least `min_count` baskets, with its surprise.

    Input (id, field, items array<string>), one row per basket and field; an item
    counts once per basket, null items are dropped. Output (field, item_a,
    item_b, n, n_a, n_b, baskets, expected, surprise, discovery): baskets is the
    number of non-empty baskets of the field, expected the null's mean, surprise
    -log10 of the tail, discovery whether the pair passes Benjamini-Hochberg at
    `alpha` among all pairs of items of the field (pairs not listed count as p = 1).
    Empty input gives no rows.
    """
    spark = mentions.sparkSession
    items = F.array_distinct(F.filter("items", lambda x: x.isNotNull()))
    baskets = mentions.select(F.col("id").alias("bid"), "field", items.alias("items")).where(F.size("items") > 0)
    baskets = materialize(baskets, "baskets")
    counts = materialize(baskets.select("field", F.explode("items").alias("item")).groupBy("field", "item").agg(F.count("*").alias("n")), "item-counts")

    degree = counts.groupBy("field", _class(F.col("n")).alias("c")).agg(F.count("*").alias("k"), F.avg("n").alias("v")).collect()
    sizes = baskets.groupBy("field", _class(F.size("items")).alias("c")).agg(F.count("*").alias("k"), F.avg(F.size("items")).alias("v")).collect()
    null: dict[str, tuple] = {}
    for f in sorted({r["field"] for r in degree}):
        dr, sr = [r for r in degree if r["field"] == f], [r for r in sizes if r["field"] == f]
        d, k = np.array([r["v"] for r in dr]), np.array([r["k"] for r in dr], dtype=float)
        s, m = np.array([r["v"] for r in sr]), np.array([r["k"] for r in sr], dtype=float)
        x, y = fit_null(d, k, s, m)
        null[f] = ({r["c"]: v for r, v in zip(dr, x)}, y, m, int(k.sum()))
    model = spark.sparkContext.broadcast(null)

    a = counts.select(F.col("field").alias("fa"), F.col("item").alias("ia"), F.col("n").alias("n_a"))
    b = counts.select(F.col("field").alias("fb"), F.col("item").alias("ib"), F.col("n").alias("n_b"))
    pairs = pair_counts(baskets, min_count, counts)
    pairs = pairs.join(a, (F.col("field") == F.col("fa")) & (F.col("item_a") == F.col("ia"))).join(b, (F.col("field") == F.col("fb")) & (F.col("item_b") == F.col("ib")))
    pairs = pairs.select("field", "item_a", "item_b", "n", "n_a", "n_b", _class(F.col("n_a")).alias("ca"), _class(F.col("n_b")).alias("cb"))

    def score(frames):
        for pdf in frames:
            pdf["expected"], pdf["surprise"], pdf["baskets"] = 0.0, 0.0, 0
            for f, own in pdf.groupby("field", sort=False):
                x_of, y, m, _ = model.value[f]
                xa = own["ca"].map(x_of).to_numpy(float)[:, None] * y[None, :]
                xb = own["cb"].map(x_of).to_numpy(float)[:, None] * y[None, :]
                mu, lp = upper_tail(own["n"].to_numpy(), xa / (1 + xa) * (xb / (1 + xb)), m)
                pdf.loc[own.index, "expected"], pdf.loc[own.index, "surprise"] = mu, -lp
                pdf.loc[own.index, "baskets"] = int(m.sum())
            yield pdf[["field", "item_a", "item_b", "n", "n_a", "n_b", "baskets", "expected", "surprise"]]

    scored = materialize(pairs.mapInPandas(score, "field string, item_a string, item_b string, n long, n_a long, n_b long, baskets long, expected double, surprise double"), "pairs")

    # Benjamini-Hochberg over bins of surprise a hundredth wide, taken at the lower edge: never more than alpha.
    bins = scored.groupBy("field", F.least(F.floor(F.col("surprise") * 100), F.lit(100_000)).alias("b")).count().collect()
    passed = F.lit(False)
    for f, (_, _, _, n_items) in null.items():
        tests, seen = n_items * (n_items - 1) / 2, 0
        cut = None
        for r in sorted((r for r in bins if r["field"] == f), key=lambda r: -r["b"]):
            seen += r["count"]
            if 10 ** (-r["b"] / 100) <= seen * alpha / max(tests, 1):
                cut = r["b"]
        if cut is not None:
            passed = passed | ((F.col("field") == f) & (F.floor(F.col("surprise") * 100) >= cut))
    return scored.withColumn("discovery", passed)
