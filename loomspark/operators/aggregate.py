"""Aggregations: statistics, shares, entropy, coverage, quality reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def grouped_counts(df: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row for each value of each key, and a total: (dimension, value, measures). One pass by grouping sets; null values are `unspecified`."""
    filled = df.select(*[F.coalesce(F.col(k), F.lit("unspecified")).alias(f"_k{i}") for i, k in enumerate(keys)], *[c.alias(f"_m{i}") for i, c in enumerate(measures.values())])
    names = [F.col(f"_k{i}") for i in range(len(keys))]
    g = filled.groupingSets([[n] for n in names] + [[]], *names).agg(F.count("*").alias("n"), *[F.sum(f"_m{i}").alias(m) for i, m in enumerate(measures)])
    which = reduce(lambda w, i: F.when(F.col(f"_k{i}").isNotNull(), F.lit(keys[i].split(".")[-1])).otherwise(w), reversed(range(len(keys))), F.lit("total"))
    return g.select(which.alias("dimension"), F.coalesce(*names, F.lit("all")).alias("value"), "n", *measures)


def share_where(**conditions: Column) -> list[Column]:
    """Share of rows for which each condition holds (null counts as not)."""
    return [F.avg(F.when(c, 1.0).otherwise(0.0)).alias(n) for n, c in conditions.items()]


def entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n_values, entropy, normalized): base 2, by log2 of the number of values; 0 for one value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    p = counts.withColumn("p", F.col("c") / F.sum("c").over(w))
    out = p.groupBy(*keys).agg(F.count("*").alias("n_values"), (-F.sum(F.col("p") * F.log2("p"))).alias("entropy"))
    return out.withColumn("normalized", F.when(F.col("n_values") > 1, F.col("entropy") / F.log2("n_values")).otherwise(F.lit(0.0)))


def weighted_mean(x: str, w: str) -> Column:
    return F.sum(F.col(x) * F.col(w)) / F.sum(w)


def upper_median(c: str, values: list[int]) -> Column:
    """The element at n div 2 of the sorted values, which are among the few whole numbers given: counted, not gathered."""
    counts = F.array(*[F.struct(F.count_if(F.col(c) == v).alias("n"), F.lit(v).alias("v")) for v in sorted(values)])
    start = F.struct(F.lit(0).cast("long").alias("below"), F.lit(None).cast("int").alias("at"))
    middle = F.floor(F.count(c) / 2)

    def step(acc, x):
        here = acc["at"].isNull() & (acc["below"] + x["n"] > middle)
        return F.struct((acc["below"] + x["n"]).alias("below"), F.when(here, x["v"]).otherwise(acc["at"]).alias("at"))

    return F.aggregate(counts, start, step, lambda acc: acc["at"])


def completeness(df: DataFrame, phase: str, minima: DataFrame, adequate: Column, most_bad: float = 0.2) -> DataFrame:
    """(phase, n, minimum, inadequate_share, complete): enough events and not too many inadequate ones."""
    g = df.groupBy(F.col(phase).alias("phase")).agg(F.count("*").alias("n"), F.avg(F.when(adequate, 0.0).otherwise(1.0)).alias("inadequate_share"))
    j = minima.join(g, "phase", "left").na.fill({"n": 0, "inadequate_share": 0.0})
    return j.withColumn("complete", (F.col("n") >= F.col("minimum")) & (F.col("inadequate_share") <= most_bad))


def merkle_root(hashes: DataFrame, order: str, value: str, fan: int = 2) -> DataFrame:
    """(root): pairs of neighbouring hashes are hashed together, an odd last one with itself, until one is left.

    Each round halves the rows by one aggregation on the row's number; the number is
    a dense one made once, by a range partitioning of `order`.
    """
    from loomspark.session import materialize

    ranked = number_rows(hashes.select(F.col(order).alias("o"), F.col(value).alias("h")), "o").select("i", "h")
    n = ranked.count()
    if n == 1:
        return ranked.select("h").withColumnRenamed("h", "root")
    rounds = 0
    while n > 1:
        pair = F.array_sort(F.collect_list(F.struct("i", "h")))
        ranked = ranked.groupBy(F.floor(F.col("i") / fan).alias("i")).agg(pair.alias("p"))
        left, right = F.col("p")[0]["h"], F.coalesce(F.get(F.col("p"), F.lit(1))["h"], F.col("p")[0]["h"])
        ranked = ranked.select("i", F.sha2(F.concat(left, right), 256).alias("h"))
        n, rounds = -(-n // fan), rounds + 1
        if rounds % 6 == 0:
            ranked = materialize(ranked, "merkle")
    return ranked.select(F.col("h").alias("root"))


def number_rows(df: DataFrame, order: str) -> DataFrame:
    """Adds i, the row's place from 0 in a total order, without one task that sees all rows.

    Rows are range partitioned and sorted; the sizes of the partitions (one number
    each) give every partition its first place.
    """
    from loomspark.session import materialize

    parts = materialize(df.repartitionByRange(F.col(order)).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = {r["_p"]: r["count"] for r in parts.groupBy("_p").count().collect()}
    start, starts = 0, {}
    for p in sorted(sizes):
        starts[p] = start
        start += sizes[p]
    offset = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[F.col("_p")] if starts else F.lit(0)
    w = Window.partitionBy("_p").orderBy(order)
    return parts.withColumn("i", (offset + F.row_number().over(w) - 1).cast("long")).drop("_p")


def number_in_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds i, the row's place from 0 within its group in order, without a task that sees a whole group.

    Rows are range partitioned by keys and order; what a group holds in the partitions
    before (a number for each group and partition) gives every part its first place.
    """
    from loomspark.session import materialize

    parts = materialize(df.repartitionByRange(*keys, order).withColumn("_p", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))  # a group stands in few partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    before = before.select("_before", F.col("_p").alias("_q"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_p") == F.col("_q")]
    j = parts.join(before, on, "left").drop("_q", *[f"_k{i}" for i in range(len(keys))])
    w = Window.partitionBy(*keys, "_p").orderBy(order)
    return j.withColumn("i", (F.col("_before") + F.row_number().over(w) - 1).cast("long")).drop("_p", "_before")
