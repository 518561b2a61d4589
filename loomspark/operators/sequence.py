"""Operators on ordered rows: neighbours, chains, resetting sums, runs, headings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.operators.aggregate import number_in_groups
from loomspark.session import materialize


def with_neighbours(df: DataFrame, keys: list[str], order: list, text: str) -> DataFrame:
    """prev_text and next_text, '' at the ends."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("prev_text", F.lag(text, 1, "").over(w)).withColumn("next_text", F.lead(text, 1, "").over(w))


def link_and_number(df: DataFrame, lesson: Column, module: Column, order: list) -> DataFrame:
    """follows (the id before it in its lesson) and position (from 0 in its module)."""
    return df.withColumn("follows", F.lag("id").over(Window.partitionBy(lesson).orderBy(*order))).withColumn("position", F.row_number().over(Window.partitionBy(module).orderBy(*order)) - 1)


def chain_depth(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, root, depth) by pointer doubling over (id, parent): n steps in log2(n) joins.

    A parent that is not a row, and a null one, make a root. Rows on a cycle get a null root.
    """
    ids = links.select(F.col("id").alias("pid"))
    p = links.join(ids, links["parent"] == ids["pid"], "left").select("id", F.col("pid").alias("up"))
    state = materialize(p.select("id", F.coalesce("up", "id").alias("at"), F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("up").isNull().alias("done")), "chain")
    for _ in range(rounds):
        if state.where("not done").isEmpty():
            break
        nxt = state.select(F.col("id").alias("at"), F.col("at").alias("at2"), F.col("depth").alias("d2"), F.col("done").alias("done2"))
        step = state.where("not done").join(nxt, "at").select("id", F.col("at2").alias("at"), (F.col("depth") + F.col("d2")).alias("depth"), F.col("done2").alias("done"))
        state = materialize(state.where("done").unionByName(step), "chain")
    return state.select("id", F.when(F.col("done"), F.col("at")).alias("root"), F.when(F.col("done"), F.col("depth")).alias("depth"))


def pack_greedily(sizes: Column, limit: int) -> Column:
    """Group number of each element: a new group where the running sum would exceed the limit (an element over it stands alone)."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        fresh = (acc["group"] < 0) | (acc["sum"] + x > limit)
        group = F.when(fresh, acc["group"] + 1).otherwise(acc["group"])
        return F.struct(F.when(fresh, x.cast("long")).otherwise(acc["sum"] + x).alias("sum"), group.alias("group"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(sizes, start, step, lambda acc: acc["out"])


def runs(df: DataFrame, keys: list[str], order: str, same: Column) -> DataFrame:
    """run: number of the maximal stretch of rows for which `same` does not change."""
    w = Window.partitionBy(*keys).orderBy(order)
    change = F.when(same.eqNullSafe(F.lag(same).over(w)), 0).otherwise(1)
    return df.withColumn("_c", change).withColumn("run", F.sum("_c").over(w)).drop("_c")


def groups_from(df: DataFrame, keys: list[str], order: str, boundary: Column) -> DataFrame:
    """group: grows at each row that is a boundary."""
    return df.withColumn("group", F.sum(F.when(boundary, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy(order)))


def heading_parents(df: DataFrame, keys: list[str], order: str, level: str, id_col: str, levels: int = 6) -> DataFrame:
    """parent: the last heading before it that is of a lower level number and not closed by a heading in between."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = {k: F.last(F.when(F.col(level) == k, F.struct(F.col(order).alias("o"), F.col(id_col).alias("h"))), ignorenulls=True).over(w) for k in range(1, levels + 1)}
    df = reduce(lambda acc, kv: acc.withColumn(f"_l{kv[0]}", kv[1]), last.items(), df)
    open_ = [F.when(F.col(level) > k, F.col(f"_l{k}")) for k in range(1, levels)]
    return df.withColumn("parent", F.greatest(*open_)["h"]).drop(*[f"_l{k}" for k in last])


def weeks_of(df: DataFrame, keys: list[str], order: str, weeks: int, most: int = 12) -> DataFrame:
    """week from 1: `most` rows a week in order, what is left over in the last one. A group may be of any size."""
    return number_in_groups(df, keys, order).withColumn("week", F.least(F.floor(F.col("i") / most) + 1, F.lit(weeks)).cast("int")).drop("i")
