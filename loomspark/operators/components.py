"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomspark.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node reachable from it.

    Alternates large-star and small-star rewrites, which shorten every path by
    hooking neighbours to the least one seen, until no edge changes; each round is
    written as a table, so the plan stays short and executors may be lost. Self
    loops are kept as nodes; null ends are left out; an empty table gives no rows.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b")).distinct()
    e = materialize(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select("b", "m", "a")
        e = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    root = e.groupBy("a").agg(F.min("b").alias("r"))
    return nodes.join(root, nodes["node"] == root["a"], "left").select("node", F.coalesce("r", "node").alias("component"))
