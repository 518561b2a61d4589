"""Problem 8: filling containers of fixed capacity with items.

Method: sum-of-squares online packing. A level array holds how many open
containers are filled to each level; an item goes to the level (or a new
container) that makes the sum of the squared counts smallest. Items are dealt to
shards of bounded size by a hash, each shard is packed by one task, and the items
of containers left under `full` are dealt to as few new shards of the same bound as
hold them and packed again, as long as a round saves containers. The first round
is online, in hash order; the later ones, which see leftovers only, know their
shard's items beforehand and take the large ones first (an offline order).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspark.session import materialize


def pack(sizes: list[int], capacity: int) -> list[int]:
    """The container of each item, in order; sizes are from 1 to `capacity`."""
    count = np.zeros(capacity + 1, dtype=np.int64)  # open containers by level
    held: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, n = [], 0
    for s in sizes:
        # moving a container from h to h + s adds 2 (count[h + s] - count[h]) + 2; a new one adds 2 count[s] + 1
        best, at = (2 * count[s] + 1 if s < capacity else 0), 0
        if s < capacity:
            source = count[1 : capacity - s + 1]
            change = 2 * (count[s + 1 : capacity + 1] - source) + 2
            change[-1] = 1 - 2 * source[-1]  # full containers do not count
            change[source == 0] = 1 << 40
            k = capacity - s - 1 - int(np.argmin(change[::-1]))  # of equal levels the fullest
            if change[k] < best or (change[k] == best and change[k] < 1 << 40):
                best, at = change[k], k + 1
        if at:
            c = held[at].pop()
            count[at] -= 1
        else:
            c, n = n, n + 1
        if at + s < capacity:
            held[at + s].append(c)
            count[at + s] += 1
        out.append(c)
    return out


#: Rounds go on while one saves at least this share of the containers it opened again.
LEAST_GAIN = 0.05


def _pack_shards(rows: DataFrame, shards: int, tag: int, capacity: int, kind: str) -> DataFrame:
    """One round: rows (item, piece, size, h) dealt to `shards` tasks by a hash of h and the round."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        order = ("size", "turn") if tag else ("turn", "size")
        t = pa.Table.from_batches(got).sort_by([(c, "descending" if tag and c == "size" else "ascending") for c in (*order, "item", "piece")])
        shard = t.column("shard")[0].as_py()
        sizes = t.column("size").to_numpy()
        at = np.asarray(pack(sizes.tolist(), capacity))
        used = np.bincount(at, weights=sizes).astype(np.int32)
        by = np.argsort(at, kind="stable")
        edge = np.searchsorted(at[by], np.arange(len(used)))
        pos = np.empty(len(at), dtype=np.int32)
        pos[by] = np.arange(len(at)) - edge[at[by]]
        out = pa.table({
            "container": pa.array([f"{tag}-{shard}-{c}" for c in at.tolist()]), "position": pa.array(pos), "item": t.column("item"),
            "piece": t.column("piece"), "size": t.column("size"), "used": pa.array(used[at]), "h": t.column("h"),
        })
        yield from out.to_batches(max_chunksize=50_000)

    turn = F.xxhash64("h", F.lit(tag))
    dealt = rows.select("item", "piece", "size", "h", turn.alias("turn"), F.pmod(turn, F.lit(shards)).cast("int").alias("shard"))
    return dealt.repartitionById(shards, F.col("shard")).mapInArrow(run, f"container string, position int, item {kind}, piece int, size int, used int, h long")


def pack_items(items: DataFrame, capacity: int = 2048, shard_rows: int = 50_000, full: float = 0.97, id_col: str = "doc_id", size_col: str = "n_tokens") -> DataFrame:
    """(container string, position int, id, piece int, size int, used int) of every item with a size over 0.

    An item over the capacity is cut: whole containers first, then one rest that is
    packed like an item (piece counts from 0). Null sizes and sizes of 0 or less are
    left out; repeated and null ids are packed as items of their own, and dealt out
    as such. In every round a shard holds some `shard_rows` items, whatever the
    data's size and however few containers fill up; leftovers that do not fit
    together (all a little over half, say) stay where they are.
    """
    kind = items.schema[id_col].dataType.simpleString()
    size = F.col(size_col).cast("long")
    n_whole = F.floor(size / capacity)
    cut = F.transform(F.sequence(F.lit(0).cast("long"), n_whole), lambda k: F.struct(k.cast("int").alias("piece"), F.least(F.lit(capacity).cast("long"), size - k * capacity).cast("int").alias("size")))
    parts = items.where(size > 0).select(F.col(id_col).alias("item"), F.explode(F.filter(cut, lambda p: p["size"] > 0)).alias("p"))
    rows = materialize(parts.select("item", "p.piece", "p.size").withColumn("h", F.xxhash64("item", "piece", F.monotonically_increasing_id())), "items")
    left, opened, rnd, done = rows.count(), None, 0, None
    while True:
        shards = max(1, -(-left // shard_rows))
        packed = materialize(_pack_shards(rows, shards, rnd, capacity, kind), "packed")
        is_open = F.col("used") < full * capacity
        got = packed.agg(F.count_if(is_open).alias("items"), F.count_if(is_open & (F.col("position") == 0)).alias("open"), F.count_if(F.col("position") == 0).alias("all")).first()
        last = shards == 1 or not got["items"] or (opened is not None and opened - got["all"] < LEAST_GAIN * opened)
        closed = packed if last else packed.where(~is_open)
        closed = closed.select("container", "position", F.col("item").alias(id_col), "piece", "size", "used")
        done = closed if done is None else done.unionByName(closed)
        if last:
            return done
        rows, left, opened = packed.where(is_open).select("item", "piece", "size", "h"), got["items"], got["open"]
        rnd += 1


def container_checks(packed: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """(id, within, whole, placed) of each item of `pack_items`.

    Whether its containers are within the capacity and used as they say, it is in one
    container unless it is larger (then in as few as it can be), and its places are
    different numbers under the container's count.
    """
    c = packed.groupBy("container").agg(F.sum("size").alias("sum"), F.max("used").alias("most"), F.min("used").alias("least"), F.count_distinct("position").alias("places"), F.max("position").alias("last"), F.count("*").alias("n"))
    c = c.select("container", ((F.col("sum") <= capacity) & (F.col("most") == F.col("sum")) & (F.col("least") == F.col("sum"))).alias("within"), ((F.col("places") == F.col("n")) & (F.col("last") == F.col("n") - 1)).alias("placed"))
    rows = packed.join(c, "container")
    whole = F.count_distinct("container") == F.ceil(F.sum("size") / capacity)
    return rows.groupBy(id_col).agg(F.bool_and("within").alias("within"), whole.alias("whole"), F.bool_and("placed").alias("placed"))
