"""Problem 6: frequency of every distinct item, in occurrences and in records.

Method: recursive radix spilling. Every map task aggregates its own records with
DuckDB, so a term that fills a third of all rows leaves a task as one row. The
partial counts carry a 64-bit hash of the item and are written to the shared
folder. Prefixes of the hash then name the partitions: a prefix holding more
partial rows than `most_rows` is split by its next bits, again and again, until
each part fits; prefixes are rows that are joined, never lists on the driver. Each
part goes to one task, where DuckDB aggregates it out of core, spilling into the
shared folder where that is a file system, else into the scratch folders that the
cluster gave the executor (the ones Spark's own spills go to).
"""

from __future__ import annotations

import os
import uuid
from fractions import Fraction
from urllib.parse import urlparse

import duckdb
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspark.session import BROADCAST_ROWS, materialize, shared_dir

BITS = 8


def _duck(spill: str | None, memory: str = "512MB"):
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": memory})
    if spill:
        con.execute(f"SET temp_directory = '{spill}/{uuid.uuid4().hex}'").fetchall()
    return con


def _shared_path(spark) -> str | None:
    """The shared folder as a path for DuckDB; None where it is no file system."""
    url = urlparse(shared_dir(spark))
    if url.scheme not in ("", "file"):
        return None
    path = f"{url.path}/loomspark/duckdb"
    os.makedirs(path, exist_ok=True)
    return path


def _scratch() -> str | None:
    """The executor's own scratch folder, as its cluster manager has set it; None where none is set."""
    for name in ("SPARK_EXECUTOR_DIRS", "LOCAL_DIRS", "SPARK_LOCAL_DIRS"):
        for path in os.environ.get(name, "").replace(os.pathsep, ",").split(","):
            if path and os.path.isdir(path):
                return path
    return None


def partial_counts(mentions: DataFrame, flush_rows: int = 300_000) -> DataFrame:
    """(field, item, occurrences, records, h): counts within a task, h = xxhash64(item)."""

    def run(batches):
        con = _duck(None)
        con.execute("CREATE TABLE part (field VARCHAR, item VARCHAR, occurrences BIGINT, records BIGINT)").fetchall()
        held = 0

        def flush():
            got = con.sql("SELECT field, item, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY ALL").to_arrow_table()
            con.execute("DELETE FROM part").fetchall()
            return got.to_batches(max_chunksize=50_000)

        for batch in batches:
            rec = pa.table({"field": batch.column("field"), "items": batch.column("items")})  # noqa: F841
            con.execute(
                "INSERT INTO part SELECT field, item, sum(n), count(*) FROM (SELECT r, field, item, count(*) AS n FROM "
                "(SELECT r, field, unnest(items) AS item FROM (SELECT row_number() OVER () AS r, * FROM rec)) GROUP BY ALL) GROUP BY field, item"
            ).fetchall()
            held = con.execute("SELECT count(*) FROM part").fetchall()[0][0]
            if held > flush_rows:
                yield from flush()
        yield from flush()
        con.close()

    out = mentions.select("field", "items").mapInArrow(run, "field string, item string, occurrences long, records long")
    return out.withColumn("h", F.xxhash64("item"))


def _radix(h, depth: int):
    """The first depth * BITS bits of the hash, as a number that tells depths apart."""
    return F.shiftrightunsigned(h, 64 - BITS * depth)


def radix_depths(parts: DataFrame, most_rows: int) -> DataFrame:
    """The rows with depth: by how many times BITS bits of the hash they are parted, so that no part has more than `most_rows` rows.

    A part of one hash alone cannot be split and is left at the last depth; it has one
    row for each task that met the item.
    """
    rows, depth = parts.withColumn("depth", F.lit(1)), 1
    while depth < 64 // BITS:
        own = rows.where(F.col("depth") == depth)
        over = own.groupBy(_radix(F.col("h"), depth).alias("_p")).count().where(F.col("count") > most_rows).select("_p", F.lit(depth + 1).alias("_d"))
        over = materialize(over, "oversized")
        n = over.count()
        if not n:
            break
        over = F.broadcast(over) if n <= BROADCAST_ROWS else over
        rows = rows.join(over, (F.col("depth") == depth) & (_radix(F.col("h"), depth) == F.col("_p")), "left").withColumn("depth", F.coalesce("_d", "depth")).drop("_p", "_d")
        depth += 1
    return rows


def radix_parts(parts: DataFrame, most_rows: int) -> list[tuple[int, int]]:
    """(depth, prefix) of every part of a small table, to look at; item_frequency itself keeps them as rows."""
    rows = radix_depths(parts, most_rows)
    prefix = F.element_at(F.array(*[_radix(F.col("h"), d) for d in range(1, 64 // BITS + 1)]), F.col("depth"))
    return [(r["depth"], r["p"]) for r in rows.select("depth", prefix.alias("p")).distinct().collect()]


def item_frequency(mentions: DataFrame, most_rows: int = 400_000) -> DataFrame:
    """(field, item, occurrences, records) of every distinct item of (field, items) rows.

    An empty table gives no rows. Items are compared as they are given.
    """
    spark = mentions.sparkSession
    shared = _shared_path(spark)
    parts = materialize(partial_counts(mentions), "term-partials")
    n = max(1, -(-parts.count() // most_rows))
    if n > 1:
        n *= 2  # parts are dealt to tasks by a hash: half a part each, on average
    part = F.xxhash64("depth", F.element_at(F.array(*[_radix(F.col("h"), d) for d in range(1, 64 // BITS + 1)]), F.col("depth")))
    routed = radix_depths(parts, most_rows).withColumn("pid", F.pmod(part, F.lit(n)).cast("int"))

    def total(batches):
        con = _duck(shared or _scratch())
        con.execute("CREATE TABLE part (field VARCHAR, item VARCHAR, occurrences BIGINT, records BIGINT)").fetchall()
        for batch in batches:
            rec = pa.Table.from_batches([batch])  # noqa: F841
            con.execute("INSERT INTO part SELECT field, item, occurrences, records FROM rec").fetchall()
        got = con.sql("SELECT field, item, sum(occurrences)::BIGINT AS occurrences, sum(records)::BIGINT AS records FROM part GROUP BY ALL")
        yield from got.to_arrow_table().to_batches(max_chunksize=50_000)
        con.close()

    placed = routed.select("field", "item", "occurrences", "records", "pid").repartitionById(n, F.col("pid"))
    return placed.drop("pid").mapInArrow(total, "field string, item string, occurrences long, records long")


def mark_extremes(freq: DataFrame, n_records: int, rare_below: int = 3, common_share: float = 0.02) -> DataFrame:
    """Adds mark: `rare` under `rare_below` records, `common` above the share of all records, else null."""
    share = Fraction(str(common_share))  # compared in whole numbers, so that exactly the share is not above it
    common = F.col("records") * share.denominator > F.lit(share.numerator) * F.lit(n_records)
    mark = F.when(F.col("records") < rare_below, "rare").when(common, "common")
    return freq.withColumn("mark", mark)
