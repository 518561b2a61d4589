"""Operators on event logs: trailing windows, heartbeats, summaries, hash chains, differences of runs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def micros(c: Column | str) -> Column:
    """Microseconds since 1970, of a time with or without zone (read as the session's)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def trailing_count(df: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """recent: rows of the same keys in the `seconds` up to this one, its peers included."""
    w = Window.partitionBy(*keys).orderBy(micros(ts)).rangeBetween(-seconds * 1_000_000, 0)
    return df.withColumn("recent", F.count("*").over(w))


def error_summary(df: DataFrame, key: str, ts: str, who: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(who).alias("n_tasks"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"))


def silent_since(df: DataFrame, worker: str, ts: str, now: Column, seconds: float) -> DataFrame:
    """Workers whose last sign of life is more than `seconds` before `now`."""
    last = df.groupBy(worker).agg(F.max(ts).alias("last_seen"))
    quiet = micros(now) - micros("last_seen")
    return last.withColumn("silent_seconds", quiet / 1e6).where(F.col("silent_seconds") > seconds)


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """(key, session, n, start, end): a new session after a pause longer than the gap. (Offered beyond parity.)"""
    w = Window.partitionBy(key).orderBy(ts)
    pause = micros(ts) - micros(F.lag(ts).over(w))
    s = df.withColumn("_n", F.when(pause > gap_seconds * 1_000_000, 1).otherwise(0)).withColumn("session", F.sum("_n").over(w))
    return s.groupBy(key, "session").agg(F.count("*").alias("n"), F.min(ts).alias("start"), F.max(ts).alias("end"))


def full_diff(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, before, after, change): added, removed, modified or same, by a full outer join."""
    x, y = a.select(*key, F.col(value).alias("before"), F.lit(True).alias("_a")), b.select(*key, F.col(value).alias("after"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("modified")
    return x.join(y, key, "full_outer").select(*key, "before", "after", change.alias("change"))


GENESIS = "genesis"


def append_chain(events: DataFrame, log: str, order: str, payload: str) -> DataFrame:
    """(log, seq, prev_hash, event_hash, payload): each hash is of the one before it and the payload.

    A fold: every log is read in order by one task, batch by batch, so a long log
    costs time but no memory. Logs are shuffled by name and sorted inside tasks.
    """
    placed = events.select(F.col(log).cast("string").alias("log"), F.col(order).alias("o"), F.col(payload).alias("payload")).repartition("log").sortWithinPartitions("log", "o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, prev, seq = None, GENESIS, 0
        for pdf in frames:
            out = []
            for name, body in zip(pdf["log"], pdf["payload"]):
                if name != current:
                    current, prev, seq = name, GENESIS, 0
                h = hashlib.sha256((prev + (body or "")).encode()).hexdigest()
                out.append((name, seq, prev, h, body))
                prev, seq = h, seq + 1
            yield pd.DataFrame(out, columns=["log", "seq", "prev_hash", "event_hash", "payload"])

    return placed.mapInPandas(run, "log string, seq long, prev_hash string, event_hash string, payload string")


def verify_chain(chain: DataFrame) -> DataFrame:
    """(log, n, first_bad, valid): a gap in seq, a wrong previous hash or a wrong hash is bad."""
    w = Window.partitionBy("log").orderBy("seq")
    bad = (F.col("seq") != F.row_number().over(w) - 1) | (F.col("prev_hash") != F.lag("event_hash", 1, GENESIS).over(w)) | (F.col("event_hash") != F.sha2(F.concat("prev_hash", F.coalesce("payload", F.lit(""))), 256))
    rows = chain.withColumn("bad", F.coalesce(bad, F.lit(True)))
    return rows.groupBy("log").agg(F.count("*").alias("n"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("first_bad")).withColumn("valid", F.col("first_bad").isNull())


def first_records(df: DataFrame, parts: list[Column], order: list) -> DataFrame:
    """One record of each content: the first in order among those whose parts are equal."""
    h = df.withColumn("content_hash", F.left(F.sha2(F.concat_ws("\u001f", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), F.lit(12)))
    w = Window.partitionBy("content_hash").orderBy(*order)
    return h.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
