"""Event logs as streams: chained hashes, running counts, trailing windows, silence.

State is kept per key and bounded: a chain keeps two values, a trailing window the
times inside it. Event-time windows at the end are offered beyond parity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspark.operators.events import GENESIS
from loomspark.sources import schemas


def read_stream(spark: SparkSession, path: str, schema: str = schemas.EVENT, fmt: str = "json", **options: str) -> DataFrame:
    """New files of a folder as they come."""
    return spark.readStream.schema(schema).format(fmt).options(**options).load(path)


def chain(events: DataFrame, log: str, order: str, payload: str) -> DataFrame:
    """(log, seq, prev_hash, event_hash, payload): every batch goes on where the log's chain stood."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, prev = state.get if state.exists else (0, GENESIS)
        rows = pd.concat(list(frames)).sort_values("o", kind="stable")
        out = []
        for body in rows["payload"]:
            h = hashlib.sha256((prev + (body or "")).encode()).hexdigest()
            out.append((key[0], seq, prev, h, body))
            seq, prev = seq + 1, h
        state.update((seq, prev))
        yield pd.DataFrame(out, columns=["log", "seq", "prev_hash", "event_hash", "payload"])

    rows = events.select(F.col(log).cast("string").alias("log"), F.col(order).alias("o"), F.col(payload).alias("payload"))
    return rows.groupBy("log").applyInPandasWithState(step, "log string, seq long, prev_hash string, event_hash string, payload string", "seq long, prev string", "append", GroupStateTimeout.NoTimeout)


def trailing_failures(events: DataFrame, key: str, ts: str, seconds: float = 300, threshold: int = 3, late: str = "1 day", forget: float = 86_400) -> DataFrame:
    """(key, ts, recent, triggered): failures of the key in the time before each, its own included.

    Times outside the window are forgotten, and a key altogether once the stream's time
    is `forget` seconds past its last failure; what comes more than `late` behind the
    stream's time is not counted.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        out = []
        for t in sorted(float(x) for f in frames for x in f["t"]):
            held = [x for x in held if x >= t - seconds] + [t]
            out.append((str(k[0]), t, len(held), len(held) >= threshold))
        state.update((held,))
        state.setTimeoutTimestamp(max(int((max(held) + max(forget, seconds)) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "t", "recent", "triggered"])

    t = F.col(ts).cast("timestamp")
    # a stream's time begins at 1970, and what is not after it counts as late: a millisecond keeps that moment itself
    rows = events.select(F.col(key).cast("string").alias("key"), t.cast("double").alias("t"), (t + F.expr("interval 1 millisecond")).alias("at")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(step, "key string, t double, recent int, triggered boolean", "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def phase_counts(events: DataFrame, phase: str) -> DataFrame:
    return events.groupBy(phase).agg(F.count("*").alias("n"))


def flag_leaks(prompts: DataFrame, answers: DataFrame) -> DataFrame:
    """A stream of texts (id, text) against the table of registered answers."""
    from loomspark.functions.text import normal_answer, segments

    seg = prompts.select("id", F.explode(segments(F.col("text"))).alias("s")).select("id", F.left(F.sha2(normal_answer(F.col("s")), 256), F.lit(16)).alias("answer_hash"))
    return seg.join(answers, "answer_hash").select("id", "question")


def windowed(events: DataFrame, ts: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling counts with a watermark (beyond parity)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))


def session_windows(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions by pause with a watermark (beyond parity)."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"))


def finalize(log: DataFrame, path: str, state: str, seq: str = "seq") -> DataFrame:
    """Ends a stream of chained records: writes what has come and not been written to `path`, and gives the verdict on every log's whole chain.

    (log, n, first_bad, valid) over all that is stored there, earlier runs included.
    """
    from loomspark.operators.events import verify_chain

    q = log.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return verify_chain(log.sparkSession.read.schema(log.schema).parquet(path))
