"""Runs of a pipeline: manifests, checkpoints, locks, integrity, replay, summaries, limits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomspark.operators.events import verify_chain

# Fields that records must have.
MANIFEST_FIELDS = ["run_id", "created_at", "workflow_type"]
CHECKPOINT_FIELDS = ["run_id", "phase_name", "status"]
DECISION_FIELDS = ["run_id", "timestamp", "operation", "decision_type", "decision", "rationale"]


def _issues(df: DataFrame, rules: list[tuple[str, str, Column]], run: str, path: str) -> DataFrame:
    """(run_id, severity, category, path) of the rules that hold."""
    found = F.filter(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(n).alias("category"))) for s, n, c in rules]), lambda x: x.isNotNull())
    return df.select(F.col(run).cast("string").alias("run_id"), F.col(path).cast("string").alias("path"), F.explode(found).alias("x")).select("run_id", "x.severity", "x.category", "path")


def manifest_issues(manifests: DataFrame, run: str = "dir_run", path: str = "path") -> DataFrame:
    """Manifests with a missing field, another run's id, or not marked immutable."""
    rules = [("error", f"missing {f}", F.col(f).isNull()) for f in MANIFEST_FIELDS if f in manifests.columns]
    rules.append(("warning", "other run", ~F.coalesce(F.col("run_id").cast("string") == F.col(run).cast("string"), F.lit(False))))
    if "immutable" in manifests.columns:
        rules.append(("warning", "not immutable", ~F.coalesce("immutable", F.lit(True))))
    return _issues(manifests, rules, run, path)


def checkpoint_issues(checkpoints: DataFrame, path: str = "path") -> DataFrame:
    """Checkpoints with a missing field, and phases begun and never completed."""
    rules = [("warning", f"missing {f}", F.col(f).isNull()) for f in CHECKPOINT_FIELDS if f in checkpoints.columns] + [("warning", "incomplete phase", F.coalesce(F.col("status") == "started", F.lit(False)))]
    return _issues(checkpoints, rules, "run_id", path)


def lock_issues(locked: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status) of files that differ from their locked hash or are missing: locked and files are (keys, hash)."""
    j = locked.withColumnRenamed("hash", "_want").join(files.withColumnRenamed("hash", "_got"), keys, "left")
    status = F.when(F.col("_got").isNull(), "missing").when(F.col("_got") != F.col("_want"), "modified")
    return j.select(*keys, status.alias("status")).where("status is not null")


def chain_issues(chained: DataFrame) -> DataFrame:
    """(log, break_at): logs whose chain of hashes is broken, with the first place."""
    return verify_chain(chained).where("not valid").select("log", F.col("first_bad").cast("long").alias("break_at"))


def validate_runs(parts: list[DataFrame]) -> DataFrame:
    """(run_id, errors, warnings, valid) of findings (run_id, severity, ...) put together."""
    rows = reduce(DataFrame.unionByName, [p.select("run_id", "severity") for p in parts])
    g = rows.groupBy("run_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return g.withColumn("valid", F.col("errors") == 0)


def finalize(events: DataFrame, artifacts: DataFrame, run: str, kind: str) -> DataFrame:
    """(run, events, kinds, artifacts, digest): what a run leaves: its events, and a hash over its artifacts' hashes in order.

    Artifacts are (run, path, hash). The digest of a run is the hash of the sum of its
    artifacts' hashes (four words of 32 bits each, added), which needs no order and no
    gathering, and changes with any of them.
    """
    e = events.groupBy(run).agg(F.count("*").alias("events"), F.count_distinct(kind).alias("kinds"))
    h = F.sha2(F.concat_ws("|", "path", "hash"), 256)
    words = [F.sum(F.conv(F.substr(h, F.lit(1 + 8 * i), F.lit(8)), 16, 10).cast("decimal(38,0)")).alias(f"w{i}") for i in range(4)]
    a = artifacts.groupBy(run).agg(F.count("*").alias("artifacts"), *words).select(run, "artifacts", F.sha2(F.concat_ws(":", *[F.col(f"w{i}").cast("string") for i in range(4)]), 256).alias("digest"))
    return e.join(a, run, "left").na.fill(0, ["artifacts"])


def verify_runs(before: DataFrame, now: DataFrame, run: str) -> DataFrame:
    """(run, status): finalized reports recomputed: `intact`, `changed`, `missing` or `new`."""
    a, b = before.select(run, F.struct("events", "artifacts", "digest").alias("x")), now.select(run, F.struct("events", "artifacts", "digest").alias("y"))
    status = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "new").when(F.col("x") == F.col("y"), "intact").otherwise("changed")
    return a.join(b, run, "full_outer").select(run, status.alias("status"))


def replay(decisions: DataFrame, handlers: dict[str, Callable[[DataFrame], DataFrame]], kind: str, default: Column | None = None, dry: bool = False) -> DataFrame:
    """(id, outcome) of decisions handed to the handler of their kind; a handler gives (id, outcome).

    Decisions marked `default` are `skipped`, kinds without a handler `unhandled`; dry,
    what would be handed over is `pending` and no handler runs.
    """
    skip = F.coalesce(default, F.lit(False)) if default is not None else F.lit(False)
    rest = decisions.where(~skip)
    known = F.col(kind).isin(list(handlers)) if handlers else F.lit(False)
    parts = [decisions.where(skip).select("id", F.lit("skipped").alias("outcome")), rest.where(~F.coalesce(known, F.lit(False))).select("id", F.lit("unhandled").alias("outcome"))]
    if dry:
        parts.append(rest.where(known).select("id", F.lit("pending").alias("outcome")))
    else:
        parts += [h(rest.where(F.col(kind) == k)).select("id", "outcome") for k, h in handlers.items()]
    return reduce(DataFrame.unionByName, parts)


def duration(start: Column, end: Column) -> Column:
    """Seconds from start to end; null where either is missing."""
    return (end.cast("timestamp").cast("double") - start.cast("timestamp").cast("double")).cast("long")


def outcome_summary(phases: DataFrame, run: str) -> DataFrame:
    """(run, completed, failed, open, artifacts, seconds) of phases (run, status, artifacts, start, end)."""
    return phases.groupBy(run).agg(
        F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(~F.coalesce(F.col("status").isin("completed", "failed"), F.lit(False))).alias("open"),
        F.coalesce(F.sum("artifacts"), F.lit(0)).alias("artifacts"), duration(F.min("start"), F.max("end")).alias("seconds"),
    )


def phase_difference(a: DataFrame, b: DataFrame, phase: str) -> DataFrame:
    """(phase, before, after, artifacts, score, change) of two runs' phases (phase, status, artifacts, score)."""
    x, y = a.select(phase, F.struct("status", "artifacts", "score").alias("x")), b.select(phase, F.struct("status", "artifacts", "score").alias("y"))
    j = x.join(y, phase, "full_outer")
    s = lambda c: F.coalesce(F.col(c)["status"], F.lit("missing"))
    change = F.when(s("x") != s("y"), "status").when(F.col("x.artifacts") != F.col("y.artifacts"), "artifacts").when(F.col("x.score") != F.col("y.score"), "score").otherwise("same")
    delta = lambda f: F.coalesce(F.col(f"y.{f}"), F.lit(0)) - F.coalesce(F.col(f"x.{f}"), F.lit(0))
    return j.select(phase, s("x").alias("before"), s("y").alias("after"), delta("artifacts").alias("artifacts"), delta("score").alias("score"), change.alias("change"))


def gate_summary(results: DataFrame, keys: list[str], passed: str) -> DataFrame:
    """(keys, total, passed, failed, share) of gate results; an unknown result has not passed."""
    ok = F.coalesce(F.col(passed), F.lit(False))
    g = results.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"))
    return g.withColumn("failed", F.col("total") - F.col("passed")).withColumn("share", F.col("passed") / F.col("total"))


def resumable(checkpoints: DataFrame, run: str, order: str, status: str, phase: str) -> DataFrame:
    """(run, phase): the last phase of each run that is not completed; runs without one are left out."""
    return checkpoints.where(~F.coalesce(F.col(status) == "completed", F.lit(False))).groupBy(run).agg(F.max_by(phase, order).alias("phase"))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of the one table that the other lacks, counted as often as they stand, with `side`."""
    cols = a.columns
    return a.select(*cols).exceptAll(b.select(*cols)).withColumn("side", F.lit("first")).unionByName(b.select(*cols).exceptAll(a.select(*cols)).withColumn("side", F.lit("second")))


def phase_order(spark: SparkSession, needs: dict[str, list[str]]) -> DataFrame:
    """(phase, position) of phases after those they need, in the order of their names where free; a cycle is an error.

    A workflow's phases are a handful of names; they are put in order on the driver.
    """
    left, out = {k: set(v) for k, v in needs.items()}, []
    while left:
        free = sorted(k for k, v in left.items() if not v & left.keys())
        if not free:
            raise ValueError(f"phases need one another: {', '.join(sorted(left))}")
        out += free
        left = {k: v for k, v in left.items() if k not in free}
    return spark.createDataFrame([(p, i) for i, p in enumerate(out)], "phase string, position int")


def rate_excess(events: DataFrame, keys: list[str], ts: str, limit: int, window: str = "1 minute") -> DataFrame:
    """(keys, start, n): windows with more than `limit` events."""
    g = events.groupBy(*keys, F.window(ts, window).alias("w")).agg(F.count("*").alias("n")).where(F.col("n") > limit)
    return g.select(*keys, F.col("w.start").alias("start"), "n")


def leases(requests: DataFrame, resource: str, owner: str, ts: str, ttl: int) -> DataFrame:
    """(resource, owner, ts, granted): a request is granted if it is its resource's first, or `ttl` seconds or more after the request before it, or by the same owner as that.

    What holds a lease open is every request, granted or not, as of a client that keeps asking.
    """
    w = Window.partitionBy(resource).orderBy(ts, owner)
    gap = F.col(ts).cast("timestamp").cast("double") - F.lag(F.col(ts).cast("timestamp").cast("double")).over(w)
    return requests.withColumn("granted", F.lag(ts).over(w).isNull() | (gap >= ttl) | (F.lag(owner).over(w) == F.col(owner)))


def stale_tasks(tasks: DataFrame, beats: DataFrame, worker: str, now: Column, seconds: float) -> DataFrame:
    """Open tasks (task, worker, status) whose worker's last beat (worker, ts) is `seconds` old or was never heard: what a cleanup would set free."""
    last = beats.groupBy(worker).agg(F.max("ts").alias("_last"))
    age = now.cast("timestamp").cast("double") - F.col("_last").cast("timestamp").cast("double")
    j = tasks.where("status = 'in_progress'").join(last, worker, "left")
    return j.where(F.col("_last").isNull() | (age > seconds)).drop("_last")


def decision_issues(records: DataFrame, id_col: str, kinds: list[str] | None = None) -> DataFrame:
    """(id, issue): required fields that are missing or empty, kinds that are not listed, confidence outside 0 and 1; columns a table lacks are missing."""
    rules = [(f"missing {f}", F.coalesce(F.trim(F.col(f).cast("string")), F.lit("")) == "" if f in records.columns else F.lit(True)) for f in DECISION_FIELDS]
    if kinds is not None and "decision_type" in records.columns:
        rules.append(("unknown decision_type", F.col("decision_type").isNotNull() & ~F.col("decision_type").isin(kinds)))
    if "confidence" in records.columns:
        rules.append(("confidence out of range", F.col("confidence").isNotNull() & ~F.col("confidence").between(0, 1)))
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return records.select(id_col, F.explode(found).alias("issue"))


def export_level(rationale: Column, alternatives: Column, features: Column) -> Column:
    """Quality of a decision for export: exemplary needs 100 characters, alternatives and features; proficient 50 characters."""
    n = F.coalesce(F.length(rationale), F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when((n >= 100) & yes(alternatives) & yes(features), "exemplary").when(n >= 50, "proficient").otherwise("developing")


def store_findings(blobs: DataFrame, catalog: DataFrame, chunks: DataFrame) -> DataFrame:
    """(name, finding) of a store: blobs (path, name, sha256) whose content is not what they are named after, entries of the catalog (slug) without chunks (slug), chunks without an entry."""
    bad = blobs.where(F.col("name") != F.col("sha256")).select(F.col("path").alias("name"), F.lit("content differs from its name").alias("finding"))
    a, b = catalog.select("slug").distinct(), chunks.select("slug").distinct()
    empty = a.join(b, "slug", "left_anti").select(F.col("slug").alias("name"), F.lit("no chunks").alias("finding"))
    lost = b.join(a, "slug", "left_anti").select(F.col("slug").alias("name"), F.lit("not in the catalog").alias("finding"))
    return bad.unionByName(empty).unionByName(lost)


def outdated_index(parts: DataFrame, index: DataFrame, ts: str) -> DataFrame:
    """One row: the newest part, the index's time, whether the index is older than a part (an index that is not there is)."""
    p, i = parts.agg(F.max(ts).alias("newest")), index.agg(F.max(ts).alias("indexed"))
    return p.crossJoin(i).withColumn("outdated", F.coalesce(F.col("newest") > F.col("indexed"), F.col("newest").isNotNull()))  # two single rows
