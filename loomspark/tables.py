"""Loading of the named input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.session import BROADCAST_ROWS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scanned table that has fewer splits than the session has cores, dealt out to all of them: for small files with heavy work a row. Larger tables are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def once_per_id(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per `key`; rows with a null key are left out.

    Repeated keys are rare deliveries of the same record, so only their rows are
    shuffled: the ids are counted first (a narrow scan), then the repeated ids
    split the table. The list of repeated ids is broadcast only if it is counted
    to be small; else both joins shuffle on the key.
    """
    ids = df.select(F.col(key).alias("_rk")).where("_rk is not null")
    repeated = ids.groupBy("_rk").count().where("count > 1").select("_rk")
    n = repeated.count()
    df = df.where(F.col(key).isNotNull())
    if n == 0:
        return df
    side = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    on = df[key] == side["_rk"]
    return df.join(side, on, "left_anti").unionByName(df.join(side, on, "left_semi").dropDuplicates([key]))
