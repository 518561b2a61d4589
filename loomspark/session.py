"""Session construction and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most rows a side may have to be broadcast by hint; beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def get_spark(app: str = "loomspark", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; `conf` adds or overrides settings."""
    base = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.appName(app).master(f"local[{cores}]").config(map=base | conf).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, from `spark.checkpoint.dir`.

    Only where that is unset in a local session, as in tests, a folder is made; on a
    cluster a machine's own folder would be no shared one, so an error is raised.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if set_dir:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(set_dir)
        return set_dir.rstrip("/")
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="loomspark-"))
    return sc.getCheckpointDir().rstrip("/")


#: The folder of this process's tables under the shared folder.
RUN = uuid.uuid4().hex


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs only the tasks that ran on it. The
    table stays while results are read, because readers are lazy; `clear_tables`
    removes all tables of this process.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomspark/{RUN}/{uuid.uuid4().hex}-{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_tables(spark: SparkSession) -> None:
    """Deletes the tables that this process wrote; results not read yet can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomspark/{RUN}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
