"""Sinks. Spark's commit protocol makes each write atomic; tables are partitioned by what readers select on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def write_chunks(df: DataFrame, path: str, fmt: str = "json", by: str | None = None, mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(by) if by else w).format(fmt).save(path)


def write_indexes(catalog: DataFrame, root: str, keys: tuple[str, ...] = ("division", "domain")) -> None:
    """One folder for each value of each key; entries within several domains stand in each."""
    for k in keys:
        catalog.withColumn(f"by_{k}", F.coalesce(F.col(k), F.lit("unspecified"))).write.mode("overwrite").partitionBy(f"by_{k}").json(f"{root}/{k}")


def write_lines(df: DataFrame, line: Column, path: str) -> None:
    df.select(line.alias("value")).where("value is not null").write.mode("overwrite").text(path)


def jsonld(df: DataFrame, context: str, id_col: str, columns: list[str]) -> DataFrame:
    """(document): each row as JSON-LD."""
    return df.select(F.to_json(F.struct(F.lit(context).alias("@context"), F.col(id_col).alias("@id"), *columns)).alias("document"))


def write_artifacts(tables: dict[str, DataFrame], root: str, by: str = "course_id") -> None:
    """A course's artifacts (manifest, statistics, graphs, reports): a table each, a folder for every course."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(by) if by in df.columns else w).json(f"{root}/{name}")


def write_cross_references(concepts: DataFrame, path: str) -> None:
    """Concepts and the courses that use them (concept, courses, total_courses), those of several courses apart as well; rows in order, so that equal input gives equal files."""
    rows = concepts.select("concept", "courses", "total_courses")
    for name, df in (("concept_to_courses", rows), ("shared_concepts", rows.where("total_courses > 1"))):
        df.repartitionByRange("concept").sortWithinPartitions("concept").write.mode("overwrite").json(f"{path}/{name}")


def write_report(summary: DataFrame, rows: DataFrame, path: str) -> None:
    """An evaluation's one-row summary, and its rows by query."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    rows.write.mode("overwrite").json(f"{path}/queries")


def append_chunks(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Chunks added to a store; Spark's commit makes the addition visible whole or not at all."""
    df.write.mode("append").format(fmt).save(path)


def import_course(files: DataFrame, slug: str, root: str, **classification: str) -> None:
    """A course's artifacts (path, length, sha256) and manifest under `root/slug`; the manifest holds counts and the classification given."""
    files.write.mode("overwrite").json(f"{root}/{slug}/artifacts")
    m = files.agg(F.count("*").alias("artifacts"), F.sum("length").alias("bytes")).select(F.lit(slug).alias("slug"), "artifacts", "bytes", *[F.lit(v).alias(k) for k, v in sorted(classification.items())])
    m.coalesce(1).write.mode("overwrite").json(f"{root}/{slug}/manifest")
