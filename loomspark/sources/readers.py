"""Readers of stored course data. All are lazy scans; malformed lines are dropped unless `strict`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.sources import schemas


def read_chunks(spark: SparkSession, path: str, strict: bool = False, array_file: bool = False) -> DataFrame:
    """Chunk JSON lines (or whole-array files), with the course's folder name as `course_slug`.

    Predicates and columns chosen later are applied in the scan's task; blank and
    malformed lines give no rows.
    """
    r = spark.read.schema(schemas.CHUNK).option("mode", "FAILFAST" if strict else "DROPMALFORMED").option("multiLine", array_file)
    df = r.json(path).withColumn("course_slug", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/(?:corpus/)?[^/]+$", 1))
    return df if strict else df.where("id is not null")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("path", F.col("_metadata.file_path"))


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, id, statement, bloom_level, hierarchy_level) of course files with `learning_outcomes` or `outcomes`."""
    c = read_json(spark, path, schemas.OUTCOMES)
    return c.select("path", F.posexplode(F.coalesce("learning_outcomes", "outcomes")).alias("pos", "o")).select("path", "pos", "o.*")


def read_objectives(spark: SparkSession, path: str) -> DataFrame:
    """Terminal and chapter objectives as one table: (id, statement, bloom_level, hierarchy_level, chapter, week_lo, week_hi)."""
    o = read_json(spark, path, schemas.OBJECTIVES)
    t = o.select(F.explode("terminal_objectives").alias("x")).select("x.id", "x.statement", F.col("x.bloomLevel").alias("bloom_level"), F.lit("terminal").alias("hierarchy_level"), F.lit(None).cast("string").alias("chapter"), F.lit(None).cast("int").alias("week_lo"), F.lit(None).cast("int").alias("week_hi"))
    c = o.select(F.explode("chapter_objectives").alias("c")).select("c.chapter", F.get("c.week_range", F.lit(0)).alias("week_lo"), F.get("c.week_range", F.lit(1)).alias("week_hi"), F.explode("c.objectives").alias("x"))
    return t.unionByName(c.select("x.id", "x.statement", F.col("x.bloomLevel").alias("bloom_level"), F.lit("chapter").alias("hierarchy_level"), "chapter", "week_lo", "week_hi"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    g = read_json(spark, path, schemas.GRAPH)
    return g.select("path", F.explode("nodes").alias("n")).select("path", "n.*"), g.select("path", F.explode("edges").alias("e")).select("path", "e.*")


def read_questions(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Gold questions: JSON lines with `#` comments; a bad line fails, or is dropped where not strict."""
    lines = spark.read.text(path).where(~F.trim("value").startswith("#") & (F.trim("value") != ""))
    q = lines.select(F.from_json("value", "id string, query string, relevant_chunk_ids array<string>, kind string", {"mode": "FAILFAST" if strict else "PERMISSIVE"}).alias("q"))
    return q.select("q.*").where("query is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Decision logs under a folder, with file and time."""
    df = spark.read.schema(schemas.EVENT).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("mode", "DROPMALFORMED").json(path)
    return df.withColumn("source_file", F.col("_metadata.file_path")).withColumn("ts", F.try_to_timestamp("timestamp"))


def read_files(spark: SparkSession, path: str, glob: str = "*", content: bool = False) -> DataFrame:
    """(path, length, sha256) of files, and their bytes if asked for."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    cols = [F.regexp_replace("path", "^file:", "").alias("path"), "length", F.sha2("content", 256).alias("sha256")]
    return df.select(*cols, *(["content"] if content else []))


def read_jdbc_like(spark: SparkSession, url: str, dbtable: str, **options: str) -> DataFrame:
    """A database table; filters (`=`, `LIKE 'x%'`) are pushed to it."""
    return spark.read.format("jdbc").options(url=url, dbtable=dbtable, **options).load()


def read_nested_objectives(spark: SparkSession, path: str) -> DataFrame:
    """(id, statement, bloom_level, key_concepts, hierarchy_level, parent) of course, chapter, section and subsection objectives.

    A missing level is `understand`; objectives without an id or a statement are dropped.
    """
    doc = read_json(spark, path, schemas.NESTED_OBJECTIVES)
    chapters = doc.select(F.explode_outer("chapters").alias("c"))
    sections = chapters.select("c", F.explode_outer("c.sections").alias("s"))
    subs = sections.select("s", F.explode_outer("s.subsections").alias("u"))

    def rows(df: DataFrame, objectives: str, level: str, parent) -> DataFrame:
        o = df.select(F.explode(objectives).alias("o"), parent.alias("parent"))
        return o.select(F.col("o.objectiveId").alias("id"), "o.statement", F.coalesce("o.bloomLevel", F.lit("understand")).alias("bloom_level"), F.coalesce("o.keyConcepts", F.array().cast("array<string>")).alias("key_concepts"), F.lit(level).alias("hierarchy_level"), "parent")

    got = rows(doc, "courseObjectives", "course", F.lit(None).cast("string"))
    got = got.unionByName(rows(chapters, "c.chapterObjectives", "chapter", F.col("c.chapterId"))).unionByName(rows(sections, "s.sectionObjectives", "section", F.col("s.sectionId"))).unionByName(rows(subs, "u.subsectionObjectives", "subsection", F.col("u.subsectionId")))
    return got.where("id is not null and statement is not null")


def read_pedagogy(spark: SparkSession, path: str) -> DataFrame:
    """(path, model): pedagogy models as JSON text, one a file; a file that is no JSON object gives `{}`."""
    raw = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("v"))
    ok = F.col("v").startswith("{") & F.from_json("v", "map<string,string>", {"mode": "PERMISSIVE"}).isNotNull() & F.json_object_keys("v").isNotNull()
    return raw.select("path", F.when(ok, F.col("v")).otherwise("{}").alias("model"))


def read_checkpoints(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoints of all runs under a folder: (path, dir_run, run_id, phase_name, status, index, artifacts)."""
    c = spark.read.schema("run_id string, phase_name string, status string, index int, artifacts array<string>").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_checkpoint.json").json(path)
    return c.withColumn("path", F.col("_metadata.file_path")).withColumn("dir_run", F.regexp_extract("path", r"([^/]+)/(?:checkpoints/)?[^/]+$", 1))


def read_pages(spark: SparkSession, path: str, glob: str = "*.html") -> DataFrame:
    """(id, html): every HTML file under a folder, whole, named by its path without ending."""
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    return raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1).alias("id"), F.col("value").alias("html"))
