"""From parsed sections to chunks: merge small ones, split large ones, enrich, link."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomspark.functions import ids, scoring, text as T
from loomspark.operators.sequence import pack_greedily


def merge_sections(sections: DataFrame, keys: list[str], limit: int = 800) -> DataFrame:
    """(keys, section, heading, text): consecutive sections joined while they hold at most `limit` words together."""
    rows = sections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "heading", "text", T.word_count(F.col("text")).alias("words")))).alias("x"))
    rows = rows.withColumn("g", pack_greedily(F.col("x.words"), limit))
    one = rows.select(*keys, F.explode(F.arrays_zip("x", "g")).alias("z")).select(*keys, F.col("z.g").alias("section"), "z.x.*")
    g = one.groupBy(*keys, "section").agg(F.array_sort(F.collect_list(F.struct("pos", "heading", "text"))).alias("p"))
    return g.select(*keys, "section", F.col("p")[0]["heading"].alias("heading"), F.array_join(F.filter("p.text", lambda t: t != ""), "\n").alias("text"))


def split_sentences(sections: DataFrame, keys: list[str], target: int = 500) -> DataFrame:
    """(keys, section, part, heading, text): sentences packed up to `target` words; a longer sentence stands alone."""
    s = sections.withColumn("s", T.sentences(F.col("text"))).where(F.size("s") > 0)
    s = s.withColumn("g", pack_greedily(F.transform("s", T.word_count), target))
    one = s.select(*keys, "section", "heading", F.posexplode(F.arrays_zip("s", "g")).alias("i", "z"))
    g = one.groupBy(*keys, "section", "heading", F.col("z.g").alias("part")).agg(F.array_sort(F.collect_list(F.struct("i", F.col("z.s").alias("s")))).alias("p"))
    return g.select(*keys, "section", "part", "heading", F.array_join("p.s", " ").alias("text"))


def build_chunks(parsed: DataFrame, limit: int = 800, target: int = 500) -> DataFrame:
    """Chunks of parsed pages (course, module, lesson, pos, heading, text): merged, split, named, classified and linked."""
    keys = ["course", "module", "lesson"]
    rows = split_sentences(merge_sections(parsed, keys, limit), keys, target)
    w = Window.partitionBy("course", "module").orderBy("lesson", "section", "part")
    words = T.word_count(F.col("text")).cast("long")
    rows = rows.withColumn("position_in_module", F.row_number().over(w) - 1)
    rows = rows.withColumn("id", ids.chunk_id(F.concat(F.lower("course"), F.lit("_chunk_")), F.col("text"), F.concat_ws("/", "module", "lesson", "section", "part")))
    rows = rows.withColumn("follows_chunk", F.lag("id").over(Window.partitionBy(*keys).orderBy("section", "part")))
    return rows.select(
        "id", F.lit("v4").alias("schema_version"), ids.first_match(F.coalesce("heading", F.lit("")), ids.HEADINGS, "explanation").alias("chunk_type"), "text", "follows_chunk",
        F.struct(F.col("course").alias("course_id"), F.col("module").alias("module_id"), F.col("lesson").alias("lesson_id"), F.col("heading").alias("section_heading"), "position_in_module").alias("source"),
        words.alias("word_count"), scoring.token_estimate(words).alias("tokens_estimate"), scoring.detect_bloom(F.col("text")).alias("bloom_level"),
    )
