"""Items of the chunk table: concept tags and key terms, normalised."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomspark.functions.text import slug_item, term_item
from loomspark.tables import once_per_id

FIELDS = ("concept_tags", "key_terms")


def item_mentions(chunks: DataFrame) -> DataFrame:
    """(id, field, items array<string>): every mention of an item, repeats kept.

    One row per chunk id and field, also where no item is left; nulls and items
    that normalise to nothing are dropped; a null array counts as empty.
    """
    rows = once_per_id(chunks.select("id", "concept_tags", F.col("key_terms.term").alias("terms")))
    some = lambda x: x.isNotNull() & (x != "")
    tags = F.filter(F.transform("concept_tags", slug_item), some)
    terms = F.filter(F.transform("terms", term_item), some)
    empty = F.array().cast("array<string>")
    both = F.array(
        F.struct(F.lit("concept_tags").alias("field"), F.coalesce(tags, empty).alias("items")),
        F.struct(F.lit("key_terms").alias("field"), F.coalesce(terms, empty).alias("items")),
    )
    return rows.select("id", F.explode(both).alias("m")).select("id", "m.field", "m.items")
