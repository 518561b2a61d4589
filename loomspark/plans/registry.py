"""Registration of a query together with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Chunks once per id, for SQL.
ONCE = "one AS (SELECT id, any_value(text) AS text, any_value(follows_chunk) AS follows_chunk, any_value(source) AS source, any_value(chunk_type) AS chunk_type, any_value(difficulty) AS difficulty, any_value(bloom_level) AS bloom_level, any_value(content_type_label) AS content_type_label, any_value(tokens_estimate) AS tokens_estimate, any_value(word_count) AS word_count, any_value(concept_tags) AS concept_tags, any_value(learning_outcome_refs) AS learning_outcome_refs, any_value(key_terms) AS key_terms, any_value(misconceptions) AS misconceptions, any_value(run_id) AS run_id FROM chunks WHERE id IS NOT NULL GROUP BY id)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep
