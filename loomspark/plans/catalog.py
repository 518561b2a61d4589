"""The queries over the driver's tables, and their SQL."""

from __future__ import annotations

from loomspark.plans import registry
from loomspark.plans import alignment_queries, assessment_queries, check_queries, content_queries, event_queries, graph_queries, pattern_queries, quality_queries, retrieval_queries, synthesis_queries, text_queries  # noqa: F401  (each module registers its queries)


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
