"""Roles of blocks and chunks by ordered rules; the first that fits counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Patterns of a block's text and its role, in order.
BLOCK_RULES = [
    (r"^\s*$", "empty"), (r"(?i)^\s*(?:page|p\.)?\s*[\[(-]?\s*\d{1,4}\s*[\])-]?\s*$", "page number"), (r"(?i)^\s*chapter\s+\w+\s*[:.]", "chapter opener"), (r"(?i)^\s*(?:figure|fig\.)\s+\d", "figure caption"),
    (r"(?i)^\s*table\s+\d", "table caption"), (r"^[\s\d.,]+$", "figures"), (r"^\s*(?:[-*•]|\d+[.)])\s+", "list item"), (r"(?i)^\s*(?:example|for example)\b", "example"), (r"(?i)^\s*(?:definition|note|tip|warning)\s*:", "callout"), (r"^[^.?!\n]{1,60}$", "heading"), (r"\?\s*$", "question"),
]
# What a chunk teaches by, from its content type, else its kind.
ROLE_OF = {"example": "elaborate", "definition": "introduce", "overview": "introduce", "summary": "synthesize", "exercise": "practice", "assessment_item": "assess", "explanation": "elaborate"}


def first_rule(c: Column, rules: list[tuple[str, str]], default: str) -> Column:
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(c.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def block_role(text: Column, hint: Column) -> Column:
    """The extractor's hint where it gives one, else the first rule that fits; `paragraph` if none does, `empty` for null."""
    return F.coalesce(F.nullif(F.replace(hint, F.lit("_"), F.lit(" ")), F.lit("")), first_rule(F.coalesce(text, F.lit("")), BLOCK_RULES, "paragraph"))


def teaching_role(content_type: Column, chunk_type: Column, first_mention: Column) -> Column:
    """By content type, then by kind; an explanation that first mentions its concepts introduces them."""
    table = F.create_map(*[F.lit(x) for kv in ROLE_OF.items() for x in kv])
    by = F.coalesce(table[content_type], table[chunk_type], F.lit("elaborate"))
    return F.when((by == "elaborate") & F.coalesce(first_mention, F.lit(False)) & (F.coalesce(content_type, chunk_type) == "explanation"), "introduce").otherwise(by)
