"""Scores as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomspark.functions.text import find_all

# Action verbs of the six cognitive levels.
BLOOM_VERBS = {
    "remember": "define list recall identify name state label match recognize select".split(),
    "understand": "explain describe summarize classify compare interpret paraphrase discuss illustrate infer".split(),
    "apply": "apply demonstrate implement solve use execute calculate perform construct operate".split(),
    "analyze": "analyze examine differentiate contrast investigate categorize deconstruct organize distinguish attribute".split(),
    "evaluate": "evaluate assess judge critique justify defend recommend appraise argue prioritize".split(),
    "create": "create design develop formulate compose plan produce generate invent synthesize".split(),
}
BLOOM_DOMAIN = {"remember": "factual", "understand": "conceptual", "apply": "procedural", "analyze": "conceptual", "evaluate": "metacognitive", "create": "procedural"}
BLOOM_WEIGHT = {"remember": 1, "understand": 2, "apply": 3, "analyze": 4, "evaluate": 5, "create": 6}
# Words that show reasoning, and groups of teaching terms.
REASONING = ["because", "since", "therefore", "thus", "consequently", "allows", "enables", "prevents", "ensures", "supports", "aligns with", "chosen over", "preferred", "better than", "more appropriate", "rather than", "instead of", "compared to"]
PEDAGOGY = [("bloom", "taxonomy", "cognitive level"), ("misconception", "distractor", "plausibility"), ("learner", "student", "pedagog"), ("objective", "outcome", "competency"), ("udl", "accessibility", "inclusive"), ("formative", "summative", "assessment")]


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25_term(tf: Column, dl: Column, avgdl: Column, idf: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def combine_boosts(score: Column, boosts: dict[str, tuple[Column, float]], cap: float = 0.5) -> Column:
    """score * (1 + weighted boosts clamped to +-cap), at least 0."""
    raw = reduce(lambda x, y: x + y, [c * w for c, w in boosts.values()])
    return F.greatest(F.lit(0.0), score * (1 + F.greatest(F.lit(-cap), F.least(F.lit(cap), raw))))


def rrf(rank: Column, weight: Column | float = 1.0, k: int = 60) -> Column:
    return weight / (k + rank)


def syllables(word: Column) -> Column:
    """Vowel groups, one less after a final e, at least 1; words of three letters or fewer have 1."""
    groups = F.size(find_all(word, "[aeiouy]+"))
    counted = F.greatest(F.lit(1), groups - F.when(word.endswith("e") & (groups > 1), 1).otherwise(0))
    return F.when(F.length(word) <= 3, 1).otherwise(counted)


def flesch(words: Column, sentences: Column, syllable_count: Column) -> Column:
    """206.835 - 1.015 words per sentence - 84.6 syllables per word, within 0 and 100; 0 without words."""
    raw = 206.835 - 1.015 * (words / sentences) - 84.6 * (syllable_count / words)
    return F.when((words > 0) & (sentences > 0), F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))).otherwise(F.lit(0.0))


def token_estimate(words: Column) -> Column:
    return F.floor(words * 13 / 10).cast("long")


def bloom_counts(c: Column) -> dict[str, Column]:
    """Occurrences of each level's verbs as whole words."""
    return {level: F.coalesce(F.regexp_count(F.lower(c), F.lit(r"\b(?:" + "|".join(v) + r")\b")), F.lit(0)) for level, v in BLOOM_VERBS.items()}


def detect_bloom(c: Column) -> Column:
    """Level of the longest verb present; of equal lengths the higher level; null without one."""
    verbs = sorted(((v, level) for level, vs in BLOOM_VERBS.items() for v in vs), key=lambda x: (-len(x[0]), -BLOOM_WEIGHT[x[1]], x[0]))
    return F.coalesce(*[F.when(F.lower(c).rlike(rf"\b{v}\b"), F.lit(level)) for v, level in verbs])


def bloom_to_domain(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in BLOOM_DOMAIN.items() for x in kv])[level]


def rationale_depth(c: Column) -> Column:
    """Length (to 0.3), words of reasoning (0.05 each, to 0.4), groups of teaching terms (0.05 each); 0 for null or ''."""
    low = F.lower(c)
    reasons = reduce(lambda x, y: x + y, [F.when(F.contains(low, F.lit(w)), 1).otherwise(0) for w in REASONING])
    groups = reduce(lambda x, y: x + y, [F.when(reduce(lambda p, q: p | q, [F.contains(low, F.lit(w)) for w in g]), 1).otherwise(0) for g in PEDAGOGY])
    score = F.least(F.lit(0.3), F.length(c) / 300) + F.least(F.lit(0.4), reasons * 0.05) + groups * 0.05
    return F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.least(F.lit(1.0), score)).otherwise(F.lit(0.0))


def decision_quality(rationale: Column, alternatives: Column, inputs: Column, confidence: Column, accepted: Column) -> Column:
    """Composite of five parts, weighted 0.4, 0.2, 0.15, 0.1, 0.15; missing confidence counts 0.5."""
    conf = F.when(confidence.between(0, 1), confidence).otherwise(F.lit(0.5))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)
    return rationale_depth(rationale) * 0.4 + yes(alternatives) * 0.2 + yes(inputs) * 0.15 + conf * 0.1 + F.when(F.coalesce(accepted, F.lit(False)), 1.0).otherwise(0.5) * 0.15


def quality_level(length: Column, inputs: Column, alternatives: Column, relaxed: Column) -> Column:
    return (
        F.when((length >= 100) & inputs & alternatives, "exemplary").when((length >= 50) & (inputs | alternatives), "proficient").when((length >= 20) | (relaxed & (length > 0)), "developing").otherwise("inadequate")
    )


def backoff(attempt: Column, base: float = 1.0, most: float = 60.0) -> Column:
    return F.least(F.lit(float(most)), F.lit(base) * F.pow(F.lit(2.0), attempt))


def lo_split(total: Column, ratio: float = 0.3, least: int = 1, most: int = 10) -> tuple[Column, Column]:
    """(terminal, chapter) numbers of outcomes."""
    terminal = F.least(total, F.greatest(F.lit(least), F.least(F.lit(most), F.bround(total * ratio).cast("int"))))
    return terminal, total - terminal
