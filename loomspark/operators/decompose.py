"""Taking a question apart into weighted sub-queries. One string on the driver; the rows made of it are small."""

from __future__ import annotations

import re

from loomspark.functions.scoring import BLOOM_VERBS, BLOOM_WEIGHT
from loomspark.functions.text import STOP_WORDS

# The signs of each intent, in the order in which intents are tried.
INTENT_SIGNS = {
    "definition": [r"^what\s+is\s+", r"^define\s+", r"definition\s+of", r"^explain\s+what\s+", r"meaning\s+of", r"^describe\s+what\s+"],
    "explanation": [r"^why\s+", r"^explain\s+why", r"reason\s+for", r"how\s+come", r"purpose\s+of", r"rationale\s+(for|behind)"],
    "example": [r"^show\s+me", r"example\s+of", r"give\s+(an\s+)?example", r"illustrate", r"demonstrate", r"case\s+study"],
    "procedure": [r"^how\s+(?:do|can|should|would|to)", r"steps\s+to", r"process\s+for", r"implement", r"procedure\s+for", r"method\s+(?:for|to)", r"^create\s+", r"^build\s+"],
    "comparison": [r"compare", r"difference\s+between", r"contrast", r"\bversus\b", r"\bvs\.?\b", r"similarities?\s+between", r"distinguish\s+between"],
    "application": [r"when\s+(?:should|to|would)", r"use\s+case", r"apply\s+", r"best\s+practice", r"in\s+practice"],
    "analysis": [r"^analyze", r"^analyse", r"break\s+down", r"components?\s+of", r"examine", r"investigate"],
    "synthesis": [r"combine", r"integrate", r"synthesize", r"design\s+a", r"develop\s+a", r"create\s+a\s+new"],
}
# Aspects of each intent with their weights.
ASPECTS = {
    "definition": [("what", 0.8), ("related", 0.2)],
    "explanation": [("why", 0.6), ("what", 0.3), ("examples", 0.1)],
    "example": [("examples", 0.7), ("how", 0.2), ("what", 0.1)],
    "procedure": [("how", 0.6), ("what", 0.2), ("examples", 0.2)],
    "comparison": [("what", 0.4), ("what", 0.4), ("related", 0.2)],
    "application": [("when", 0.4), ("how", 0.3), ("examples", 0.3)],
    "analysis": [("what", 0.3), ("why", 0.3), ("how", 0.2), ("related", 0.2)],
    "synthesis": [("how", 0.4), ("what", 0.3), ("examples", 0.3)],
}
# The question asked for each aspect.
QUESTIONS = {
    "what": "{} definition", "why": "importance of {}", "how": "how to {}", "when": "when to use {}", "examples": "{} examples", "related": "{} related concepts",
}
# Words that hint at a domain.
DOMAIN_WORDS = {
    "instructional-design": ["addie", "sam", "instructional", "learning design", "curriculum", "assessment", "objectives", "outcomes"],
    "accessibility": ["wcag", "accessibility", "accessible", "a11y", "screen reader", "alt text", "aria", "disability"],
    "udl": ["udl", "universal design", "multiple means", "representation", "engagement", "action and expression"],
    "pedagogy": ["pedagogy", "teaching", "bloom", "taxonomy", "scaffolding", "metacognition", "cognitive load"],
    "design": ["ux", "ui", "user experience", "interface", "visual design", "typography", "layout", "wireframe"],
}
#: Most concepts of a question, and words of the one made up where none is found.
MOST_CONCEPTS, MADE_UP_WORDS = 5, 3

_QUOTED = re.compile(r'"([^"]+)"')
_TITLE = re.compile(r"\b[A-Z][a-z]+(?: (?:(?:for|of|and|the|in) )?[A-Z][a-z]+)+|\b[A-Z][a-z]+")
_ASKED = [
    re.compile(r"what is (.+?)(?:\?|$)", re.I), re.compile(r"how does (.+?) (?:work|function|operate)", re.I),
    re.compile(r"compare (.+?) (?:and|vs\.?|versus) (.+?)(?:\?|$)", re.I), re.compile(r"difference between (.+?) and (.+?)(?:\?|$)", re.I),
]


def intent(query: str) -> str:
    """The first intent with a sign in the question; an explanation where there is none."""
    q = query.strip().lower()
    return next((name for name, signs in INTENT_SIGNS.items() if any(re.search(s, q) for s in signs)), "explanation")


def bloom_level(query: str) -> str | None:
    """Level of the longest action verb in the question; of equal ones the higher level."""
    found = [(len(v), BLOOM_WEIGHT[level], level) for level, verbs in BLOOM_VERBS.items() for v in verbs if re.search(rf"\b{v}\b", query.lower())]
    return max(found)[2] if found else None


def concepts(query: str) -> list[str]:
    """Quoted phrases, title-case phrases past the opening word, and what the question asks about.

    Distinct without regard to case, of three letters or more, five at most; where
    there are none, the first words that are no stop words make one.
    """
    query = " ".join(query.split())
    opening = query.split(" ")[0] if query else ""
    found = _QUOTED.findall(query)
    found += [t for t in _TITLE.findall(query) if t != opening]
    for pattern in _ASKED:
        for m in pattern.finditer(query):
            found += m.groups()
    kept: dict[str, str] = {}
    for c in (x.strip(" ?.,!\"") for x in found):
        if len(c) > 2:
            kept.setdefault(c.lower(), c)
    if not kept:
        words = [w for w in query.split(" ") if len(w) > 2 and w.lower() not in STOP_WORDS][:MADE_UP_WORDS]
        return [" ".join(words)] if words else []
    return list(kept.values())[:MOST_CONCEPTS]


def domains(query: str) -> list[str]:
    """The domains a word of which stands in the question (anywhere, inside words too)."""
    return [d for d, words in DOMAIN_WORDS.items() if any(w in query.lower() for w in words)]


def decompose(query: str) -> list[tuple[int, str, str, float]]:
    """(query_id, sub-query, aspect, weight), by falling weight, as they were made where weights are equal.

    A comparison of two concepts asks for each and for both together; any other
    question asks for the aspects of its intent, of its first concept.
    """
    kind, found = intent(query), concepts(query)
    if kind == "comparison" and len(found) > 1:
        own = [f"{found[0]} definition overview", f"{found[1]} definition overview", f"{found[0]} {found[1]} comparison difference"]
        rows = [(t, aspect, w) for t, (aspect, w) in zip(own, ASPECTS[kind])]
    else:
        about = found[0] if found else query[:50]
        rows = [(QUESTIONS[aspect].format(about), aspect, w) for aspect, w in ASPECTS[kind]]
    return sorted(((i, *r) for i, r in enumerate(rows)), key=lambda r: (-r[3], r[0]))


# Openings that say who will learn, and the kinds of chunk asked first and second for a level.
PREAMBLE = re.compile(r"^(?:(?:students?|learners?|participants?|you)\s+)?(?:will\s+|should\s+)?(?:be\s+able\s+to\s+)?", re.I)
KINDS_OF_LEVEL = {
    "remember": (["explanation", "overview"], ["summary"]), "understand": (["explanation", "example"], ["overview", "summary"]), "apply": (["example", "exercise"], ["explanation"]),
    "analyze": (["example", "explanation"], ["exercise"]), "evaluate": (["exercise", "example"], ["explanation"]), "create": (["exercise", "example"], ["explanation"]),
}


def objective_concepts(statement: str) -> str:
    """What an objective is about: without its preamble, its opening verb and the question word after that."""
    rest = PREAMBLE.sub("", " ".join(statement.split()))
    verbs = {v for vs in BLOOM_VERBS.values() for v in vs}
    words = rest.split(" ")
    if words and words[0].lower() in verbs:
        words = words[1:]
    if words and words[0].lower() in ("how", "why", "what", "that", "the", "a", "an"):
        words = words[1:]
    return " ".join(words)
