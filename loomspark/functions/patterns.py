"""What stands in a text: objectives, misconceptions, procedures, questions, claims, references; and its cleaning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomspark.functions import scoring, text as T

# Openings that introduce a misconception.
MISCONCEPTION_OPENINGS = [
    r"(?i)\b(?:Common\s+mistake|A\s+common\s+misconception|Students\s+often\s+think|Contrary\s+to\s+popular\s+belief)[:,]?\s+([^.]+\.)",
    r"(?i)\b(?:It\s+is\s+a\s+myth\s+that|Many\s+learners\s+assume\s+that)\s+([^.]+\.)",
]
# Openings after which learners' outcomes are listed.
OBJECTIVE_OPENING = r"(?is)(?:after\s+reading\s+this\s+chapter|by\s+the\s+end\s+of\s+this\s+(?:chapter|section)|you\s+will\s+be\s+able\s+to|students?\s+will\s+be\s+able\s+to)[,:]?\s*([^.]+?)\."
# Marks of HTML and of Markdown.
HTML_MARKS = [r"(?i)<html", r"(?i)<head", r"(?i)<body", r"(?i)<!DOCTYPE", r"(?i)<div\s", r"(?i)<p\s"]
MARKDOWN_MARKS = [r"(?m)^#{1,6}\s+", r"(?m)^```", r"(?m)^\s*[-*+]\s+", r"(?m)^\s*\d+\.\s+", r"(?m)^---\s*$", r"\[.+?\]\(.+?\)"]
# How a step of a procedure begins.
ACTION = r"(?i)^(?:(?:click|select|enter|type|open|close|save|create|delete|configure|set|add|remove)|(?:first|next|then|finally|after|before)|\d+[.)]\s*)"
# Counts that texts state of a published standard, with the right number.
CLAIMS = [(r"(?i)\b(\d+)\s+success\s+criteria\b", "success criteria", 86), (r"(?i)\b(\d+)\s+applicable\s+WCAG[^\n]{0,60}?Section\s*508\b", "applicable criteria", 38)]
CLAIM_OF_A_SUM = r"(?i)(\d+)\s+(?:success\s+criteria|items|elements|principles|guidelines)([^.]{0,180})"
# Words beside a claim that is of another version, of the past, or only supposed.
NO_CLAIM = r"(?i)\bWCAG\s*2\.[01]\b|\bhistorically\b|\bpreviously\b|\bformerly\b|\bused\s+to\b|\bsection\s*508\b|\bif\s+(?:there\s+were|we\s+had|the\s+spec)\b|\bsuppose\b|\bimagine\b"
#: Signs of a way of teaching; a text shows it if it holds two of its signs or more.
TEACHING_SIGNS = {
    "problem_based": ["problem", "scenario", "case study", "challenge"], "inquiry": ["investigate", "explore", "question", "hypothesis"], "worked_example": ["worked example", "step by step", "for example", "solution"],
    "collaborative": ["in small groups", "discuss", "peer", "partner"],
}
#: What each level adds to difficulty.
LEVEL_DIFFICULTY = {"remember": 0.1, "understand": 0.25, "apply": 0.45, "analyze": 0.65, "evaluate": 0.8, "create": 1.0}
DIFFICULTY_OF_LEVEL = {"remember": "foundational", "understand": "foundational", "apply": "intermediate", "analyze": "intermediate", "evaluate": "advanced", "create": "advanced"}
INTRODUCTORY = ["overview", "summary"]


def let(value: Column, body) -> Column:
    """body(value) with the value computed once; an expression named inside a lambda would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def misconceptions(c: Column) -> Column:
    """Sentences that an opening marks as misconceptions, each once without regard to case, opening by opening."""
    found = F.filter(F.transform(F.concat(*[T.find_all(c, p, 1) for p in MISCONCEPTION_OPENINGS]), lambda s: F.trim(s)), lambda s: s != "")
    return let(found, lambda f: F.filter(f, lambda s, i: ~F.array_contains(F.transform(F.slice(f, F.lit(1), i), lambda x: F.lower(x)), F.lower(s))))


def objectives(c: Column, shortest: int = 15, longest: int = 280) -> Column:
    """Outcomes that an opening introduces, taken apart at commas and `and`."""
    parts = F.flatten(F.transform(T.find_all(c, OBJECTIVE_OPENING, 1), lambda s: F.split(F.trim(s), r",\s*(?:and\s+)?|\band\b")))
    return F.array_distinct(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p).between(shortest, longest)))


def steps(c: Column) -> Column:
    """The steps of `Step 1: ... Step 2: ...`; none if there are fewer than two."""
    parts = F.split(F.coalesce(c, F.lit("")), r"(?i)Step\s+\d+[:.]\s*", -1)
    found = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    found = F.filter(found, lambda s: s != "")
    return F.when(F.size(parts) > 2, found).otherwise(F.array().cast("array<string>"))


def list_items(c: Column) -> Column:
    """The items of lists marked `*`, `-` or by numbers, marks left out but for numbers."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: x.rlike(r"^\s*(?:[-*+]|\d+[.)])\s+\S"))
    return F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"^\s*[-*+]\s+", "")))


def is_procedure(items: Column) -> Column:
    """Whether half of the items or more begin as steps do; an empty list does not."""
    return (F.size(items) > 0) & (F.size(F.filter(items, lambda x: F.trim(x).rlike(ACTION))) * 2 >= F.size(items))


def detect_format(c: Column) -> Column:
    """`html` if more marks of it stand in the text than of Markdown, else `markdown`."""
    n = lambda marks: reduce(lambda a, b: a + b, [F.when(F.coalesce(c.rlike(m), F.lit(False)), 1).otherwise(0) for m in marks])
    return F.when(n(HTML_MARKS) > n(MARKDOWN_MARKS), "html").otherwise("markdown")


def clean_text(c: Column) -> Column:
    """Ligatures apart, form feeds as blank lines, one space, at most one blank line, stripped."""
    c = F.replace(F.replace(F.replace(c, F.lit("ﬁ"), F.lit("fi")), F.lit("ﬂ"), F.lit("fl")), F.lit("\f"), F.lit("\n\n"))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def join_urls(c: Column) -> Column:
    """The text with URLs that a line end cuts joined again: after `=` or `/`, before digits of a parameter, before up to three letters."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("line"))

    def step(acc, x):
        nxt, line = F.trim(x), F.rtrim(acc["line"])
        goes_on = (nxt != "") & (line.rlike(r"https?://\S*[=/]$") | (acc["line"].rlike(r"\?[A-Za-z]+=\d*$") & nxt.rlike(r"^\d+$")) | (line.rlike("[a-z]$") & nxt.rlike("^[a-z]{1,3}$")))
        return F.when(acc["line"].isNull(), F.struct(acc["out"].alias("out"), x.alias("line"))).when(goes_on, F.struct(acc["out"].alias("out"), F.concat(line, nxt).alias("line"))).otherwise(F.struct(F.concat(acc["out"], F.array(acc["line"])).alias("out"), x.alias("line")))

    return F.aggregate(F.split(c, "\n", -1), start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(acc["line"])), "\n"))


def linkify(c: Column) -> Column:
    """URLs of a text as anchors."""
    return F.regexp_replace(c, f"({T.URL_RE})", '<a href="$1">$1</a>')


def blank_lines(c: Column, forms: Column) -> Column:
    """The text with the lines whose form (lower case, digit runs `#`, stripped) is among `forms` left empty."""
    form = lambda x: F.trim(F.regexp_replace(F.lower(x), "[0-9]+", "#"))
    return F.array_join(F.transform(F.split(c, "\n", -1), lambda x: F.when(F.array_contains(forms, form(x)) & (F.trim(x) != ""), F.lit("")).otherwise(x)), "\n")


def strip_feedback(html: Column) -> Column:
    """HTML of a quiz without its feedback blocks and marks of the right answer."""
    return F.regexp_replace(F.regexp_replace(html, r'(?is)<div\s+class="sc-feedback"[^>]*>.*?</div>', ""), r'\s+data-correct="[^"]*"', "")


def strip_preamble(c: Column) -> Column:
    """An objective without `students will be able to` and its leading verb; unchanged if nothing would be left."""
    verbs = "|".join(sorted({v for vs in scoring.BLOOM_VERBS.values() for v in vs}, key=lambda v: (-len(v), v)))
    rest = F.trim(F.regexp_replace(c, r"(?i)^(?:students?\s+(?:will|should|can)\s+(?:be\s+able\s+to\s+)?)?", ""))
    rest = F.trim(F.regexp_replace(rest, rf"(?i)^(?:{verbs})\s+", ""))
    return F.when(rest == "", c).otherwise(rest)


def link_references(c: Column) -> Column:
    """`Chapter 3`, `Figure 2.1`, `Section 1.2` and `[4]` as links to their anchors; references inside tags are left alone."""
    for word in ("Chapter", "Figure", "Table", "Section"):
        c = F.regexp_replace(c, rf"\b{word}\s+(\d+(?:\.\d+)*)\b(?![^<>]*>)", f'<a href="#{word.lower()}-$1">{word} $1</a>')
    return F.regexp_replace(c, r"(?<![\w\]])\[(\d{1,3})\](?!\()", '<a href="#ref-$1">[$1]</a>')


def review_questions(c: Column) -> Column:
    """Sentences that ask: (question, level) with the level of their verb."""
    asked = F.filter(F.transform(T.sentences(c), T.collapse), lambda s: s.endswith("?"))
    return F.transform(F.array_distinct(asked), lambda s: F.struct(s.alias("question"), scoring.detect_bloom(s).alias("level")))


def teaching_pattern(c: Column) -> Column:
    """The way of teaching with most signs in the text, two at least (of equals the first listed), else `direct_instruction`."""
    low = F.lower(F.coalesce(c, F.lit("")))
    counts = [F.struct(reduce(lambda a, b: a + b, [F.when(F.contains(low, F.lit(s)), 1).otherwise(0) for s in signs]).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, signs) in enumerate(TEACHING_SIGNS.items())]
    best = F.array_max(F.array(*counts))
    return F.when(best["n"] >= 2, best["name"]).otherwise("direct_instruction")


def difficulty(c: Column, technical: Column, concepts: Column) -> Column:
    """Mean of four signals from 0 to 1: words (their length and the share of technical ones), sentence length, concepts to 100 words, levels of verbs."""
    words = T.find_all(F.coalesce(c, F.lit("")), "[A-Za-z]+")
    n = F.size(words)
    unit = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    mean_word = F.aggregate(words, F.lit(0.0), lambda a, w: a + F.length(w)) / F.nullif(n, F.lit(0))
    vocabulary = (unit((mean_word - 4) / 4) + technical / F.nullif(n, F.lit(0)) * 5) / 2
    sentences = unit((n / F.greatest(F.size(T.sentences(c)), F.lit(1)) - 10) / 15)
    density = unit(concepts * 100 / F.nullif(n, F.lit(0)) / 5)
    counts = scoring.bloom_counts(F.coalesce(c, F.lit("")))
    total = reduce(lambda a, b: a + b, counts.values())
    level = reduce(lambda a, b: a + b, [counts[k] * w for k, w in LEVEL_DIFFICULTY.items()]) / F.nullif(total, F.lit(0))
    return F.when(n == 0, 0.0).otherwise(unit(0.25 * vocabulary + 0.25 * sentences + 0.25 * density + 0.25 * F.coalesce(level, F.lit(0.0))))


def difficulty_cascade(stated: Column, of_week: Column, of_outcomes: Column, c: Column, resource: Column) -> Column:
    """The first level known (stated, the week's, the outcomes') as a difficulty, else by words; introductions are intermediate at most."""
    table = F.create_map(*[F.lit(x) for kv in DIFFICULTY_OF_LEVEL.items() for x in kv])
    low = F.lower(F.coalesce(c, F.lit("")))
    has = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    words = F.when(has(["basic", "introduction", "overview", "what is", "define"]), "foundational").when(has(["evaluate", "create", "design", "critique", "justify"]), "advanced").otherwise("intermediate")
    got = F.coalesce(table[stated], table[of_week], table[of_outcomes], words)
    return F.when(F.coalesce(resource.isin(INTRODUCTORY), F.lit(False)) & (got == "advanced"), "intermediate").otherwise(got)


def low_signal_heading(c: Column) -> Column:
    """Whether a heading says nothing of its section: front and back matter, bylines, prompts, formulas, numbers alone."""
    h = F.lower(F.trim(c))
    return F.coalesce(
        (h == "") | h.rlike(r"^(?:table of )?contents$|^(?:preface|foreword|acknowledge?ments?|copyright|index|glossary|bibliography|references|appendix(?: [a-z0-9]+)?|about the authors?|dedication|colophon)$")
        | h.rlike(r"^by [a-z.' -]+$|^(?:page|p\.) ?\d+$|^[\d.\s]+$|^(?:try it|your turn|check your (?:understanding|answers)|think about it|activity|exercise|figure|table) ?[\d.]*:?$") | (F.length(F.regexp_replace(h, "[^=+*/^<>∑√∫]", "")) * 4 >= F.length(h)),
        F.lit(True),
    )


def claims(c: Column) -> Column:
    """(claim, observed, expected) of counts that differ from the standard's, and of lists that do not add up to what they are said to.

    A claim in a sentence about another version, the past or a supposition is none.
    """
    sentence = T.sentences(c)
    none = F.array().cast("array<struct<claim:string,observed:int,expected:int>>")
    found = []
    for pattern, name, right in CLAIMS:
        told = F.filter(sentence, lambda s: ~s.rlike(NO_CLAIM)) if name == "success criteria" else sentence
        hits = F.flatten(F.transform(told, _numbers(pattern)))
        found.append(F.transform(F.filter(hits, lambda n: n.cast("int") != right), _claim(name, right)))
    sums = F.flatten(F.transform(F.filter(sentence, lambda s: ~s.rlike(NO_CLAIM)), _sums))
    return F.coalesce(F.concat(*found, F.filter(sums, lambda x: x.isNotNull())), none)


def _numbers(pattern: str):
    return lambda s: T.find_all(s, pattern, 1)


def _claim(name: str, right: int):
    return lambda n: F.struct(F.lit(name).alias("claim"), n.cast("int").alias("observed"), F.lit(right).alias("expected"))


def _sums(s: Column) -> Column:
    heads, rests = T.find_all(s, CLAIM_OF_A_SUM, 1), T.find_all(s, CLAIM_OF_A_SUM, 2)

    def one(head, rest):
        numbers = F.filter(F.transform(T.find_all(rest, r"\b\d{1,3}\b"), lambda n: n.cast("int")), lambda n: (n > 0) & (n <= 500))
        total = F.aggregate(numbers, F.lit(0), lambda a, n: a + n)
        wrong = F.size(numbers).between(2, 6) & (total != head.cast("int"))
        return F.when(wrong, F.struct(F.lit("sum").alias("claim"), total.alias("observed"), head.cast("int").alias("expected")))

    return F.zip_with(heads, rests, one)


def salient_phrases(c: Column, most: int = 5) -> Column:
    """Title-case runs in their order, then words of six letters or more by how often they stand in the text; each once."""
    runs = F.array_distinct(F.transform(T.find_all(c, r"[A-Z][a-z]+(?: [A-Z][a-z]+)+"), lambda x: F.lower(x)))
    words = F.filter(T.find_all(F.lower(F.coalesce(c, F.lit(""))), "[a-z]{6,}"), lambda w: ~w.isin(T.STOP_WORDS))

    def ranked(s):  # in order, so that equal words stand together: each first place, and the distance to the next
        return let(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))), lambda at: F.array_sort(
            F.transform(at, lambda i, k: F.struct((i - F.coalesce(F.get(at, k + 1), F.size(s))).alias("n"), F.get(s, i).alias("w")))))

    own = let(F.array_sort(words), lambda s: F.when(F.size(s) > 0, F.transform(ranked(s), lambda r: r["w"])).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.concat(runs, own)), 1, most)
