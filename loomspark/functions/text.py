"""Column functions on text that other modules share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: The white space of the data's definitions (space, tab, LF, CR, U+00A0).
WS = " \\t\\n\\r\\u00A0"


def collapse(c: Column) -> Column:
    """Every run of white space one space, stripped."""
    return F.trim(F.regexp_replace(c, f"[{WS}]+", " "))


def slug_item(c: Column) -> Column:
    """A tag's item: lower case; runs of white space, `_`, `-`, U+2010-2013 one `-`; `-` stripped."""
    return F.trim(F.regexp_replace(F.lower(c), f"[{WS}_\\-\\u2010-\\u2013]+", "-"), F.lit("-"))


def term_item(c: Column) -> Column:
    """A term's item: lower case, runs of white space one space, stripped."""
    return collapse(F.lower(c))


def word_count(c: Column) -> Column:
    """Number of maximal runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(f"[^{WS}]+")), F.lit(0))


# Stop words of the ranking tokenizer.
STOP_WORDS = (
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may might must "
    "this that these those it its as if when where how what which who whom why can all each every both few more most other some such no not only same so "
    "than too very just also now here there then once any about into through during before after above below between under again further while your you we our they their"
).split()
# Fixed value: token pattern of the ranking tokenizer (criteria references, version references, hyphenated slugs, bare words).
TOKEN_RE = r"sc-[0-9]+(?:\.[0-9]+){1,2}|wcag-[0-9]+(?:\.[0-9]+)?|[a-z][a-z0-9]*(?:-[a-z0-9]+)+|[a-z0-9]+"


def strings(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def find_all(c: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a pattern; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def tokenize(c: Column, structured: bool = True) -> Column:
    """Ranking tokens: lower case, without stop words and one-letter tokens; repeats kept."""
    pattern = TOKEN_RE if structured else "[a-z0-9]+"
    return F.filter(find_all(F.lower(c), pattern), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) > 1))


def fold_references(c: Column) -> Column:
    """`SC 1.4.3` and `WCAG 2.2` as `sc-1.4.3` and `wcag-2.2`."""
    for name in ("sc", "wcag"):
        c = F.regexp_replace(c, rf"(?i)\b{name}\s+([0-9]+(?:\.[0-9]+){{0,2}})\b", f"{name}-$1")
    return c


def char_trigrams(c: Column) -> Column:
    """Distinct character trigrams of each word of three letters or more."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), "[^a-z0-9 ]", ""), " +"), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def ngrams(tokens: Column, n: int) -> Column:
    """Runs of n tokens joined by a space, repeats kept; none if there are fewer than n.

    Shifted copies are zipped, so that the tokens are computed a few times a row
    and not once for every position.
    """
    long = F.size(tokens) >= n
    length = F.greatest(F.size(tokens) - (n - 1), F.lit(0))
    runs = F.slice(tokens, F.lit(1), length)
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(tokens, F.lit(k + 1), length), lambda x, y: F.concat_ws(" ", x, y))
    return F.when(long, runs).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def canonical_slug(c: Column) -> Column:
    """Lower case, other characters deleted, white space a hyphen, no hyphen at the ends; inner runs are kept."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", ""), r"\s+", "-"), F.lit("-"))


def rule_slug(c: Column) -> Column:
    """As canonical_slug, but other characters become spaces and runs of hyphens one."""
    spaced = F.regexp_replace(F.lower(c), r"[^a-z0-9\s-]", " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(spaced, r"\s+", "-"), F.lit("-")), "-+", "-"), F.lit("-"))


def normalize_tag(c: Column, words: int = 4) -> Column:
    """Slug of at most `words` words that begins with a letter; '' otherwise."""
    slug = F.concat_ws("-", F.slice(F.filter(F.split(canonical_slug(c), "-"), lambda w: w != ""), 1, words))
    return F.when(slug.rlike("^[a-z]"), slug).otherwise(F.lit(""))


def url_slug(c: Column, longest: int = 50) -> Column:
    return F.trim(F.substr(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit(1), F.lit(longest)), F.lit("-"))


def sentences(c: Column) -> Column:
    """Split after `.`, `!` or `?` and white space; empty parts dropped."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(c, "<[^>]+>", " "))


def week_number(c: Column) -> Column:
    """The number in `week_3`, `Week 3`, `week-3`; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?i)week[_\-\s]?(\d+)", 1), F.lit("")).cast("int")


def content_words(c: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    return F.array_distinct(F.filter(find_all(F.lower(c), "[a-z]{3,}"), lambda t: ~t.isin(STOP_WORDS)))


def normal_answer(c: Column) -> Column:
    """Form in which answers and prompts are compared: lower case, no punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", ""), r"\s+", " "))


def segments(c: Column, shortest: int = 10) -> Column:
    """Parts between sentence ends, line feeds and list marks of at least `shortest` characters."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), r"[.!?\n;•]+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: F.length(s) >= shortest)


# Masking of messages, in this order.
MASKS = [
    (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<uuid>"),
    (r"[0-9]{4}-[0-9]{2}-[0-9]{2}[t ][0-9]{2}:[0-9]{2}:[0-9]{2}", "<timestamp>"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "<ip>"),
    (r"/[a-z0-9_./-]+", "<path>"),
    (r"[0-9]{4,}", "<number>"),
]


def mask_message(c: Column) -> Column:
    """Lower case with ids, times, addresses, paths and long numbers replaced, white space collapsed."""
    c = F.lower(c)
    for pattern, mark in MASKS:
        c = F.regexp_replace(c, pattern, mark)
    return collapse(c)


EMAIL_RE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL_RE = r"https?://[^\s<>\")]+"
PHONE_RE = r"\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}"


def entities(c: Column) -> Column:
    """Distinct e-mail addresses, URLs and telephone numbers of a text."""
    return F.struct(*[F.array_sort(F.array_distinct(find_all(c, p))).alias(n) for n, p in (("emails", EMAIL_RE), ("urls", URL_RE), ("phones", PHONE_RE))])
