import math

import pytest
from pyspark.sql import functions as F

from loomspark.functions import ids, scoring as S, text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.tokenize, "The aria-labelledby of SC sc-1.4.3 is a WCAG wcag-2.2 x", ["aria-labelledby", "sc", "sc-1.4.3", "wcag", "wcag-2.2"]),
        (T.tokenize, "", []), (T.tokenize, None, []),
        (T.canonical_slug, "WCAG 2.2 AA", "wcag-22-aa"), (T.canonical_slug, "--a--b--", "a--b"), (T.canonical_slug, "!!!", ""), (T.rule_slug, "a.b  c--d", "a-b-c-d"),
        (T.normalize_tag, "One two three four five", "one-two-three-four"), (T.normalize_tag, "3d models", ""),
        (T.slug_item, " Flow‑Rate _x ", "flow-rate-x"), (T.term_item, " A \t b ", "a b"),
        (T.char_trigrams, "ab cab", ["cab"]), (T.char_trigrams, "a b", []),
        (T.sentences, "One. Two? Three", ["One.", "Two?", "Three"]), (T.sentences, None, []),
        (T.week_number, "Week-12 intro", 12), (T.week_number, "module", None),
        (T.word_count, " a b\r\nc ", 3), (T.word_count, None, 0), (T.strip_tags, "<p>a <b>b</b></p>", "a b"),
        (T.mask_message, "Failed /tmp/x.txt at 2024-01-02T03:04:05 id 123456", "failed <path> at <timestamp> id <number>"),
        (T.fold_references, "see SC 1.4.3 and WCAG 2.2", "see sc-1.4.3 and wcag-2.2"),
        (S.detect_bloom, "First define, then evaluate and differentiate", "analyze"), (S.detect_bloom, "nothing", None),
        (ids.course_code, "wcag 201x", "WCAG_201"), (ids.pdf_date, "D:20240131120000", __import__("datetime").date(2024, 1, 31)), (ids.pdf_date, "x", None), (ids.valid_lo_id, "CO-01", True), (ids.valid_lo_id, None, False),
    ],
)
def test_expressions(spark, f, value, want):
    assert one(spark, value, f) == want


def test_ngrams_of_short_input(spark):
    g = lambda n: lambda c: T.ngrams(F.split(c, " "), n)
    assert one(spark, "a b c", g(2)) == ["a b", "b c"] and one(spark, "a b", g(3)) == [] and one(spark, "a b c", g(3)) == ["a b c"]


def test_scores(spark):
    assert one(spark, 3, lambda c: S.bm25_idf(F.lit(10), c), "int") == pytest.approx(math.log(7.5 / 3.5 + 1))
    assert one(spark, 2.0, lambda c: S.combine_boosts(c, {"a": (F.lit(3.0), 0.3)}), "double") == 3.0  # capped at half
    assert one(spark, 2.0, lambda c: S.combine_boosts(c, {"a": (F.lit(-9.0), 0.3)}), "double") == 1.0
    assert one(spark, "because", S.rationale_depth) == pytest.approx(7 / 300 + 0.05)
    assert one(spark, None, S.rationale_depth) == 0
    assert [one(spark, w, S.syllables) for w in ("table", "make", "a", "coffee", "banana")] == [1, 1, 1, 1, 3]
    assert one(spark, 7, S.backoff, "int") == 60.0
    assert one(spark, None, lambda c: S.decision_quality(F.lit(""), F.lit(True), F.lit(False), c, F.lit(None).cast("boolean")), "double") == pytest.approx(0.2 + 0.05 + 0.075)
