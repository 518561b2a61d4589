"""The fast ways to words and cuts of a text give what the plain patterns give."""

import random
import re

from loomspark.llm import spam as S

PLAIN_CUT = re.compile(r"(\n+)|(?<=[.!?。！？;…])[ \t\xa0\r]+|[ \t\xa0]+[|*•·»>/–—][ \t\xa0]+")


def test_words_and_cuts_are_those_of_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        t = "".join(r.choices("ab1é_-'’ .!;…|*/–\n\r\t\xa0\x85 中あ²०", k=r.randint(0, 14)))
        assert S.words_of(t) == S._WORD.findall(t)
        assert [(*m.span(), bool(m.group(1))) for m in PLAIN_CUT.finditer(t)] == [(*m.span(), t[m.start()] == "\n") for m in S._CUT.finditer(t)]


def test_words_are_not_looked_for_by_the_pattern_where_white_space_tells(monkeypatch):
    met = []

    class Pattern:
        def findall(self, x):
            met.append(x)
            return PATTERN.findall(x)

    PATTERN = S._WORD
    monkeypatch.setattr(S, "_WORD", Pattern())
    text = "The cell divides, then rests. A well-known case follows it.\n" * 20
    assert S.page_measures(text, S._Words())[1] > 150 and S.spam_share(text, S._Words(), S.USUAL) >= 0
    assert set(met) == {"well-known"}
