"""Problem 9: keyword-stuffed pages, link lists and lists of product tags.

Method: six shares of a page against thresholds of its language: missing function
words, the most frequent word, three-word runs met before, duplicate lines, links,
and list separators. What is usual, and from where on a share is much, is told by
the quartiles of the language's own documents, all of them. As a page is spam if more than
half of its characters are, the shares are brought to bear on segments: a text is
cut at line feeds, sentence ends and separators, each segment is weighed by what it
adds to a share (a function word against one, a repeat within a few words or a
repeated run for it), and two states, lesson material and spam, are decoded over
the segments with a price for every change, dearer inside a line, so that a link in
a sentence or a heading above one changes nothing.

Function words are listed for four languages (and characters for Chinese, kana for
Japanese). Of any other language or script they are learned from document
frequency, where LEAST_DOCS documents or more are of it; below that its short
words stand for them. What language a text is in is told from the text.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, deque
from itertools import compress
from operator import ne

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# Common function words of four languages, and function characters of Chinese.
FUNCTION_WORDS = {
    "en": "the a an of to in and is it for on with as that this at by from or be are was were not which who what why how when while where if so than then because although unless until since after before during over under about into their they them its his her we us you our your i my can could may will would shall should must does do did has have had each every more most neither nor yet but also there these those between without within once even both either some any all no such only other another same very just here too now again whenever wherever through",
    "es": "el la los las un una unos unas de del y e o u en que no ni se por para con sin su sus es son fue al lo le les como cuando más pero si porque después cada este esta estos estas ese esa hay ya muy sobre entre desde hasta también",
    "fr": "le la les l d un une des du de et ou en que qui ne pas n se s pour avec sans dans sur est sont ce cet cette ces au aux par plus moins lorsque quand ensuite chaque il elle ils elles on nous vous leur leurs son sa ses mais donc si comme entre",
    "de": "der die das den dem des ein eine einen einem einer eines und oder aber in im ins zu zur zum mit ohne auf für von vom ist sind war nicht kein keine sie er es wir ihr wenn weder noch später nach bei aus als wird werden am an so auch nur wie sich dass ob um über unter zwischen vor",
}
FUNCTION_HAN = "的了在和就不都是也而与把被这那每如果然后没有能要"

#: Line feeds; blanks after the end of a sentence; separators between blanks. It begins with one class, which is looked for fast.
_CUT = re.compile(r"[\n \t\xa0\r](?:(?<=\n)\n*|(?<=[.!?。！？;…][ \t\xa0\r])[ \t\xa0\r]*|(?<=[ \t\xa0])[ \t\xa0]*[|*•·»>/–—][ \t\xa0]+)")
_URL = re.compile(r"(?:https?://|www\.)\S+|\b[a-zA-Z0-9-]+(?:\.[a-zA-Z0-9-]+)+/\S*")
_WORD = re.compile(r"[^\W_]+(?:[-'’][^\W_]+)*")
_KANA = re.compile("[\u3041-\u309f\u30a1-\u30fa]")
_LETTER = re.compile(r"[^\W\d_]")
_FOREIGN = re.compile("[^\\W\\d_a-zA-Z\u00aa-\u024f\u1e00-\u1eff\u3400-\u9fff]")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_CALL = re.compile(r"[^\W\d]\w*\(|[=!<>+]=|[{};]\s*$| = ")

_SEPARATORS = (", ", "; ", " | ", " • ", " · ", " » ", " * ", " > ", " / ", " – ", " — ", " #")

#: Words looked back on for repeats; weights of the evidence (natural log-odds for spam).
NEAR = 7
SPAM_RATE = 0.05
W_REPEAT, W_REPEAT_MORE, W_ACROSS, W_CODE = 3.0, 4.0, 1.0, -3.0
CHANGE_LINE, CHANGE_SENTENCE = 3.0, 4.0
#: Shares of a page in spam, against the language's usual ones: repeated runs (their words hang together, so each
#: counts a third), duplicate lines, links. The top word and separators count beyond the language's threshold, up to a limit.
SPAM_GRAM, SPAM_COPY, SPAM_LINK, LEAST_TOP, MOST_TOP, MOST_SEPARATOR = 0.9, 0.9, 0.9, 5, 2.0, 1.0
#: Measures of which the median is what is usual, and those of which the threshold is the upper quartile and three times the quartiles' distance.
MEDIAN, FENCE = ("function", "gram", "copy", "link"), ("top", "separator")
#: The least and most that a language's measures may be calibrated to.
BOUNDS = {"function": (0.1, 0.6), "top": (0.1, 0.4), "gram": (0.05, 0.5), "copy": (0.02, 0.5), "link": (0.045, 0.3), "separator": (0.1, 0.6)}
#: Where nothing is measured.
USUAL = {"function": 0.33, "top": 0.16, "gram": 0.05, "copy": 0.02, "link": 0.045, "separator": 0.2}
#: A text of LEAST_WORDS words or more with fewer listed function words than LISTED may be of another language: if most
#: letters are of another script, or short words are SHORT_SHARE of it and many different ones. SHORT letters make a short word.
LEAST_WORDS, LISTED, SHORT, SHORT_SHARE = 12, 0.12, 3, 0.12
#: With this share of function words of any list it need not be looked at.
MAYBE_LISTED = 0.3
#: Share of short words, where nothing is measured of a language that is not listed.
UNLISTED_RATE = 0.2
#: Learned function words: at most so many letters, in this share of the language's documents or more.
LEARNED_LETTERS, LEARNED_SHARE = 6, 0.25
#: Fewest documents by which a language that is not listed is calibrated.
LEAST_DOCS = 50


def plain(word: str) -> str:
    """Lower case without accents."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def words_of(text: str) -> list[str]:
    """_WORD's matches: no word has white space in it, and most parts between are a word, or one and a mark."""
    out: list[str] = []
    for x in text.split():
        if x.isalnum():
            out.append(x)
        elif x[:-1].isalnum():
            out.append(x[:-1])
        else:
            out += _WORD.findall(x)
    return out


def _languages() -> dict[str, str]:
    out: dict[str, str] = {}
    for lang, words in FUNCTION_WORDS.items():
        for w in words.split():
            out[plain(w)] = out.get(plain(w), "") + lang + " "
    return out


#: Kinds as bytes, and tables that mark one of them.
_KIND = {k: ord(k) for k in "fnhc"}
_IS_C, _IS_F = (bytes(i == _KIND[k] for i in range(256)) for k in "cf")


class _Side(dict):
    """word -> its form, or its kind as a byte: a column of _Words, looked up without Python code."""

    def __init__(self, words: "_Words", of) -> None:
        super().__init__()
        self.words, self.of = words, of

    def __missing__(self, w: str):
        if len(self) > 500_000:
            self.clear()
        self[w] = got = self.of(self.words[w])
        return got


class _Words(dict):
    """word -> (form, kind): kind `f` function word, `n` number, `h` Han with function characters, `c` content."""

    def __init__(self, own=None) -> None:
        """`own` are the function words of one language that is not listed; empty, its short words are taken for them."""
        super().__init__()
        self.function = _languages() if own is None else own
        self.short = own is not None and not own
        self.others: dict[str, _Words] = {}
        self.forms, self.kinds = _Side(self, lambda x: x[0]), _Side(self, lambda x: _KIND[x[1]])

    def of(self, language: str, learned: dict[str, list[str]]) -> "_Words":
        """The words of a language that is not listed."""
        if language not in self.others:
            self.others[language] = _Words(dict.fromkeys(learned.get(language, ()), language + " "))
        return self.others[language]

    def __missing__(self, w: str) -> tuple[str, str]:
        if len(self) > 500_000:
            self.clear()
        form = plain(w)
        if form in self.function:
            kind = "f"
        elif form.isdigit():
            kind = "n"
        elif _KANA.search(w):
            kind = "h" if len(w) >= 4 else "c"
        elif self.short and len(form) <= SHORT:
            kind = "f"
        elif any("㐀" <= c <= "鿿" for c in form):
            kind = "h" if len(form) >= 4 and any(c in FUNCTION_HAN for c in form) else "c"
        else:
            kind = "c"
            if len(form) > 3 and form.endswith("s"):
                form = form[:-1]
        self[w] = got = (form, kind)
        return got


def language_of(forms: list[str], function: dict[str, str]) -> str:
    """The language whose function words are most frequent, `zh` or `other` where there are none."""
    votes: dict[str, int] = {}
    for langs, n in Counter(map(function.get, forms)).items():
        for lang in (langs or "").split():
            votes[lang] = votes.get(lang, 0) + n
    return max(sorted(votes), key=votes.get) if votes else "other"


def unlisted(text: str, forms: list[str], function: dict[str, str]) -> str | None:
    """The name of a text's language if it is none that is listed: its script, or `latin`.

    A text is in a listed language if enough of its words are function words of that
    one; the lists together hold words of many others.
    """
    if len(forms) < LEAST_WORDS:
        return None
    best = language_of(forms, function)
    if sum(best in function.get(f, "").split() for f in forms) >= LISTED * len(forms):
        return None
    bare = _URL.sub(" ", text)
    foreign = _FOREIGN.findall(bare)
    if foreign and 2 * len(foreign) > len(_LETTER.findall(bare)) or _KANA.search(bare) and 3 * len(_KANA.findall(bare)) > len(_LETTER.findall(bare)):
        script = Counter(unicodedata.name(c, "UNKNOWN").split(" ")[0].lower() for c in foreign or "\u3042").most_common(1)[0][0]
        return "kana" if script in ("hiragana", "katakana") else script
    short = [f for f in map(plain, _WORD.findall(bare)) if len(f) <= SHORT and f.isalpha() and f.isascii() and best not in function.get(f, "").split()]
    if len(short) >= SHORT_SHARE * len(forms) and len(set(short)) >= max(4, min(9, 0.06 * len(forms))):
        return "latin"
    return None


def separators(text: str, a: int = 0, b: int | None = None) -> int:
    return sum([text.count(x, a, b) for x in _SEPARATORS])


def page_measures(text: str, words: _Words, learned: dict[str, list[str]] | None = None) -> tuple[str, int, dict[str, float]]:
    """(language, words, measures) of a text; its label is not trusted.

    The measures are shares: function words among words, the top word among content
    words, repeated runs among runs of three words, repeated lines among lines, links
    and separators to a word.
    """
    text = text if text.isascii() else _INVISIBLE.sub("", text)
    tokens = words_of(text)
    forms, kinds = list(map(words.forms.__getitem__, tokens)), bytes(map(words.kinds.__getitem__, tokens))
    function = list(compress(forms, kinds.translate(_IS_F)))
    other = None
    if len(function) < MAYBE_LISTED * len(forms) and (2 * kinds.count(b"h") <= len(kinds) or _KANA.search(text)):
        other = unlisted(text, forms, words.function)
    if other:
        own = words.of(other, learned or {})
        forms, kinds = list(map(own.forms.__getitem__, tokens)), bytes(map(own.kinds.__getitem__, tokens))
        function = list(compress(forms, kinds.translate(_IS_F)))
    content = Counter(compress(forms, kinds.translate(_IS_C)))
    n_content, n_han = kinds.count(b"c"), kinds.count(b"h")
    n = len(function) + n_content + n_han
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    out = {
        "top": max(content.values()) / n_content if content else 0.0,
        "gram": 1 - len(set(zip(forms, forms[1:], forms[2:]))) / (len(forms) - 2) if len(forms) > 2 else 0.0,
        "copy": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "link": min(1.0, len(_URL.findall(text)) / len(forms)) if forms and ("/" in text or "www." in text) else 0.0,
        "separator": min(1.0, separators(text) / len(forms)) if forms else 0.0,
        "function": (len(function) + n_han) / n if n else 0.0,
    }
    language = other or ("zh" if n_han * 2 > len(kinds) else language_of(function, words.function))
    return language, n, out


def spam_share(text: str, words: _Words, usual, learned: dict[str, list[str]] | None = None, other: str | None = None) -> float:
    """Share of the characters that stand in spam segments.

    `usual` is the language's share of function words, or its measures, or a function
    that gives them for the list of function words met and the name of a language that
    is not listed (so that a text is taken apart only once, unless it is of such a one;
    those have no calibrated share of function words unless `usual` gives it).
    """
    given, words = words, words.of(other, learned or {}) if other else words
    form_of, kind_of, find = words.forms.__getitem__, words.kinds.__getitem__, words_of
    sizes, odds, fresh, functions, change = [], [], [], [], []
    spans, contents, copies, linked = [], [], [], []
    order: list[str] = []  # all words in order, their kinds, and where each segment's end
    flow = bytearray()
    ends: list[int] = []
    met: list[str] = []
    lines: set[str] = set()
    seen: set[str] = set()
    tail: list[str] = []  # the last words of the line so far
    before: set[str] = set()  # the end of the line before: a heading is often taken up by its first sentence
    price = CHANGE_LINE
    at = 0
    text = text if text.isascii() else _INVISIBLE.sub("", text)
    for a, b in [*(m.span() for m in _CUT.finditer(text)), (len(text), len(text))]:
        feed = text.startswith("\n", a)
        seg = text[at:a]
        at = b
        n = len(seg)
        bare = seg.strip()
        if bare:
            odd = 0.0
            if "/" in seg or "www." in seg:
                links = _URL.findall(seg)
                if links:
                    linked.append((len(sizes), len(links)))
                    seg = _URL.sub(" ", seg)
                    bare = seg.strip()
            if ("(" in seg or "=" in seg) and _CALL.search(seg):
                odd += W_CODE
            tokens = find(seg)
            forms, kinds = list(map(form_of, tokens)), bytes(map(kind_of, tokens))
            own = list(compress(forms, kinds.translate(_IS_C)))
            called = list(compress(forms, kinds.translate(_IS_F)))
            new, function = len(own), len(called)
            if new + function < len(forms):
                odd -= sum([0.25 * len(f) if k == _KIND["h"] else 0.1 for f, k in zip(forms, kinds) if k not in b"cf"])
            if own:
                distinct = set(own)
                if len(distinct) < new or not distinct.isdisjoint(tail) or not distinct.isdisjoint(before):
                    recent: deque[str] = deque(tail, maxlen=NEAR)
                    for form, content in zip(forms, kinds.translate(_IS_C)):
                        if content:
                            k = recent.count(form)
                            if k:
                                odd += W_REPEAT if k == 1 else W_REPEAT_MORE
                                new -= 1
                            elif form in before:
                                odd += W_ACROSS
                                new -= 1
                        recent.append(form)
            tail = (tail + forms[-NEAR:])[-NEAR:] if len(forms) < NEAR else forms[-NEAR:]
            order += forms
            flow += kinds
            met += called
            if not function:
                if own:
                    key = plain(bare)
                    if key in seen:
                        odd += W_REPEAT  # a duplicate line without a function word
                    seen.add(key)
            else:
                if bare in lines:
                    copies.append(len(sizes))
                lines.add(bare)
            ends.append(len(order))
            spans.append((a - n, b))
            contents.append(own)
            sizes.append(n)
            odds.append(odd)
            fresh.append(new)
            functions.append(function)
            change.append(price)
        price = CHANGE_LINE if feed or not sizes else CHANGE_SENTENCE
        if feed and tail:
            before, tail = set(tail), []
    n_words = len(order)
    if not sizes:
        return 0.0
    if other is None and n_words >= LEAST_WORDS and len(met) < MAYBE_LISTED * n_words:
        name = unlisted(text, [*met, *(x for own in contents for x in own)], words.function)
        if name:
            return spam_share(text, given, usual, learned, name)
    if callable(usual):
        usual = usual(met, other)
    elif other:
        usual = USUAL | {"function": UNLISTED_RATE}
    if not isinstance(usual, dict):
        usual = USUAL | {"function": usual}
    rate = usual["function"]
    # content words that end a run of three words met before, by segment; not those of duplicate lines
    again = [0] * len(sizes)
    first: dict[tuple, int] = {}
    met_at = list(map(first.setdefault, zip(["", "", *order], ["", *order], order), range(n_words)))
    if len(first) < n_words:
        for j in compress(range(n_words), map(ne, met_at, range(n_words))):
            if flow[j] == _KIND["c"]:
                again[bisect_right(ends, j)] += 1
        for i in copies:
            again[i] = 0
    # evidence of the whole page
    counts = Counter([x for own in contents for x in own])
    n_content = counts.total()
    top = max(counts, key=counts.get) if counts else ""
    w_top = math.log(counts[top] / n_content / usual["top"]) if counts[top] >= LEAST_TOP else 0.0
    density = separators(text) / n_words if n_words else 0.0
    w_separator = math.log(density / usual["separator"]) if density else 0.0
    w_gram, w_copy = math.log(SPAM_GRAM / usual["gram"]) / 3, math.log(SPAM_COPY / usual["copy"])
    odds = [o + k * w_gram for o, k in zip(odds, again)]
    for i in copies:
        odds[i] += w_copy
    w_link = math.log(SPAM_LINK / usual["link"])
    for i, k in linked:
        odds[i] += k * w_link
    if w_top > 0:
        odds = [o + min(MOST_TOP, w_top) * own.count(top) for o, own in zip(odds, contents)]
    if w_separator > 0:
        odds = [o + min(MOST_SEPARATOR, w_separator) * separators(text, a, b) if own else o for o, (a, b), own in zip(odds, spans, contents)]
    # two-state decoding: score of the best path that ends in either state, and where it came from
    lo_f, lo_c = math.log(SPAM_RATE / rate), math.log((1 - SPAM_RATE) / (1 - rate))
    good, bad = 0.0, -1.0
    back = []
    for o, n, f, c in zip(odds, fresh, functions, change):
        o += n * lo_c + f * lo_f
        g_from_bad, b_from_good = bad - c > good, good - c > bad
        good, bad = (bad - c if g_from_bad else good), (good - c if b_from_good else bad) + o
        back.append((g_from_bad, b_from_good))
    state, spam = bad > good, 0
    for (g, b), n in zip(reversed(back), reversed(sizes)):
        if state:
            spam += n
        state = (not b) if state else g
    return spam / sum(sizes)


def learn_function_words(docs: DataFrame, least_docs: int = LEAST_DOCS, least_words: int = 40) -> dict[str, list[str]]:
    """Function words of languages that are not listed: their short words in LEARNED_SHARE of their documents or more.

    Counted over all documents; a language of fewer than `least_docs` documents has
    none. The driver receives at most 4 / LEARNED_SHARE * 100 words a language, since a
    document of the usual length has few of them.
    """

    def run(frames):
        words, counts = _Words(), Counter()
        for pdf in frames:
            for t in pdf["text"]:
                tokens = _WORD.findall(_INVISIBLE.sub("", t))
                if len(tokens) < least_words:
                    continue
                forms = [words[w] for w in tokens]
                known = sum(k == "f" for _, k in forms)
                name = unlisted(t, [f for f, _ in forms], words.function) if known < MAYBE_LISTED * len(forms) else None
                if name:
                    counts[name, ""] += 1
                    counts.update((name, f) for f in {f for f, _ in forms} if len(f) <= LEARNED_LETTERS and f.isalpha())
            if len(counts) > 200_000:
                yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["language", "word", "n"])
                counts.clear()
        yield pd.DataFrame([(a, b, n) for (a, b), n in counts.items()], columns=["language", "word", "n"])

    got = docs.where("text is not null").select("text").mapInPandas(run, "language string, word string, n long").groupBy("language", "word").agg(F.sum("n").alias("n"))
    total = got.where("word = ''").select("language", F.col("n").alias("docs"))
    often = got.join(F.broadcast(total), "language").where((F.col("docs") >= least_docs) & (F.col("n") >= LEARNED_SHARE * F.col("docs")) & (F.col("word") != ""))  # a row a script
    out: dict[str, list[str]] = {}
    for r in often.select("language", "word").collect():
        out.setdefault(r["language"], []).append(r["word"])
    return {k: sorted(v) for k, v in out.items()}


def calibrate(docs: DataFrame, least_words: int = 40, learned: dict[str, list[str]] | None = None) -> dict[str, dict[str, float]]:
    """What is usual of each measure by language, by its quartiles over all documents of `least_words` words or more."""
    names = list(BOUNDS)

    def run(frames):
        words = _Words()
        for pdf in frames:
            rows = []
            for t in pdf["text"]:
                language, n, got = page_measures(t, words, learned)
                if n >= least_words or language == "zh" and n >= least_words / 5:  # runs of Han are several words each
                    rows += [(language, m, int(got[m] * 200)) for m in names]
            yield pd.DataFrame(rows, columns=["language", "measure", "bin"])

    bins = docs.where("text is not null").select("text").mapInPandas(run, "language string, measure string, bin int")
    rows = bins.groupBy("language", "measure", "bin").count().collect()  # 201 bins a language and measure at most
    own: dict = {}
    for r in rows:
        own.setdefault((r["language"], r["measure"]), []).append((r["bin"], r["count"]))
    out: dict = {}
    for (lang, name), counts in own.items():
        total, run_, quartiles = sum(c for _, c in counts), 0, []
        if total < LEAST_DOCS and lang not in FUNCTION_WORDS:
            continue
        for b, c in sorted(counts):
            run_ += c
            while len(quartiles) < 3 and run_ >= total * (len(quartiles) + 1) / 4:
                quartiles.append(b / 200)
        low, middle, high = quartiles
        value = middle if name in MEDIAN else high + 3 * (high - low)
        out.setdefault(lang, {})[name] = min(BOUNDS[name][1], max(BOUNDS[name][0], value))
    return out


def spam_pages(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spam_share double, is_spam boolean) of every row with a non-blank text.

    Null, empty and blank texts are no pages and are left out; repeated ids give
    repeated rows; whole texts are read. The language is told from the text, since
    labels may be missing or wrong. Shares are calibrated over all rows first (one
    narrow pass that sends a few hundred counts), then one narrow pass scores. Only
    where many documents are of languages that are not listed, two passes more learn
    those languages' function words and calibrate by them.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    rates, learned = calibrate(src), {}
    if set(rates) - set(FUNCTION_WORDS) - {"zh", "other"}:
        learned = learn_function_words(src)
        if learned:
            rates = calibrate(src, learned=learned)
    usual = rates.get("en", USUAL)

    def run(frames):
        words = _Words()

        def rate(met: list[str], other: str | None) -> dict[str, float]:
            if other:
                return rates.get(other, USUAL | {"function": UNLISTED_RATE})
            return rates.get(language_of(met, words.function), usual) if met else usual

        for pdf in frames:
            ids, share = [], []
            for i, t in zip(pdf["id"], pdf["text"]):
                if t.strip():
                    ids.append(i)
                    share.append(spam_share(t, words, rate, learned))
            yield pd.DataFrame({id_col: ids, "spam_share": share})

    scored = src.mapInPandas(run, f"{id_col} {kind}, spam_share double")
    return scored.withColumn("is_spam", F.col("spam_share") > threshold)
