"""Problem 2: repair of text extracted from scanned pages.

Method: the lines of a file are taken out of their pages (running lines and page
numbers are told by their place at a page's edge and by coming back there), and
what is left is one stream of characters. Words are decoded jointly over it by
dynamic programming. Most of the stream is words of the lexicon that stand alone,
which cost nothing and are passed over token by token, as are words with misread
characters or divided at a line end. Where that leaves something unread, the stretch
is taken as characters: a lattice of all lexicon words that can be walked over it
through confusions, white space inside a word, divisions and words run together, in
any number, is built on a trie, and its cheapest path wins. Paragraph boundaries are
chosen by a last dynamic program over the lines.

A file is worked on in windows of pages with a margin on both sides, so that a file
holding a third of all rows is spread over many tasks; what needs the whole file
(how often a line comes back at page edges) is counted with a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomspark.session import materialize

#: Records in a window and its margin on either side: blocks, and lines (spans) of this many pages.
BLOCKS, BLOCK_MARGIN = 400, 60
PAGES, PAGE_MARGIN = 16, 2
#: Lines without a page, in windows by their number, and the names of those windows; records without any number have windows of their own.
LINES, LINE_MARGIN, UNPAGED, UNPLACED = 800, 60, 1_000_000_000, 2_000_000_000
#: Costs of the lattice: a confusion, white space inside a word, a word's end inside a token, a division at a line end; the most of one word.
CONFUSED, TORN, RUN_ON, DIVIDED, MOST_COST = 1.0, 1.0, 1.1, 0.2, 4.5
#: Longest token that is searched by trying confusions on it; longer ones are walked on the trie.
TRIED = 40

# Usual misreadings of print, what is seen -> what was printed.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("!", "i"), ("!", "l"), ("|", "l"), ("|", "i"), ("5", "s"), ("$", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("q", "g"), ("g", "q"),
    ("ç", "c"), ("c", "e"), ("e", "c"), ("b", "h"), ("h", "b"), ("f", "t"), ("t", "f"), ("v", "y"), ("y", "v"), ("i", "l"), ("l", "i"), ("l", "t"), ("t", "l"), ("j", "i"), ("u", "n"), ("n", "u"),
    ("o", "a"), ("a", "o"), ("o", "e"), ("e", "o"), ("é", "e"), ("è", "e"), ("ö", "o"), ("ü", "u"), ("ii", "u"), ("li", "u"), ("ll", "u"), ("rn", "m"), ("nn", "m"), ("m", "rn"), ("m", "in"), ("in", "m"), ("ni", "m"), ("vv", "w"), ("cl", "d"), ("d", "cl"), ("ci", "d"), ("h", "li"), ("li", "h"), ("n", "ri"), ("ri", "n"), ("b", "lo"), ("k", "lc"),
    ("lc", "k"), ("u", "ll"), ("fi", "fl"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("z", "2"), ("2", "z"), ("4", "a"), ("@", "a"), ("€", "e"), ("s", "a"), ("r", "t"),
]
DIVIDERS = "-¬\xad‐‑"

_TRIM = ".,;:?!()\"“”‘’'[]{}…*"
_NUMBER_LINE = re.compile(r"^[\s\-–—\[\](){}|·•.*~<>«»]*(?:(?:page|pg|p|seite|s)\b\.?\s*)?([0-9IlOoSBZ!|]{1,4}|[ivxlc]{1,6})(?:\s*(?:of|/)\s*\d+)?[\s\-–—\[\](){}|·•.*~<>«»]*$", re.I)
_PAGE = r"(?:(?:page|pg|p|seite)\b\.?\s*)"
_COUNT = r"[0-9IlOoSBZ!|]{1,4}(?:\s*(?:of|/)\s*[0-9IlOoSBZ!|]{1,4})?"
_NUMBER_END = re.compile(rf"(?:\s{{2,}}|\s*[|·•—–\[(]\s*|\s+-\s*){_PAGE}?[\[(\-–—]?\s*(?:{_COUNT}|[ivxlc]{{1,6}})\s*[\])\-–—]?\s*$|\s+{_PAGE}?[0-9][0-9IlOoSBZ!]{{0,3}}\s*$|\s+{_PAGE}{_COUNT}\s*$", re.I)
_NUMBER_START = re.compile(rf"^\s*(?:{_PAGE}{_COUNT}\s+|[\[(\-–—]?\s*{_COUNT}\s*(?:[\])]\s*|[\-–—|·•]\s*|\s{{2,}}|(?<=\d)\s+)|[ivxlc]{{1,6}}(?:\s{{2,}}|\s*[|·•—–]\s*))(?=\S)", re.I)
_PARTS = re.compile(r"\s+[—–|·•-]\s+|\s{3,}")
_CHAPTER = re.compile(r"^\s*(?:chapter|unit|part|lesson|module)\s+(?:\w+)\s*[:.\-–—]\s*(.+)$", re.I)
_CAPTION = re.compile(r"^\s*(?:figure|fig\.|table|box|plate)\s+[\dA-Z][\dlIOS.\-]*\s*[:.]", re.I)
_NUMERIC = re.compile(r"^[\s\d.,:%/+\-–—|]*$")


def fold(line: str) -> str:
    """A form that is equal for a line and its misreadings: letters of one class become one letter."""
    line = re.sub("(?<=[a-z])U", "ll", re.sub("(?<=[a-z])I", "l", line))
    s = "".join(c for c in unicodedata.normalize("NFKD", line.lower()) if not unicodedata.combining(c))
    for a, b in (("rn", "m"), ("in", "m"), ("vv", "w"), ("ii", "u"), ("cl", "d"), ("li", "h"), ("ri", "n")):
        s = s.replace(a, b)
    s = s.translate(str.maketrans("01!|l56b89qeftv", "oiiiishhhggctty"))
    return re.sub(r"[^a-z]+", "", s)


def running_form(line: str) -> str:
    """The fold of a line without a page number at either end."""
    return fold(_NUMBER_START.sub("", _NUMBER_END.sub("", line.strip())))


def number_style(line: str) -> str:
    """The ornaments of a page-number line, digits left out."""
    return re.sub(r"[0-9IlOoSBZ!|]+|[ivxlc]+", "#", re.sub(r"\s+", " ", line.strip()), count=0)


class Lexicon:
    """Words, their misreadings and the cost of reading a token as one of them."""

    def __init__(self, words) -> None:
        self.words = {w for w in words if w}
        self.cache: dict[str, tuple[str | None, float]] = {}
        self.by_seen: dict[str, list[tuple[str, str]]] = {}
        for seen, right in CONFUSIONS:
            self.by_seen.setdefault(seen, []).append((seen, right))
        self.trie: dict = {}
        for w in self.words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.one_off: dict[str, set[str]] = {}
        for w in self.words:
            if len(w) > 3:
                for i in range(len(w)):
                    self.one_off.setdefault(w[:i] + "*" + w[i + 1 :], set()).add(w)

    def has(self, w: str) -> bool:
        return w in self.words or w.isdigit() or (w.endswith("'s") and w[:-2] in self.words)

    def repair(self, token: str, most: int = 3) -> tuple[str | None, float]:
        """(word, cost) of the cheapest reading through confusions; (None, 0) where there is none."""
        got = self.cache.get(token)
        if got is None:
            got = self._search(token, most)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[token] = got
        return got

    def _search(self, token: str, most: int) -> tuple[str | None, float]:
        if len(token) < 2:
            return None, 0.0
        if len(token) > TRIED:
            return self._whole(token, most)
        level, seen = {token}, {token}
        for step in range(1, most + 1):
            nxt = set()
            for t in level:
                for i in range(len(t)):
                    for n in (1, 2):
                        for a, b in self.by_seen.get(t[i : i + n], ()) if i + n <= len(t) else ():
                            c = t[:i] + b + t[i + n :]
                            if c not in seen:
                                seen.add(c)
                                nxt.add(c)
            hits = sorted(w for w in nxt if w in self.words)
            if hits:
                return hits[0], float(step)
            if len(nxt) > 20_000:  # too many to be tried one by one: the trie holds only those that begin a word
                found = self._whole(token, most)
                if found[0]:
                    return found
                break
            level = nxt
        if len(token) > 3:
            near = set().union(*(self.one_off.get(token[:i] + "*" + token[i + 1 :], set()) for i in range(len(token))))
            if len(near) == 1:
                return near.pop(), 2.5
        return None, 0.0


    def _whole(self, token: str, most: int) -> tuple[str | None, float]:
        """The word that a token can be walked to with fewest confusions; of equal ones the first in order."""
        ends = [(cost, w) for q, w, cost in self.walk(token, 0, most * CONFUSED) if q == len(token)]
        return (min(ends)[1], min(ends)[0]) if ends else (None, 0.0)

    def walk(self, stream: str, start: int, most: float) -> list[tuple[int, str, float]]:
        """(end, word, cost) of every lexicon word that can be read from `start` of a stream at `most` or less.

        A blank in the stream is white space between tokens, a line feed one at which
        the token before is divided (its hyphen left out).
        """
        best: dict[tuple[int, int], float] = {}
        found: dict[tuple[int, str], float] = {}
        todo = [(self.trie, start, 0.0)]
        while todo:
            node, q, cost = todo.pop()
            key = (id(node), q)
            if cost > most or best.get(key, most + 1) <= cost:
                continue
            best[key] = cost
            w = node.get("")
            if w and q > start and found.get((q, w), most + 1) > cost:
                found[q, w] = cost
            if q == len(stream):
                continue
            c = stream[q]
            if c in node and c:
                todo.append((node[c], q + 1, cost))
            if q > start and c == " ":
                todo.append((node, q + 1, cost + TORN))
            elif q > start and c == "\n":
                todo.append((node, q + 1, cost + DIVIDED))
                if "-" in node:
                    todo.append((node["-"], q + 1, cost + DIVIDED))
            if cost + CONFUSED <= most:
                for n in (1, 2):
                    for _, right in self.by_seen.get(stream[q : q + n], ()) if q + n <= len(stream) else ():
                        at = node
                        for r in right:
                            at = at.get(r)
                            if at is None:
                                break
                        if at is not None:
                            todo.append((at, q + n, cost + CONFUSED))
        return [(q, w, cost) for (q, w), cost in found.items()]


def read_stretch(stream: str, lex: Lexicon) -> tuple[float, list[str]] | None:
    """(cost, words) of the cheapest reading of a stretch of characters as words of the lexicon, None if it has none.

    Words of one letter stand between blanks only; a short word is not guessed: its
    cost is at most a third of its letters.
    """
    n = len(stream)
    best: list[float] = [0.0] + [float("inf")] * n
    back: list[tuple] = [()] * (n + 1)
    for p in range(n):
        if best[p] == float("inf"):
            continue
        if stream[p] in " \n":
            if best[p] < best[p + 1]:
                best[p + 1], back[p + 1] = best[p], (p, None)
            continue
        begins = p == 0 or stream[p - 1] in " \n"
        for q, w, cost in lex.walk(stream, p, MOST_COST):
            ends = q == n or stream[q] in " \n"
            if cost * 3 > len(w) or len(w) < (1 if begins and ends else 3):
                continue
            total = best[p] + cost + (0.0 if ends else RUN_ON)
            if total < best[q]:
                best[q], back[q] = total, (p, w)
    if best[n] == float("inf"):
        return None
    words, at = [], n
    while at > 0:
        at, w = back[at]
        if w:
            words.append(w)
    return best[n], words[::-1]


def _core(tok: str) -> str:
    return tok.lower().strip(_TRIM)


def decode(tokens: list[tuple[str, bool]], lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """The cheapest joint reading of a stream of (token, ends a line).

    Returns (first token, tokens used, kind, word): kind is `word`, `hyphen` (two
    halves of a divided word), `misread`, `hyphen+misread`, `merge` (one word torn
    apart), `split` (two words run together), `suspended` or `other`.
    """
    n = len(tokens)
    best = [0.0] * (n + 1)
    back: list[tuple] = [()] * (n + 1)

    def joins(i: int):
        a, b = tokens[i][0], _core(tokens[i + 1][0])
        stem = a.lower().lstrip(_TRIM)
        divided = tokens[i][1] and stem[-1:] in tuple(DIVIDERS) and len(stem) > 1
        if divided:
            first = stem[:-1]
            for w in ((first + "-" + b), (first + b)):
                if w in lex.words:
                    yield 0.2, "hyphen", w
                    return
            for w in (first + b, first + "-" + b):
                r, c = lex.repair(w)
                if r and c < 2.5:
                    yield 0.4 + c, "hyphen+misread", r
                    return
        elif not tokens[i][1]:
            w = _core(a) + b
            if w in lex.words and not (lex.has(_core(a)) and lex.has(b)) and len(w) > 3:
                yield 1.5, "merge", w

    def singles(i: int):
        raw, end = tokens[i]
        w = _core(raw)
        if not w or lex.has(w) or not any(c.isalpha() for c in w) and not any(c.isdigit() for c in w):
            yield 0.0, "word", w
            return
        if end and raw[-1:] in tuple(DIVIDERS) and lex.has(w.strip(DIVIDERS)):
            yield 0.3, "suspended", w.strip(DIVIDERS)
        if w.rstrip("-") != w and lex.has(w.rstrip("-")):
            yield 0.3, "suspended", w.rstrip("-")
        full = raw.lower().strip(".,;:?()\"“”‘’'[]{}…*")  # a ! may be a misread letter
        for t in dict.fromkeys((full, w)):
            if any(c.isalpha() for c in t):
                r, c = lex.repair(t)
                if r:
                    yield c, "misread", r
                    break
        for k in range(2, len(w) - 1):
            if w[:k] in lex.words and w[k:] in lex.words:
                yield 2.2, "split", w[:k] + " " + w[k:]
                break
        yield 4.0, "other", w

    for i in range(1, n + 1):
        best[i] = float("inf")
    for i in range(n):
        for cost, kind, word in singles(i):
            if best[i] + cost < best[i + 1]:
                best[i + 1], back[i + 1] = best[i] + cost, (i, 1, kind, word)
        if i + 1 < n:
            for cost, kind, word in joins(i):
                if best[i] + cost < best[i + 2]:
                    best[i + 2], back[i + 2] = best[i] + cost, (i, 2, kind, word)
    out, at = [], n
    while at > 0:
        out.append(back[at])
        at = back[at][0]
    return _reread(out[::-1], tokens, lex)


def _reread(read: list[tuple[int, int, str, str]], tokens: list[tuple[str, bool]], lex: Lexicon) -> list[tuple[int, int, str, str]]:
    """The reading with its unread stretches read as characters, alone or together with short tokens beside them."""
    if not any(kind == "other" for _, _, kind, _ in read):
        return read
    out, i = [], 0
    while i < len(read):
        if read[i][2] != "other":
            out.append(read[i])
            i += 1
            continue
        j = i
        while j + 1 < len(read) and read[j + 1][2] == "other" and not _ends_whole(read[j], tokens):
            j += 1
        done = None
        for a, b in ((i, j), (i, j + 1), (i - 1, j), (i - 1, j + 1)):
            taken = i - a
            if a < 0 or b >= len(read) or taken > len(out) or taken and (out[-1] != read[a] or _ends_whole(read[a], tokens)) or any(_ends_whole(read[k], tokens) for k in range(a, b)):
                continue
            if any(read[k][2] not in ("other", "word") for k in range(a, b + 1)):
                continue
            first, last = read[a][0], read[b][0] + read[b][1]
            stretch = "".join(_piece(tokens[k], k + 1 < last) for k in range(first, last))
            got = read_stretch(stretch, lex)
            if got and got[0] <= max(4.0 * sum(read[k][2] == "other" for k in range(a, b + 1)), len(stretch) / 5):  # dearer than leaving it unread, but for long ones
                done = (a, b, first, last - first, got[1])
                break
        if done is None:
            out += read[i : j + 1]
            i = j + 1
            continue
        a, b, first, used, words = done
        if a < i:
            out.pop()
        kind = "merge" if len(words) == 1 and used > 1 else "split" if used == 1 and len(words) > 1 else "resegmented"
        out.append((first, used, kind, " ".join(words)))
        i = b + 1
    return out


def _ends_whole(entry: tuple, tokens: list[tuple[str, bool]]) -> bool:
    """Whether an entry's last token ends its line undivided."""
    raw, end = tokens[entry[0] + entry[1] - 1]
    return end and raw[-1:] not in tuple(DIVIDERS)


def _piece(token: tuple[str, bool], more: bool) -> str:
    """A token's characters in a stretch, with what parts it from the next."""
    raw, end = token
    if end and raw[-1:] in tuple(DIVIDERS):
        return _core(raw[:-1]) + ("\n" if more else "")
    return _core(raw) + (" " if more else "")


# ---------------------------------------------------------------- lines of a window


def to_lines(rows: pd.DataFrame, kind: str) -> list[dict]:
    """The non-blank lines of a window, in order, with page numbers counted from its beginning."""
    lines, page, last_page, last_y = [], 0, None, None
    rows = rows.sort_values(["seq", "rec"], kind="stable")
    for r in rows.itertuples(index=False):
        y0 = r.y0 if r.y0 == r.y0 else None
        known = r.page == r.page and r.page is not None
        if last_page is not None or last_y is not None:
            if known and last_page is not None:
                page += int(r.page != last_page)
            elif y0 is not None and last_y is not None and y0 < last_y - 5:
                page += 1
        last_page = r.page if known else last_page
        last_y = y0 if y0 is not None else last_y
        parts = [p for p in (r.text or "").replace("\r", "").split("\n")]
        own = [(i, p) for i, p in enumerate(parts) if p.strip()]
        for i, p in own:
            lines.append({
                "rec": r.rec, "no": i, "text": p, "page": page, "core": bool(r.core), "hint": r.hint, "alone": len(own) == 1, "first": i == own[0][0], "last": i == own[-1][0],
                "y0": y0 if (len(own) == 1 or i == own[0][0]) else None, "y1": (r.y1 if r.y1 == r.y1 else None) if i == own[-1][0] else None, "size": r.size, "open_page": y0 is None and not known,
            })
    return lines


def page_edges(lines: list[dict], depth: int = 3) -> tuple[set[int], set[int]]:
    """Indices of the first and of the last `depth` lines of every page."""
    head, foot, start = set(), set(), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or (i and lines[i]["page"] != lines[i - 1]["page"]):
            head.update(range(start, min(start + depth - 1, i)))
            foot.update(range(max(start, i - depth), i))
            start = i
    if lines and all(x["open_page"] for x in lines):  # neither pages nor places: a record's own edges
        head |= {i for i, x in enumerate(lines) if x["first"]}
        foot |= {i for i, x in enumerate(lines) if x["last"]}
    return head, foot


def is_number_line(text: str) -> bool:
    m = _NUMBER_LINE.match(text)
    if not m:
        return False
    bare = text.strip() == m.group(1)
    return any(c.isdigit() for c in m.group(1)) or not bare or m.group(1).lower() not in ("i", "l", "o", "s", "b")


def candidate_forms(rows: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Every line of a window's core with its form, whether it stands at an edge, and whether it cuts a sentence: what is counted over the whole file."""
    lines = to_lines(rows, kind)
    head, foot = page_edges(lines)
    out, cut = [], False
    for i, x in enumerate(lines):
        t = x["text"].strip()
        ends = bool(re.search(r"[.?!:;]['\")”’]*$", t)) or bool(_CHAPTER.match(t))
        inside, cut = cut, False if ends else True if len(t) >= 40 else cut  # short lines without an end decide nothing
        if not x["core"]:
            continue
        edge = i in head or i in foot
        if is_number_line(x["text"]):
            out.append((x["rec"], x["no"], "#" + number_style(x["text"]), edge, inside))
            continue
        parts = [x["text"]]
        if edge:  # a running line may be put together from two
            bare = _NUMBER_START.sub("", _NUMBER_END.sub("", x["text"].strip()))
            parts += [p for p in _PARTS.split(bare)] if _PARTS.search(bare) else []
        for f in dict.fromkeys(running_form(p) for p in parts):
            if len(f) > 5 or len(f) > 2 and len(parts) == 1:
                out.append((x["rec"], x["no"], f, edge, inside))
        m = _CHAPTER.match(x["text"])
        if m:
            out.append((None, -1, "=" + fold(m.group(1)), False, False))
    return pd.DataFrame(out, columns=["rec", "no", "form", "edge", "cut"])


def classify(lines: list[dict], counts: dict[tuple[str, int], tuple[int, int, bool, int]]) -> None:
    """Sets each line's kind: running, number, caption, table, heading or prose."""
    head, foot = page_edges(lines)
    for i, x in enumerate(lines):
        t = x["text"].strip()
        if x["hint"] == "table" or (_NUMERIC.match(t) and not (i in head or i in foot)):
            x["kind"] = "table"
        elif _CAPTION.match(t) or x["hint"] == "figure_caption":
            x["kind"] = "caption"
        elif _CHAPTER.match(t):
            x["kind"] = "heading"
        else:
            x["kind"] = "prose"

    # edge lines whose form is damaged beyond the fold: close to a form that does come back
    paged = not (lines and all(x["open_page"] for x in lines))
    styles = {}
    for x in lines:
        if is_number_line(x["text"]) and x["hint"] != "table":
            styles[number_style(x["text"])] = counts.get((x["rec"], x["no"]), (0, 0, False, 0))[0]
    usual = max(styles.values(), default=0)
    known = {}
    for i in head | foot:
        e, m, t, c = counts.get((lines[i]["rec"], lines[i]["no"]), (0, 0, False, 0))
        if t or e >= 3 and m * 5 <= e and (paged or c * 5 >= e):
            known[running_form(lines[i]["text"])] = True
    damaged = set()
    for i in head | foot:
        text = lines[i]["text"].strip()
        e, m, t, c = counts.get((lines[i]["rec"], lines[i]["no"]), (0, 0, False, 0))
        if not t and e < 3 and not m > 2 and not re.search(r"[.?!;,]$", text) and not text[:1].islower():
            f = running_form(text)
            if any(abs(len(f) - len(k)) <= 4 and SequenceMatcher(None, f, k, False).ratio() >= 0.85 for k in known):
                damaged.add(i)

    def edge_kind(i: int) -> str | None:
        x = lines[i]
        at_edge, mid, title, cuts = counts.get((x["rec"], x["no"]), (0, 0, False, 0))
        if x["hint"] == "table" or _CAPTION.match(x["text"]) or _CHAPTER.match(x["text"]):
            return None
        deep = (x["y0"] is not None and x["y0"] > 600 and x["alone"]) or (x["y1"] is not None and x["y1"] > 700 and x["last"])
        if is_number_line(x["text"]):
            plain = re.fullmatch(r"\s*\d+\s*", x["text"])
            beside = [lines[j]["text"] for j in (i - 1, i + 1) if 0 <= j < len(lines) and lines[j]["rec"] == x["rec"]]
            if plain and any(_NUMERIC.match(t) for t in beside) or at_edge < 0.3 * usual and not deep:
                return None  # a column of figures, or not the file's way of numbering
            if deep or at_edge >= 3 and (not plain or x["alone"] or not x["first"]) and (not plain or x["y0"] is None or x["y0"] < 60 or deep or not x["alone"]):
                return "number"
            return "number" if not plain and at_edge >= 2 else None
        if title or at_edge >= 3 and mid * 5 <= at_edge and (paged or cuts * 5 >= at_edge) or i in damaged:
            return "running"  # without pages a heading comes back at records' edges too, but never inside a sentence
        if paged and at_edge >= 2 and not mid and not re.search(r"[.?!;,]\s*$", x["text"]):
            return "running"
        if deep and x["alone"] and not _NUMERIC.match(x["text"]):
            return "running"
        return None

    start = 0
    for i in range(len(lines) + 1):
        if i == len(lines) or (i and lines[i]["page"] != lines[i - 1]["page"]):
            for j in range(start, i):  # from the top, as far as it goes on
                k = edge_kind(j) if j in head else None
                if not k:
                    break
                lines[j]["kind"] = k
            for j in range(i - 1, start - 1, -1):
                k = edge_kind(j) if j in foot else None
                if not k:
                    break
                lines[j]["kind"] = k
            start = i
    if lines and all(x["open_page"] for x in lines):
        for j, x in enumerate(lines):
            if (x["first"] or x["last"]) and (k := edge_kind(j)):
                x["kind"] = k
    for i, x in enumerate(lines):
        if x["kind"] == "prose":
            big = x["size"] == x["size"] and x["size"] is not None and x["size"] >= 13
            t = x["text"].strip()
            if big or (x["alone"] and len(t) < 40 and not re.search(r"[.?!;,\-¬\xad‐]$", t) and t[:1].isupper() and sum(counts.get((x["rec"], x["no"]), (0, 0))[:2]) >= 2):
                x["kind"] = "heading"


def paragraph_starts(lines: list[dict]) -> list[int]:
    """Indices of the prose lines that begin a paragraph: the cheapest cut of the stream into paragraphs."""
    n = len(lines)
    if not n:
        return []
    width = float(np.percentile([len(x["text"].rstrip()) for x in lines], 80))
    go_on = np.zeros(n)  # cost of no break before line i, over that of a break
    for i in range(1, n):
        a, b = lines[i - 1], lines[i]
        t, s = a["text"].rstrip(), b["text"].lstrip()
        ends = bool(re.search(r"[.?!:]['\"”)]*$", t))
        c = -1.0
        c += 1.5 if ends else -4.0
        c += 2.0 if len(t) < 0.75 * width and ends else 0.0
        c += 1.5 if a["rec"] != b["rec"] and not b.get("span") and ends and a["page"] == b["page"] else 0.0
        c += -4.0 if s[:1].islower() else 0.3
        c += 3.0 if b.get("after_break") and ends else 0.0
        c += -3.0 if t[-1:] in tuple(DIVIDERS) else 0.0
        go_on[i] = c
    # costs add up from line to line, so of all longer paragraphs that end here only the cheapest start is kept;
    # tenths as whole numbers, so that ties are exact and go to the later start
    cost = [round(10 * c) for c in go_on]
    best, back = [0] * (n + 1), [0] * (n + 1)
    longer, start = float("inf"), 0  # the best paragraph of two lines or more that ends before j
    for j in range(1, n + 1):
        if j > 1:
            two = best[j - 2]
            longer, start = (two, j - 2) if two <= longer else (longer, start)
            longer += cost[j - 1]
        one = best[j - 1] + (10 if len(lines[j - 1]["text"]) < 0.3 * width else 0)
        best[j], back[j] = (one, j - 1) if one <= longer else (longer, start)
    out, j = [], n
    while j > 0:
        out.append(back[j])
        j = back[j]
    return out[::-1]


def _stream(lines: list[dict]):
    """Tokens of the prose lines: (token, ends its line), and the line of each."""
    tokens, owner = [], []
    for x in lines:
        own = x["text"].split()
        for k, t in enumerate(own):
            tokens.append((t, k == len(own) - 1))
            owner.append(x)
    return tokens, owner


def find_defects(rows: pd.DataFrame, flags: pd.DataFrame, lex: Lexicon, kind: str) -> list[tuple[str, str, str]]:
    """(record, defect, word) of a window's core."""
    lines = to_lines(rows, kind)
    counts = {(r.rec, r.no): (r.n_edge, r.n_mid, r.title, r.n_cut) for r in flags.itertuples(index=False)}
    classify(lines, counts)
    out = []
    for x in lines:
        if x["core"] and x["kind"] in ("running", "number"):
            out.append((x["rec"], "running_line" if x["kind"] == "running" else "page_number", ""))
    tokens, owner = _stream([x for x in lines if x["kind"] == "prose"])
    for i, _, what, word in decode(tokens, lex):
        if owner[i]["core"]:
            if "hyphen" in what:
                out.append((owner[i]["rec"], "hyphen", word))
            if "misread" in what:
                out.append((owner[i]["rec"], "misread", word))
    return out


def repair_paragraphs(rows: pd.DataFrame, flags: pd.DataFrame, lex: Lexicon, kind: str) -> list[tuple[int, str, str]]:
    """(seq of the first line, first record, text) of the paragraphs that begin in a window's core."""
    lines = to_lines(rows, kind)
    counts = {(r.rec, r.no): (r.n_edge, r.n_mid, r.title, r.n_cut) for r in flags.itertuples(index=False)}
    classify(lines, counts)
    seq = dict(zip(rows["rec"], rows["seq"]))
    prose, after = [], False
    out = []
    for x in lines:
        if x["kind"] == "prose":
            prose.append(x | {"after_break": after, "span": kind == "spans"})
            after = False
        elif x["kind"] == "heading":
            after = True
            if x["core"]:
                out.append((int(seq[x["rec"]]), x["no"], x["rec"], x["text"].strip()))
    starts = paragraph_starts(prose)
    for a, b in zip(starts, [*starts[1:], len(prose)]):
        if not prose[a]["core"]:
            continue
        tokens, _ = _stream(prose[a:b])
        words = []
        for i, n, what, word in decode(tokens, lex):
            raw = "".join(tokens[k][0].rstrip(DIVIDERS) if k + 1 < i + n else tokens[k][0] for k in range(i, i + n))
            if what in ("misread", "hyphen", "hyphen+misread", "merge", "split", "resegmented"):
                lead = raw[: len(raw) - len(raw.lstrip("(\"“‘'["))]
                tail = raw[len(raw.rstrip(_TRIM.replace("!", "") if what.endswith("misread") else _TRIM)) :]
                body = word[0].upper() + word[1:] if raw[len(lead) : len(lead) + 1].isupper() else word
                words.append(lead + body + tail)
            else:
                words.append(raw)
        out.append((int(seq[prose[a]["rec"]]), prose[a]["no"], prose[a]["rec"], " ".join(words)))
    return out


# ---------------------------------------------------------------- over tables


def _alone(record: str):
    """A window's name for records without a number, so that a file of them is no single task; they have no order to lose."""
    return UNPLACED + F.pmod(F.xxhash64(record), F.lit(1 << 20))


def _windows(blocks: DataFrame, spans: DataFrame) -> DataFrame:
    """Records in windows with margins: (kind, file, win, core, rec, seq, page, y0, y1, hint, size, text)."""
    b = blocks.where("block_id is not null").dropDuplicates(["block_id"])
    b = b.select(
        F.lit("blocks").alias("kind"), F.coalesce("source_pdf", F.lit("")).alias("file"), F.col("block_id").alias("rec"), F.coalesce("block_no", F.lit(0)).cast("long").alias("seq"),
        F.col("page").cast("double").alias("page"), F.get("bbox", F.lit(1)).alias("y0"), F.get("bbox", F.lit(3)).alias("y1"), F.col("extractor_hint").alias("hint"), F.lit(None).cast("double").alias("size"), "text",
        F.coalesce(F.floor(F.col("block_no") / BLOCKS), _alone("block_id")).cast("long").alias("win"), F.coalesce(F.pmod("block_no", F.lit(BLOCKS)), F.lit(BLOCKS // 2)).cast("long").alias("off"),
        F.lit(BLOCKS).alias("span"), F.lit(BLOCK_MARGIN).alias("margin"),
    )
    s = spans.where("span_id is not null").dropDuplicates(["span_id"])
    page = F.coalesce("page", F.lit(0)).cast("long")
    s = s.select(
        F.lit("spans").alias("kind"), F.coalesce("source_pdf", F.lit("")).alias("file"), F.col("span_id").alias("rec"), (page * 1_000_000 + F.coalesce("span_no", F.lit(0))).alias("seq"),
        F.col("page").cast("double").alias("page"), F.get("bbox", F.lit(1)).alias("y0"), F.get("bbox", F.lit(3)).alias("y1"), F.lit(None).cast("string").alias("hint"), F.col("font_size").alias("size"), "text",
        F.coalesce(F.floor(F.col("page") / PAGES), UNPAGED + F.floor(F.col("span_no") / LINES), _alone("span_id")).cast("long").alias("win"),
        F.coalesce(F.pmod("page", F.lit(PAGES)), F.pmod("span_no", F.lit(LINES)), F.lit(LINES // 2)).cast("long").alias("off"),
        F.when(F.col("page").isNotNull(), PAGES).otherwise(LINES).alias("span"), F.when(F.col("page").isNotNull(), PAGE_MARGIN).otherwise(LINE_MARGIN).alias("margin"),
    )
    rows = b.unionByName(s)
    near = F.filter(
        F.array(
            F.struct(F.col("win").alias("win"), F.lit(True).alias("core")),
            F.when(F.col("off") < F.col("margin"), F.struct((F.col("win") - 1).alias("win"), F.lit(False).alias("core"))),
            F.when(F.col("off") >= F.col("span") - F.col("margin"), F.struct((F.col("win") + 1).alias("win"), F.lit(False).alias("core"))),
        ),
        lambda x: x.isNotNull() & (x["win"] >= 0),
    )
    return rows.withColumn("w", F.explode(near)).select("kind", "file", F.col("w.win").alias("win"), F.col("w.core").alias("core"), "rec", "seq", "page", "y0", "y1", "hint", "size", "text")


def _prepare(blocks: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Windows, and for their lines how often the form comes back at page edges and elsewhere in the file."""
    win = materialize(_windows(blocks, spans), "scan-windows")

    def forms(key, pdf):
        got = candidate_forms(pdf, key[0])
        got.insert(0, "kind", key[0])
        got.insert(1, "file", key[1])
        got.insert(2, "win", key[2])
        return got

    lines = materialize(win.groupBy("kind", "file", "win").applyInPandas(forms, "kind string, file string, win long, rec string, no int, form string, edge boolean, cut boolean"), "scan-forms")
    stats = lines.where("rec is not null").groupBy("kind", "file", "form").agg(F.count_if("edge").alias("n_edge"), F.count_if(~F.col("edge")).alias("n_mid"), F.count_if("cut").alias("n_cut"))
    titles = lines.where("rec is null").select("kind", "file", F.substring("form", 2, 1_000_000).alias("form"), F.lit(True).alias("title")).distinct()
    stats = stats.where("n_edge > 1 or n_mid > 1").join(titles, ["kind", "file", "form"], "full").na.fill({"n_edge": 0, "n_mid": 0, "n_cut": 0, "title": False})
    own = lines.where("rec is not null").join(stats, ["kind", "file", "form"])
    # a line put together from several forms takes the one most often at an edge
    own = own.groupBy("kind", "file", "rec", "no").agg(F.max(F.struct("n_edge", (-F.col("n_mid")).alias("m"), "n_cut")).alias("s"), F.max("title").alias("title"))
    own = own.select("kind", "file", "rec", "no", F.col("s.n_edge").alias("n_edge"), (-F.col("s.m")).alias("n_mid"), "title", F.col("s.n_cut").alias("n_cut"))
    # a window needs the flags of its margins as well
    near = win.select("kind", "file", "win", "rec").withColumnRenamed("win", "to")
    flags = own.join(near, ["kind", "file", "rec"]).select("kind", "file", F.col("to").alias("win"), "rec", "no", "n_edge", "n_mid", "title", "n_cut")
    return win, flags


def _words(lexicon: DataFrame, most: int = 2_000_000) -> list[str]:
    """The lexicon's words on the driver; a lexicon is a vocabulary, checked to be at most `most` words."""
    words = lexicon.where("word is not null").select(F.lower("word").alias("word")).distinct().limit(most + 1).collect()
    if len(words) > most:
        raise ValueError(f"the lexicon has more than {most} words")
    return sorted(r["word"] for r in words)


def scan_defects(blocks: DataFrame, spans: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(record_id, defect, word), distinct: divided and misread words, running lines and page numbers.

    Records are named by block_id or span_id; repeated deliveries count once, null
    ids are left out, null and empty texts have no lines. Pages that are null are
    told by the place going back to the top; without places, by records' own edges.
    """
    win, flags = _prepare(blocks, spans)
    words = win.sparkSession.sparkContext.broadcast(_words(lexicon))

    def run(key, left, right):
        lex = _lexicon(words)
        rows = find_defects(left, right, lex, key[0]) if len(left) else []
        return pd.DataFrame(rows, columns=["record_id", "defect", "word"])

    keys = ["kind", "file", "win"]
    return win.groupBy(*keys).cogroup(flags.groupBy(*keys)).applyInPandas(run, "record_id string, defect string, word string").distinct()


def scan_paragraphs(blocks: DataFrame, spans: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(kind, file, seq, line_no, record_id, text): headings and whole paragraphs of each file.

    In order of seq and line_no, repaired, without running lines, page numbers,
    captions and tables. kind tells the table a file was read from. Paragraphs go on
    across blocks and pages as far as a window's margin reaches.
    """
    win, flags = _prepare(blocks, spans)
    words = win.sparkSession.sparkContext.broadcast(_words(lexicon))

    def run(key, left, right):
        lex = _lexicon(words)
        rows = repair_paragraphs(left, right, lex, key[0]) if len(left) else []
        out = pd.DataFrame(rows, columns=["seq", "line_no", "record_id", "text"])
        out.insert(0, "kind", key[0])
        out.insert(1, "file", key[1])
        return out

    keys = ["kind", "file", "win"]
    return win.groupBy(*keys).cogroup(flags.groupBy(*keys)).applyInPandas(run, "kind string, file string, seq long, line_no int, record_id string, text string")


def _lexicon(words) -> Lexicon:
    """One lexicon for each Python worker and word list."""
    import sys
    import types

    held = sys.modules.setdefault("_loomspark_worker", types.ModuleType("_loomspark_worker"))
    name = hash(tuple(words.value))
    if getattr(held, "lexicon_of", None) != name:
        held.lexicon, held.lexicon_of = Lexicon(words.value), name
    return held.lexicon
