"""Problem 4: splitting oversized texts at natural boundaries, with overlap.

Method: agglomerative merging. A text starts as atomic segments (sentences and
lines; a sentence over the limit is halved evenly at words). Adjacent segments
stand in a heap by the strength of the boundary between them; the weakest
boundary is removed first while both segments, and the overlap they will carry,
fit the limit. What cannot be merged any further are the pieces.
"""

from __future__ import annotations

import heapq
import re

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from loomspark.functions.text import WS, find_all, word_count
from loomspark.session import materialize
from loomspark.tables import once_per_id

_WORD = re.compile("[^ \t\n\r\xa0]+")
_ENDS = re.compile("[.!?…。！？][\"'’”)\\]」]*$")

#: Strength of a boundary: none (inside a sentence), sentence, line, blank line.
INSIDE, SENTENCE, LINE, BLANK = range(4)


def boundary_strengths(text: str) -> tuple[list[tuple[int, int]], list[int]]:
    """Spans of the words, and the strength of the boundary after each word."""
    spans = [m.span() for m in _WORD.finditer(text)]
    strengths = []
    for (a, b), (c, _) in zip(spans, spans[1:]):
        feeds = text.count("\n", b, c)
        strengths.append(BLANK if feeds > 1 else LINE if feeds else SENTENCE if _ENDS.search(text[max(a, b - 6) : b]) else INSIDE)
    return spans, strengths


def piece_ranges(strengths: list[int], n: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges [a, b) that tile n words; piece k shown with up to `overlap` words before a stays within `limit`."""
    most = limit - overlap
    cuts = [i + 1 for i, s in enumerate(strengths) if s > INSIDE]
    start, end, left, right = [], [], [], []
    a = 0
    for b in [*cuts, n]:
        parts = -(-(b - a) // most)
        for k in range(parts):
            start.append(a + (b - a) * k // parts)
            end.append(a + (b - a) * (k + 1) // parts)
        a = b
    m = len(start)
    left, right = list(range(-1, m - 1)), [*range(1, m), -1]
    alive = [True] * m
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(i: int) -> None:
        j = right[i]
        if i >= 0 and j >= 0:
            size = end[j] - start[i]
            if size + min(overlap, start[i]) <= limit:
                heapq.heappush(heap, (strengths[end[i] - 1], size, i, start[i], end[j]))

    for i in range(m):
        offer(i)
    while heap:
        _, _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else -1
        if j < 0 or start[i] != a or end[j] != b:
            continue
        alive[j], end[i], right[i] = False, b, right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(i)
        if left[i] >= 0:
            offer(left[i])
    return [(start[i], end[i]) for i in range(m) if alive[i]]


def split_text(text: str, limit: int = 800, overlap: int = 40) -> list[str]:
    """Pieces of at most `limit` words; each starts with the last `overlap` words of the piece before.

    Pieces are slices of the text, so white space inside them is kept.
    """
    spans, strengths = boundary_strengths(text)
    if len(spans) <= limit:
        return [text]
    out, shown = [], 0
    for a, b in piece_ranges(strengths, len(spans), limit, overlap):
        first = max(shown, a - overlap) if out else 0
        out.append(text[spans[first][0] : spans[b - 1][1]])
        shown = first
    return out


def split_pieces(docs: DataFrame, limit: int = 800, overlap: int = 40) -> DataFrame:
    """(id, piece_no int, n_pieces int, text) of the texts of (id, text) with more than `limit` words.

    Ids count once; null ids, and null, empty and shorter texts, give no rows. The
    words are counted inside Spark; only oversized texts reach Python.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    long_enough = F.length("text") > 2 * limit  # more words than that need more characters
    one = once_per_id(docs.select("id", "text").where(long_enough))
    big = one.where(word_count(F.col("text")) > limit)

    def run(frames):
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["id"], pdf["text"]):
                got = split_text(t, limit, overlap)
                rows += [(i, k, len(got), x) for k, x in enumerate(got)]
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "text"])

    return big.mapInPandas(run, "id string, piece_no int, n_pieces int, text string")


def split_chunks(chunks: DataFrame, limit: int = 800, overlap: int = 40) -> DataFrame:
    """Every chunk within the limit: (id, source_id, piece_no, n_pieces, text, word_count, tokens_estimate, follows_chunk).

    A chunk that fits keeps its id and text; piece k of another is named
    `<id>#<k>`. word_count and tokens_estimate (floor of 1.3 times the words) are
    computed anew for all. follows_chunk leads to the piece before, and from a
    first piece to the last piece of the chunk it followed; a name that is not in
    the table stays as it is. Ids count once; null ids are left out; null texts
    stay null with 0 words.
    """
    pieces = materialize(split_pieces(chunks, limit, overlap), "split-pieces")
    cut = pieces.where("piece_no = 0").select(F.col("id").alias("cut_id"), F.col("n_pieces").alias("cut_n"))
    one = once_per_id(chunks.select("id", "text", "follows_chunk"))
    whole = one.join(cut, one["id"] == cut["cut_id"], "left_anti").select("id", F.lit(0).alias("piece_no"), F.lit(1).alias("n_pieces"), "text", "follows_chunk")
    # only the rows that were cut are looked up, before repeated deliveries are told apart
    links = chunks.select(F.col("id").alias("lid"), "follows_chunk").join(cut.select(F.col("cut_id").alias("lid")), "lid", "left_semi").dropDuplicates(["lid"])
    parts = pieces.join(links, pieces["id"] == links["lid"]).select("id", "piece_no", "n_pieces", "text", "follows_chunk")
    rows = whole.unionByName(parts)
    rows = rows.join(cut, rows["follows_chunk"] == cut["cut_id"], "left")
    name = F.when(F.col("n_pieces") > 1, F.concat_ws("#", "id", "piece_no")).otherwise(F.col("id"))
    before = F.when(F.col("piece_no") > 0, F.concat_ws("#", "id", F.col("piece_no") - 1)).when(F.col("cut_n").isNotNull(), F.concat_ws("#", "follows_chunk", F.col("cut_n") - 1)).otherwise(F.col("follows_chunk"))
    words = word_count(F.col("text")).cast("long")
    return rows.select(
        name.alias("id"), F.col("id").alias("source_id"), "piece_no", "n_pieces", "text", words.alias("word_count"),
        F.floor(words * 13 / 10).cast("long").alias("tokens_estimate"), before.alias("follows_chunk"),
    )


def piece_checks(pieces: DataFrame, limit: int = 800, overlap: int = 40) -> DataFrame:
    """(source_id, words, within, overlaps, linked) of each chunk of `split_chunks`.

    words without the overlaps; whether all pieces are within the limit, each begins
    with the last `overlap` words of the piece before and names it in follows_chunk.
    """
    w = Window.partitionBy("source_id").orderBy("piece_no")
    words = find_all(F.col("text"), f"[^{WS}]+")
    p = pieces.select("id", "source_id", "piece_no", "follows_chunk", F.size(words).alias("n"), F.slice(words, F.lit(1), F.lit(overlap)).alias("head"), F.when(F.size(words) > 0, F.slice(words, -F.least(F.size(words), F.lit(overlap)), F.lit(overlap))).otherwise(words).alias("tail"))
    p = p.withColumn("before", F.lag("tail").over(w)).withColumn("before_id", F.lag("id").over(w))
    later = F.col("piece_no") > 0
    return p.groupBy("source_id").agg(
        F.sum(F.col("n") - F.when(later, F.size("before")).otherwise(0)).alias("words"), F.bool_and(F.col("n") <= limit).alias("within"),
        F.bool_and(~later | F.coalesce(F.slice("head", F.lit(1), F.size("before")) == F.col("before"), F.lit(False))).alias("overlaps"), F.bool_and(~later | F.coalesce(F.col("follows_chunk") == F.col("before_id"), F.lit(False))).alias("linked"),
    )
