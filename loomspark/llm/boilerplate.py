"""Problem 3: lines and passages repeated across one source's documents.

Method: content-defined chunking. A document is one stream of normalised text; line
feeds are white space like any other. A gear rolling hash runs over it, and a piece
ends where the hash of the last WINDOW bytes has its low bits zero and no such place
came within LEAST bytes before, so where a piece ends depends on what is near and
not on what a document begins with. Distinct documents are counted per source and
piece; pieces in `min_docs` documents or more are hot, and runs of hot pieces are the
repeated passages, with line feeds or without.

A line is told by the pieces that lie in it: those cut by its own text alone. In a
line too short to hold a piece the whole line is one. A repeated line has hot pieces
only, so the lines of hot pieces are a complete list of candidates; an exact count
of their whole forms decides.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from loomspark.session import BROADCAST_ROWS, materialize
from loomspark.tables import once_per_id

#: Bytes the rolling hash looks back on; least distance of two places that may be cuts; one byte in MEAN is such a place.
WINDOW, LEAST, MEAN = 16, 8, 32
#: Parts that a hot key is spread over where keys are too many to broadcast.
SALTS = 16

_DIGITS = re.compile("[0-9]+")
_WORD = re.compile("[^ \t\n\r\xa0]+")


def normal_lines(text: str) -> list[str]:
    """The forms of a text's lines: lower case, digit runs `#`, white-space runs one space, stripped."""
    t = _DIGITS.sub("#", text.lower()).replace("\t", " ").replace("\r", " ").replace("\xa0", " ")
    while "  " in t:
        t = t.replace("  ", " ")
    return [x.strip(" ") for x in t.split("\n")]


def _gear() -> np.ndarray:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 2**32, size=256, dtype=np.uint32)


def cut_places(data: np.ndarray, start: np.ndarray, mean: int = MEAN) -> np.ndarray:
    """End offsets of the pieces of a byte array in which documents begin at `start`; every document's end is one."""
    g = _gear()[data]
    ends = np.append(start[1:], len(data))
    into = np.arange(len(data)) - np.repeat(start, ends - start)  # bytes since the document began: the window never looks before it
    h = np.zeros(len(data), dtype=np.uint32)
    for j in range(min(WINDOW, len(data))):
        part = g[: len(g) - j] << np.uint32(j)
        h[j:] += np.where(into[j:] >= j, part, 0).astype(np.uint32) if j else part
    mask = np.uint32((mean - 1) << 9)
    at = np.flatnonzero(((h & mask) == 0) & (into >= WINDOW - 1))
    near = np.zeros(len(at), dtype=bool)
    near[1:] = at[1:] - at[:-1] < LEAST  # two documents' places may be as near, but then the second stands under WINDOW
    return np.union1d(at[~near] + 1, ends[ends > start])


def _pack(batch: pa.RecordBatch, passages: bool):
    """A row for each document with text: its pieces (hash, line or -1, words from and to) and its lines (number, form)."""
    ids, sources, texts = (batch.column(i).to_pylist() for i in range(3))
    used, no, forms, owner = [], [], [], []
    for k, t in enumerate(texts):
        if t:
            own = [(i, f.encode("utf-8", "surrogatepass")) for i, f in enumerate(normal_lines(t)) if f]
            if own:
                no += [i for i, _ in own]
                forms += [f for _, f in own]
                owner += [len(used)] * len(own)
                used.append(k)
    if not forms:
        return None
    owner = np.asarray(owner)
    raw = b" ".join(forms) + b" "
    size = np.asarray([len(f) for f in forms], dtype=np.int64)
    line_end = np.cumsum(size + 1) - 1
    line_start = line_end - size
    first_line = np.searchsorted(owner, np.arange(len(used)))
    data = np.frombuffer(raw, dtype=np.uint8)
    ends = cut_places(data, line_start[first_line])
    starts = np.concatenate([[0], ends[:-1]])
    line = np.searchsorted(line_start, starts, side="right") - 1
    inside = (starts >= line_start[line] + WINDOW + LEAST) & (ends <= line_end[line])
    xx = xxhash.xxh3_64_intdigest
    keep = np.arange(len(ends)) if passages else np.flatnonzero(inside)
    a, b, of = starts[keep], ends[keep], np.where(inside[keep], line[keep], -1)
    doc = owner[line[keep]]
    h = np.fromiter((xx(raw[i:j]) for i, j in zip(a.tolist(), b.tolist())), dtype=np.uint64, count=len(a)).view(np.int64)
    short = np.setdiff1d(np.arange(len(forms)), of)  # lines that hold no piece
    own = np.fromiter((xx(b"\n" + forms[i]) for i in short.tolist()), dtype=np.uint64, count=len(short)).view(np.int64)
    if passages:  # words begun before a place, and ended by it, since the document's beginning
        space = np.cumsum(data == 32)
        begun = np.concatenate([[0], np.cumsum(np.concatenate([[True], data[:-1] == 32]))])
        base = begun[line_start[first_line]][doc]
        word_a, word_b = begun[a] - base, np.concatenate([[0], space])[np.minimum(b + 1, len(data))] - base
        word_b = np.where(data[np.minimum(b, len(data)) - 1] == 32, np.concatenate([[0], space])[b] - base, word_b)
    else:
        word_a = word_b = np.zeros(len(a), dtype=np.int64)
    minus = np.full(len(short), -1)
    h, of, doc = np.concatenate([h, own]), np.concatenate([of, short]), np.concatenate([doc, owner[short]])
    word_a, word_b = np.concatenate([word_a, minus]), np.concatenate([word_b, minus])
    order = np.argsort(doc, kind="stable")
    of = np.where(of < 0, -1, of - first_line[doc])
    piece_at = np.searchsorted(doc[order], np.arange(len(used) + 1)).astype(np.int32)
    line_at = np.append(first_line, len(forms)).astype(np.int32)
    lists = lambda at, values, kind: pa.ListArray.from_arrays(pa.array(at), pa.array(values, kind))
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[k] for k in used], pa.string()), pa.array([sources[k] for k in used], pa.string()),
            lists(piece_at, h[order], pa.int64()), lists(piece_at, of[order].astype(np.int32), pa.int32()), lists(piece_at, word_a[order].astype(np.int32), pa.int32()), lists(piece_at, word_b[order].astype(np.int32), pa.int32()),
            lists(line_at, np.asarray(no, dtype=np.int32), pa.int32()), lists(line_at, [xxhash.xxh3_128_digest(f) for f in forms], pa.binary()),
        ],
        names=["id", "source", "piece", "line", "a", "b", "no", "form"],
    )


def packed_pieces(docs: DataFrame, passages: bool = False) -> DataFrame:
    """(id, source, pieces, lines) of (id, source, text), a row a document; ids count once, null sources are one source.

    Without `passages` the pieces that cross a line's edge are left out.
    """

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                got = _pack(batch.slice(a, 1000), passages)
                if got is not None:
                    yield got

    one = once_per_id(docs.select("id", F.coalesce("source", F.lit("")).alias("source"), "text"))
    return one.mapInArrow(run, "id string, source string, piece array<long>, line array<int>, a array<int>, b array<int>, no array<int>, form array<binary>")


def _among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose `key` is among `keys` (one column, distinct): a broadcast of counted size, else a salted shuffle."""
    n = keys.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), key, "left_semi")
    salt = F.pmod(F.xxhash64(*[c for c in ("id",) if c in rows.columns], F.col(key)), F.lit(SALTS)).alias("_salt")
    spread = keys.select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    return rows.withColumn("_salt", salt).join(spread, [key, "_salt"], "left_semi").drop("_salt")


def _hot(packed: DataFrame, min_docs: int) -> DataFrame:
    """(key): pieces, hashed with their source, in `min_docs` documents or more; counted with map-side aggregation."""
    each = packed.select("source", F.explode(F.array_distinct("piece")).alias("p")).select(F.xxhash64("source", "p").alias("key"))
    return materialize(each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).select("key"), "hot-pieces")


def repeated_lines(docs: DataFrame, min_docs: int = 10) -> DataFrame:
    """(id, line_no) of every line whose form stands in `min_docs` or more documents of its source.

    Input (id, source, text): ids may repeat (one row of each is used), rows with
    a null id are left out, null sources form a source of their own, null and
    empty texts have no lines. Forms are compared by 128-bit hashes. Hot sources
    and hot notices are counted with map-side aggregation; no group is gathered.
    """
    packed = materialize(packed_pieces(docs), "pieces")
    each = packed.select("id", "source", "no", "form", F.explode(F.arrays_zip("piece", "line")).alias("p")).where("p.line >= 0")
    each = each.select("id", F.xxhash64("source", "p.piece").alias("key"), "source", F.col("p.line").alias("line"), F.get("no", F.col("p.line")).alias("line_no"), F.get("form", F.col("p.line")).alias("form"))
    size = packed.select("id", F.explode("line").alias("line")).where("line >= 0").groupBy("id", "line").agg(F.count("*").alias("n"))
    hot = _among(each, _hot(packed, min_docs), "key").groupBy("id", "line").agg(F.count("*").alias("k"), F.first(F.struct("source", "line_no", "form")).alias("l"))
    whole = hot.join(size, ["id", "line"]).where("k = n")
    lines = materialize(whole.select("id", "l.*").withColumn("key", F.xxhash64("source", "form")), "candidate-lines")
    once = lines.select("source", "form", "id").distinct()
    often = once.groupBy("source", "form").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)
    often = often.select(F.struct("source", "form").alias("name"))
    return _among(lines.select("id", "line_no", F.struct("source", "form").alias("name")), often, "name").select("id", "line_no")


def repeated_passages(docs: DataFrame, min_docs: int = 10, least_words: int = 6) -> DataFrame:
    """(id, first_word, end_word) of the runs of hot pieces of `least_words` whole words or more, wherever lines end.

    Words are counted from 0 over the whole text, white space being space, tab, LF,
    CR and U+00A0; input as in repeated_lines. The edges of a passage are those of
    its pieces, so that some words at either end may be left outside.
    """
    packed = materialize(packed_pieces(docs, passages=True), "passage-pieces")
    each = packed.select("id", "source", F.posexplode(F.arrays_zip("piece", "a", "b")).alias("at", "p")).where("p.a >= 0")
    each = each.select("id", "at", F.xxhash64("source", "p.piece").alias("key"), F.col("p.a").alias("a"), F.col("p.b").alias("b"))
    hot = _among(each, _hot(packed, min_docs), "key")
    runs = hot.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("id").orderBy("at")))
    got = runs.groupBy("id", "run").agg(F.min("a").alias("first_word"), F.max("b").alias("end_word"))
    return got.where(F.col("end_word") - F.col("first_word") >= least_words).select("id", "first_word", "end_word")


def without_lines(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """(id, text, lines_cut) of every document, without the lines (id, line_no) of `cut`; null texts stay null."""
    gone = cut.groupBy(F.col("id").alias("_cid")).agg(F.collect_set("line_no").alias("_gone"))
    one = once_per_id(docs.select("id", "text"))
    kept = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains("_gone", i))
    joined = one.join(gone, one["id"] == gone["_cid"], "left")
    return joined.select("id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("_gone"), F.lit(0)).alias("lines_cut"))


def without_passages(docs: DataFrame, cut: DataFrame) -> DataFrame:
    """(id, text, words_cut) of every document, without the passages (id, first_word, end_word) of `cut`; null texts stay null."""
    gone = cut.groupBy(F.col("id").alias("_cid")).agg(F.array_sort(F.collect_list(F.struct("first_word", "end_word"))).alias("_gone"))
    one = once_per_id(docs.select("id", "text"))
    joined = one.join(gone, one["id"] == gone["_cid"], "left").select("id", "text", F.col("_gone.first_word").alias("a"), F.col("_gone.end_word").alias("b"))

    def run(batches):
        for batch in batches:
            ids, texts, firsts, ends = (batch.column(i).to_pylist() for i in range(4))
            out, n = [], []
            for t, first, end in zip(texts, firsts, ends):
                if t and first:
                    spans, parts, at = [m.span() for m in _WORD.finditer(t)], [], 0
                    for a, b in zip(first, end):
                        parts.append(t[at : spans[a][0]])
                        at = spans[b - 1][1]
                    out.append("".join(parts) + t[at:])
                    n.append(sum(end) - sum(first))
                else:
                    out.append(t)
                    n.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["id", "text", "words_cut"])

    return joined.mapInArrow(run, "id string, text string, words_cut int")
