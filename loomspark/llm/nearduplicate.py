"""Problem 5: near-duplicate texts with small edits, over a whole collection.

Method: BK-trees over bit sketches, sharded. A text's sketch is the parity of its
shingles over cells (at least two a shingle, so long texts have longer ones, which
fold to shorter ones), so the Hamming distance of two sketches is never more
than the size of the sets' symmetric difference, and a similarity of t bounds
that by (1 - t) / (1 + t) (|A| + |B|): following only the edges within that
radius loses no pair. One tree over everything could neither be broadcast nor
prune, so there is a tree per shard. Shards come from signatures. A set's elements
in the order of their hashes make pairs of neighbours; an element that only one of
two sets has parts one such pair at most, so similar sets have most pairs in common,
and the rarest of a set's pairs, as many as `_signatures` gives, hold SAME common ones
at least. Texts of one trade or template share most single runs of words with
thousands of others, but hardly a pair of two unrelated runs: what is met by chance
is little, and two sets are compared only if they meet SAME times. Sets too small for
that (all sets, if t is at most 0.5) are told by single elements of their prefixes.
A signature with over `most` sets is cut into blocks and every pair of
blocks is a task of its own. What the trees return is checked on the whole sets.

The order uses frequencies of signatures over all texts, held in a table of counters that
grows with the data up to 32 M; what falls into a counter by chance (its mean load)
is taken off, and sums are kept as logarithms, so that they do not saturate. Any
order is correct, a better one makes sets meet less often by chance. What is hot is
counted exactly after that.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from loomspark.operators.components import connected_components
from loomspark.session import BROADCAST_ROWS, materialize
from loomspark.tables import once_per_id

#: Cells of the smallest and largest sketch.
LEAST_CELLS, MOST_CELLS = 512, 1 << 16
#: Counters of signatures' frequencies: the fewest and most; one for CHARS characters of text in between. They are sent as one byte each.
LEAST_BINS, MOST_BINS, CHARS = 1 << 22, 1 << 25, 128
BLOCK = 1 << 18  # counters in one row of the frequency table
#: Steps of the logarithm by which a sum of counters is kept: 8 to a doubling.
STEPS = 8
#: Signatures in common that are asked of two sets.
SAME = 3
#: Bytes of a signature and of a set's name in packed rows, and the name's bits that are left out. Names that fall together stand for either set.
PACKED, LEFT_OUT = 5, 24
#: Rows of sets that meet, packed at once.
MEETINGS = 2_000_000
#: Parts that members of one copied text are spread over.
SALTS = 16
_IN_WORD = re.compile(r"[^\W_]").match
_U = np.uint64


class _Blanks(dict):
    """Characters by code: those of words as they are, all others blanks."""

    def __missing__(self, c: int) -> int:
        new = self[c] = c if _IN_WORD(chr(c)) else 32
        return new


_BLANKS = _Blanks()


def _WORDS(text: str) -> list[str]:
    """The maximal runs of letters and digits."""
    return text.translate(_BLANKS).split()


class _WordHash(dict):
    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_sets(texts: list, k: int, words: _WordHash) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's runs of k consecutive words."""
    flat, edge = [], [0]
    get = words.__getitem__
    for t in texts:
        if t:
            flat.extend(map(get, _WORDS(t.lower())))
        edge.append(len(flat))
    w = np.array(flat, dtype=_U)
    n = max(0, len(w) - k + 1)
    h = np.zeros(n, dtype=_U)
    for j in range(k):
        h = _mix(h * _U(0x9E3779B97F4A7C15) + w[j : n + j] + _U(j + 1))
    return [_distinct(h[a : max(a, b - k + 1)]) for a, b in zip(edge, edge[1:])]


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    new = np.ones(len(h), dtype=bool)
    np.not_equal(h[1:], h[:-1], out=new[1:])
    return h[new]


def sketch(s: np.ndarray, cells: int | None = None) -> bytes:
    """Parity of a set over `cells` cells, by default a power of two of at least twice its size."""
    if cells is None:
        cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits(np.bincount((s >> _U(20)).astype(np.int64) % cells, minlength=cells).astype(np.uint8) & 1).tobytes()


def fold_bits(bits: int, cells: int) -> int:
    """A sketch of `cells` cells as the one of half as many."""
    half = cells // 2
    return (bits >> half) ^ (bits & ((1 << half) - 1))


def set_key(s: np.ndarray) -> int:
    """64-bit name of a set; equal sets are one class."""
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), dtype=_U).view(np.int64))


class BKTree:
    """Sketches by Hamming distance: a node's children are keyed by their distance to it."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, dict[int, int]]] = []

    def add(self, bits: int, item: int) -> None:
        if not self.nodes:
            self.nodes.append((bits, item, {}))
            return
        at = 0
        while True:
            own, _, children = self.nodes[at]
            d = (own ^ bits).bit_count()
            nxt = children.get(d)
            if nxt is None:
                children[d] = len(self.nodes)
                self.nodes.append((bits, item, {}))
                return
            at = nxt

    def within(self, bits: int, radius: int) -> list[tuple[int, int]]:
        """(item, distance) of every node within the radius; only edges that can lead there are followed."""
        out, todo = [], [0] if self.nodes else []
        while todo:
            own, item, children = self.nodes[todo.pop()]
            d = (own ^ bits).bit_count()
            if d <= radius:
                out.append((item, d))
            if children:
                todo += [c for e, c in children.items() if d - radius <= e <= d + radius]
        return out


def _singles(t: float) -> float:
    """The size up to which two similar sets need not have SAME pairs of neighbours in common."""
    return math.ceil((SAME + 1) * (1 + t) / (2 * (2 * t - 1)) - 1e-9) - 1 if t > 0.5 else math.inf


def _signatures(sets: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures, the row of each (two rows a set: pairs of neighbours, then single elements), and how many a row needs.

    Of sets of n and m elements with similarity t at least, o = t / (1 + t) (n + m)
    are common and n + m - 2 o are not; of the n - 1 pairs of neighbours of one, each
    of the latter parts one common pair at most, so c = 3 o - (n + m) - 1 or more are
    common. In any order of all pairs, the first n - 1 - c + SAME of one set and the
    first m - 1 - c + SAME of the other have SAME in common. c is least for the
    smallest m. Sets that may be similar to one of `_singles` elements or fewer have
    single elements besides: n - t n + 1 of them. Pairs are odd, elements even.
    """
    least = _singles(t)
    size = np.array([len(s) for s in sets])
    every, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    near = (doc[1:] == doc[:-1]) & (size > least)[doc[1:]]
    pairs = _mix(every[:-1][near] * _U(0x9E3779B97F4A7C15) + every[1:][near]) | _U(1)
    alone = (size * t <= least + 1e-9)[doc]
    other = np.maximum(np.ceil(t * size - 1e-9), least + 1)
    share = np.ceil((2 * t - 1) / (1 + t) * (size + other) - 1 - 1e-9) if t > 0.5 else size
    need = np.stack([np.clip(size - 1 - share + SAME, 0, size), size - np.ceil(t * size - 1e-9) + 1], axis=1).astype(np.int64)
    return np.concatenate([pairs, _mix(every[alone]) & ~_U(1)]), np.concatenate([2 * doc[1:][near], 2 * doc[alone] + 1]), need.ravel()


def _cells(signatures: np.ndarray, bins: int) -> np.ndarray:
    return ((signatures >> _U(1)) & _U(bins - 1)).astype(np.int64)


def _sets_stage(texts: DataFrame, k: int, bins: int = LEAST_BINS, t: float = 0.8):
    """One pass: a row per text with a non-empty set, and rows of partial counters (id null)."""

    def run(batches):
        words, counts = _WordHash(), np.zeros(bins, dtype=np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(ids), 1000):
                sets = shingle_sets(texts[a : a + 1000], k, words)
                use = [(i, s) for i, s in zip(ids[a : a + 1000], sets) if len(s)]
                if not use:
                    continue
                np.add.at(counts, _cells(_signatures([s for _, s in use], t)[0], bins), np.uint32(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in use], pa.string()), pa.array([set_key(s) for _, s in use], pa.int64()), pa.array([len(s) for _, s in use], pa.int64()), pa.array([sketch(s) for _, s in use], pa.binary())],
                    names=["id", "key", "size", "bits"],
                )
        for b in range(0, bins, BLOCK):
            part = counts[b : b + BLOCK]
            if part.any():
                raw = _narrow(part)
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([b], pa.int64()), pa.array([int(part.sum())], pa.int64()), pa.array([raw], pa.binary())], names=["id", "key", "size", "bits"])

    return texts.mapInArrow(run, "id string, key long, size long, bits binary")


def _sum_blocks(rows: DataFrame, bins: int = LEAST_BINS) -> np.ndarray:
    """log2 of the counters of all tasks added up, less their mean, in STEPS to a doubling; the driver receives `bins` bytes at most."""
    freq = np.zeros(bins, dtype=np.uint8)
    total = rows.agg(F.sum("size")).first()[0] or 0  # a row of counters holds their sum
    mean = total / bins
    # salted, so that no task reads the counters of all the others
    salted = rows.select("key", "bits", F.pmod(F.xxhash64("bits"), F.lit(16)).alias("salt"))
    part = salted.groupBy("key", "salt").applyInPandas(_plain_sum, "key long, bits binary")

    def logs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.maximum(_added(pdf["bits"]) - mean, 0)
        return pd.DataFrame({"key": [key[0]], "bits": [zlib.compress(np.minimum(np.ceil(np.log2(n + 1) * STEPS), 255).astype(np.uint8).tobytes(), 1)]})

    for r in part.groupBy("key").applyInPandas(logs, "key long, bits binary").toLocalIterator():
        freq[r["key"] : r["key"] + BLOCK] = np.frombuffer(zlib.decompress(r["bits"]), dtype=np.uint8)
    return freq


def _narrow(counts: np.ndarray) -> bytes:
    """Counters in as few bytes as hold the largest."""
    return zlib.compress(counts.astype(np.min_scalar_type(int(counts.max()))).tobytes(), 1)


def _added(parts) -> np.ndarray:
    total = np.zeros(BLOCK, dtype=np.int64)
    for raw in map(zlib.decompress, parts):
        total += np.frombuffer(raw, dtype=f"u{len(raw) // BLOCK}").astype(np.int64)
    return total


def _plain_sum(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"key": [key[0]], "bits": [_narrow(_added(pdf["bits"]))]})


def _low(x: np.ndarray) -> bytes:
    """The low PACKED bytes of 64-bit numbers."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def _read_low(raw: list[bytes]) -> np.ndarray:
    low = np.frombuffer(b"".join(raw), dtype=np.uint8).reshape(-1, PACKED)
    wide = np.zeros((len(low), 8), dtype=np.uint8)
    wide[:, :PACKED] = low
    return wide.view(np.int64)[:, 0]


def _by_part(part: np.ndarray):
    """(part, its rows) of every part."""
    order = np.argsort(part, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
        yield int(part[own[0]]), own


def _prefix_stage(texts: DataFrame, k: int, t: float, freq, most: int, parts: int):
    """The signatures that distinct sets need, rarest first, packed by the part that a signature belongs to.

    A row holds a batch's signatures of one part, and the name and size of the set
    of each, so that the bytes of a signature do not depend on the number of parts.
    A signature that may have more than `most` members goes to as many parts as it may
    have times `most`, by its sets, and is told apart by `hot`.
    """
    limit = math.floor(math.log2(most + 1) * STEPS)

    def run(batches):
        words, table, seen = _WordHash(), freq.value, set()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            kept = []
            for a in range(0, len(texts), 1000):
                sets, keys = [], []
                for s in shingle_sets(texts[a : a + 1000], k, words):
                    if not len(s):
                        continue
                    key = set_key(s)
                    if key not in seen:
                        seen.add(key)
                        sets.append(s)
                        keys.append(key)
                if not sets:
                    continue
                sig, row, need = _signatures(sets, t)
                level = table[_cells(sig, len(table))]
                # rows of 1,000 sets, levels and the greater part of the signatures in one number
                order = np.argsort((row.astype(_U) << _U(53)) | (level.astype(_U) << _U(45)) | (sig >> _U(19)))
                start = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(need)))[:-1]])
                first = order[np.arange(len(order)) - start[row[order]] < need[row[order]]]
                doc = row[first] // 2
                kept.append((sig[first], level[first], np.array(keys, dtype=np.int64).view(_U)[doc], np.minimum([len(s) for s in sets], 0xFFFF).astype(np.uint16)[doc]))
            if not kept:
                continue
            sig, level, key, size = (np.concatenate(x) for x in zip(*kept))
            above = np.maximum(level.astype(np.int64) - limit, 0)
            wide = np.exp2(np.ceil(above / STEPS)).astype(_U)  # how many times `most` it may have
            spread = _mix(sig + _U(7)) + np.where(above > 0, _mix(key) % wide, _U(0))
            rows = [(p // 2, bool(p % 2), _low(sig[own]), _low(key[own] >> _U(LEFT_OUT)), size[own].tobytes()) for p, own in _by_part((spread % _U(parts)).astype(np.int64) * 2 + (above > 0))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), *[pa.binary()] * 3))], names=["part", "hot", "token", "name", "sizes"])

    return texts.mapInArrow(run, "part int, hot boolean, token binary, name binary, sizes binary")


def _meetings(t: float, parts: int):
    """Of one part: every two sets with a signature in common that their sizes allow to be similar.

    Rows (part, a, b, sure): packed names; sure if one signature is enough. Hot
    signatures' members are passed on as (token, name of one).
    """

    def packed(a, b, sure):
        part = (_mix(a.view(_U) * _U(0x9E3779B97F4A7C15) + b.view(_U)) % _U(parts)).astype(np.int64) * 2 + sure
        rows = [(p // 2, bool(p % 2), _low(a[own]), _low(b[own])) for p, own in _by_part(part)]
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.binary(), pa.binary()))), none, none], names=["part", "sure", "a", "b", "token", "name"])

    def run(batches):
        cool, warm = [], []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            for hot, *rest in zip(*cols[1:]):
                (warm if hot else cool).append(rest)
        if warm:
            tok, name = (_read_low([r[i] for r in warm]) for i in (0, 1))
            for a in range(0, len(tok), 50_000):
                n = len(tok[a : a + 50_000])
                yield pa.RecordBatch.from_arrays([*(pa.nulls(n, kind) for kind in (pa.int32(), pa.bool_(), pa.binary(), pa.binary())), pa.array(tok[a : a + n]), pa.array(name[a : a + n])], names=["part", "sure", "a", "b", "token", "name"])
        if not cool:
            return
        tok, name = (_read_low([r[i] for r in cool]) for i in (0, 1))
        size = np.frombuffer(b"".join(r[2] for r in cool), dtype=np.uint16)
        del cool
        order = np.lexsort((name, (tok << 16) | size))
        tok, name, size = tok[order], name[order], size[order].astype(np.float64)
        new = np.concatenate([[True], (tok[1:] != tok[:-1]) | (name[1:] != name[:-1]) | (size[1:] != size[:-1])])
        tok, name, size = tok[new], name[new], size[new]
        met, n, step, at = [], 0, 1, np.arange(len(tok))
        while len(at):
            at = at[at + step < len(tok)]
            at = at[(tok[at] == tok[at + step]) & (size[at] >= t * size[at + step] - 1e-9)]  # sizes ascend
            for a in range(0, len(at), MEETINGS):
                own = at[a : a + MEETINGS]
                x, y = name[own], name[own + step]
                met.append((np.minimum(x, y), np.maximum(x, y), tok[own] % 2 == 0))
                n += len(own)
                if n >= MEETINGS:
                    yield packed(*(np.concatenate(v) for v in zip(*met)))
                    met, n = [], 0
            step += 1
        if n:
            yield packed(*(np.concatenate(v) for v in zip(*met)))

    return run


def _met(batches):
    """Of one part of meetings: (na, nb), the names of two sets that met SAME times, or surely."""
    rows = []
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        rows += zip(*cols[1:4])
    if not rows:
        return
    a, b = (_read_low([r[i] for r in rows]) for i in (1, 2))
    times = np.repeat([SAME if r[0] else 1 for r in rows], [len(r[1]) // PACKED for r in rows])
    order = np.lexsort((b, a))
    a, b, times = a[order], b[order], times[order]
    start = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    start = start[(np.add.reduceat(times, start) >= SAME) & (a[start] != b[start])]
    for i in range(0, len(start), 50_000):
        own = start[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(a[own]), pa.array(b[own])], names=["na", "nb"])


def _search(t: float):
    """Each shard's tree of side 0 (or of all), asked by side 1 (or by all): (ka, kb), ka < kb."""
    folds = max(1, math.ceil(math.log2(1 / t) - 1e-9))

    def run(batches):
        current = None

        def solve(rows):
            """Trees by times folded and number of cells: similar sets' sizes differ by a factor of 1/t, their cells by its next power of two, at most."""
            sides = {r[4] for r in rows}
            one = len(sides) == 1
            info, trees, out = {}, {}, []
            for _, key, size, raw, side in rows:
                if one or side == 0:
                    bits, cells = int.from_bytes(raw), 8 * len(raw)
                    info[key] = size
                    for level in range(folds + 1):
                        trees.setdefault((level, cells), BKTree()).add(bits, key)
                        bits, cells = fold_bits(bits, cells), cells // 2
            for _, key, n, raw, side in rows:
                if not one and side == 0:
                    continue
                bits, cells = int.from_bytes(raw), 8 * len(raw)
                far = math.floor(n * (1 - t) / t + 1e-9)
                asked = [(trees.get((level, cells)), bits) for level in range(folds + 1)]
                for _ in range(folds):
                    bits, cells = fold_bits(bits, cells), cells // 2
                    asked.append((trees.get((0, cells)), bits))
                for tree, own in asked:
                    for other, d in tree.within(own, far) if tree else ():
                        m = info[other]
                        if key != other and (key < other or not one) and d <= (1 - t) / (1 + t) * (n + m) + 1e-9 and min(n, m) >= t * max(n, m) - 1e-9:
                            out.append((min(key, other), max(key, other)))
            return out

        def emit(out):
            out = sorted(set(out))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["ka", "kb"])

        rows, found = [], []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if r[0] != current:
                    if rows:
                        found += solve(rows)
                    rows, current = [], r[0]
                    if len(found) > 50_000:
                        yield emit(found)
                        found = []
                rows.append(r)
        if rows:
            found += solve(rows)
        if found:
            yield emit(found)

    return run


def candidate_pairs(texts: DataFrame, docs: DataFrame, freq, k: int, t: float, most: int = 2000, rows_per_task: int = 2_500_000) -> DataFrame:
    """(ka, kb) of set keys that have signatures in common and lie within the radius of each other's sketch."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.floor(F.col("size") * (2 - 2 * t if t > 0.5 else 1 - t)) + 2)).first()[0] or 0
    n = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // rows_per_task)))
    sets = docs.withColumn("name", F.shiftrightunsigned("key", LEFT_OUT))
    packed = _prefix_stage(texts.select("text"), k, t, freq, most, n).repartitionById(n, F.col("part"))
    found = materialize(packed.mapInArrow(_meetings(t, n), "part int, sure boolean, a binary, b binary, token long, name long"), "meetings")
    met = materialize(found.where("token is null").select("part", "sure", "a", "b").repartitionById(n, F.col("part")).mapInArrow(_met, "na long, nb long"), "met")
    hot = found.where("token is not null").select("token", "name").distinct()
    sizes = hot.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    small, large = sizes.where(F.col("n") <= most).select("token"), sizes.where(F.col("n") > most).select("token")
    warm = hot.join(small, "token", "left_semi").groupBy("token").agg(F.array_sort(F.collect_list("name")).alias("members"))
    warm = warm.select(F.xxhash64("members").alias("shard"), "members").dropDuplicates(["shard"]).select("shard", F.explode("members").alias("name"), F.lit(0).alias("side"))
    # sets that met: a shard for each that is the first of two, asked by the others
    whole = warm.unionByName(met.select(F.col("na").alias("shard"), F.col("na").alias("name"), F.lit(0).alias("side")).distinct())
    whole = whole.unionByName(met.select(F.col("na").alias("shard"), F.col("nb").alias("name"), F.lit(1).alias("side")))
    # a token with more members: by bands of size (similar sets stand in one band or in two neighbouring ones), each
    # band in blocks by hash, and every pair of blocks of a band, or of neighbouring bands, a shard
    band = F.floor(F.log("size") / (math.log(1 / t) * 1.000001)).cast("int") if t < 1 else F.col("size").cast("int")
    of_size = sets.select("name", band.alias("band")).distinct()
    placed_hot = materialize(hot.join(large, "token", "left_semi").join(of_size, "name"), "hot-members")
    blocks = placed_hot.groupBy("token", "band").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks"))
    own = placed_hot.join(blocks, ["token", "band"]).withColumn("own", F.pmod(F.xxhash64("name", "token"), F.col("blocks")).cast("int"))
    near = blocks.select("token", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above")).join(blocks.select("token", "band"), ["token", "band"], "right").na.fill({"above": 0})
    below = blocks.select("token", (F.col("band") + 1).alias("band"), F.col("blocks").alias("under")).join(blocks.select("token", "band"), ["token", "band"], "right").na.fill({"under": 0})
    own = own.join(near, ["token", "band"]).join(below, ["token", "band"])
    none = F.array().cast("array<struct<name:long,side:int>>")
    inside = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.xxhash64("token", "band", F.least("own", j), F.greatest("own", j)).alias("name"), F.when(F.col("own") > j, 1).otherwise(0).alias("side")))
    up = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda j: F.struct(F.xxhash64("token", "band", F.col("own"), j, F.lit("up")).alias("name"), F.lit(0).alias("side")))).otherwise(none)
    down = F.when(F.col("under") > 0, F.transform(F.sequence(F.lit(0), F.col("under") - 1), lambda j: F.struct(F.xxhash64("token", F.col("band") - 1, j, F.col("own"), F.lit("up")).alias("name"), F.lit(1).alias("side")))).otherwise(none)
    pairs = own.select("name", F.explode(F.concat(inside, up, down)).alias("s")).select(F.col("s.name").alias("shard"), "name", F.col("s.side").alias("side"))
    whole = materialize(whole.unionByName(pairs), "shards")
    asked = whole.select("name").distinct()
    side = F.broadcast(asked) if asked.count() <= BROADCAST_ROWS else asked
    info = sets.join(side, "name", "left_semi").groupBy("name", "key").agg(F.first("size").alias("size"), F.first("bits").alias("bits"))
    members = whole.join(info, "name").select("shard", "key", "size", "bits", "side")
    placed = members.repartition(n, "shard").sortWithinPartitions("shard", "key")
    return placed.mapInArrow(_search(t), "ka long, kb long").distinct()


def near_duplicate_classes(texts: DataFrame, k: int = 5, t: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Members and links: ((id, key) of every text, (ka, kb, similarity) of every pair of different sets).

    Texts with the same set of k-word runs form one class, named by key. Input
    (id, text): ids count once, null ids and texts without a run of k words are
    left out. Every pair of sets with similarity `t` or more is in the links.
    """
    texts = once_per_id(texts.select("id", "text")).where("text is not null")
    if not 0 < t <= 1:
        raise ValueError("the similarity must be over 0 and at most 1")
    chars = texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    bins = min(MOST_BINS, max(LEAST_BINS, 1 << (int(chars) // CHARS).bit_length()))
    stage = materialize(_sets_stage(texts, k, bins, t), "sets")
    docs = stage.where("id is not null")
    freq = docs.sparkSession.sparkContext.broadcast(_sum_blocks(stage.where("id is null"), bins))
    cand = materialize(candidate_pairs(texts, docs, freq, k, t), "candidates")
    wanted = cand.select(F.col("ka").alias("key")).union(cand.select("kb")).distinct()
    reps = materialize(docs.join(wanted, "key", "left_semi").groupBy("key").agg(F.min("id").alias("rep")), "representatives")
    n = reps.count()
    side = F.broadcast(reps) if n <= BROADCAST_ROWS else reps

    def full(batches):
        words = _WordHash()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a in range(0, len(keys), 1000):
                sets = shingle_sets(texts[a : a + 1000], k, words)
                yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 1000], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["key", "raw"])

    chosen = texts.join(side, texts["id"] == side["rep"]).select("key", "text")
    sets = materialize(chosen.mapInArrow(full, "key long, raw binary"), "full-sets")
    a, b = sets.select(F.col("key").alias("ka"), F.col("raw").alias("ra")), sets.select(F.col("key").alias("kb"), F.col("raw").alias("rb"))

    def check(batches):
        for batch in batches:
            ka, kb, ra, rb = (batch.column(i).to_pylist() for i in range(4))
            out = []
            for x, y, p, q in zip(ka, kb, ra, rb):
                p, q = np.frombuffer(p, dtype=_U), np.frombuffer(q, dtype=_U)
                both = len(np.intersect1d(p, q, assume_unique=True))
                j = both / (len(p) + len(q) - both)
                if j >= t:
                    out.append((x, y, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out]) for i in range(3)], names=["ka", "kb", "similarity"])

    links = cand.join(a, "ka").join(b, "kb").select("ka", "kb", "ra", "rb").mapInArrow(check, "ka long, kb long, similarity double")
    return docs.select("id", "key"), materialize(links, "links")


def near_duplicate_pairs(texts: DataFrame, k: int = 5, t: float = 0.8) -> DataFrame:
    """(id_a, id_b), id_a < id_b, of every pair of texts with similarity `t` or more, copies included."""
    members, links = near_duplicate_classes(texts, k, t)
    a, b = members.select(F.col("id").alias("x"), F.col("key").alias("ka")), members.select(F.col("id").alias("y"), F.col("key").alias("kb"))
    across = links.join(a, "ka").join(b, "kb").select("x", "y")
    several = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    copies = members.join(several, "key", "left_semi")
    # members of a text copied many times are spread over tasks: one side by a hash of the id, the other repeated for each
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    inside = copies.select(F.col("id").alias("x"), "key", salt).join(copies.select(F.col("id").alias("y"), "key", spread), ["key", "salt"]).where("x < y").select("x", "y")
    return across.unionByName(inside).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def near_duplicate_groups(texts: DataFrame, k: int = 5, t: float = 0.8) -> DataFrame:
    """(id, group_id, copies, links): one row per text; copies of one set are not expanded into pairs.

    group_id is the least id of the group connected by links and copies; copies the
    number of texts with the same set, links the number of other sets linked to it.
    """
    members, links = near_duplicate_classes(texts, k, t)
    comp = connected_components(links, "ka", "kb")
    degree = links.select(F.col("ka").alias("key")).union(links.select("kb")).groupBy("key").agg(F.count("*").alias("links"))
    classes = members.groupBy("key").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    classes = classes.join(comp, classes["key"] == comp["node"], "left").join(degree, "key", "left")
    classes = classes.select("key", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "key").alias("component"))
    name = classes.groupBy("component").agg(F.min("least").alias("group_id"))
    return members.join(classes.join(name, "component"), "key").select("id", "group_id", "copies", "links")
