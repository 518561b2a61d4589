"""Problem 7: token ids of a whole corpus by a public byte-level BPE vocabulary.

Method: two tiers. A minimal perfect hash over the vocabulary resolves every
pre-token that is one entry of it; the others are merged by a heap of candidate
pairs over a linked list of bytes. Each distinct pre-token of an Arrow batch is
resolved once and its ids are spread over the batch with array indexing.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

#: Folder of the public tokenizers' files; a parameter of every operator here.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pre-token pattern of the 50k byte-level BPE.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The same pattern for texts of ASCII alone, where the standard library's engine is twice as fast.
ASCII_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\x0b\x0c\r A-Za-z0-9]+|[\t\n\x0b\x0c\r ]+(?![^\t\n\x0b\x0c\r ])|[\t\n\x0b\x0c\r ]+"


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id from a `.tiktoken` file (base64 token, space, rank)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one probe.

    Keys fall into buckets; each bucket has the displacement under which its keys
    meet free slots (large buckets choose first, single keys take what is left).
    A probe is confirmed against the key itself, so strangers are never accepted.
    """

    def __init__(self, ranks: dict[bytes, int], per_bucket: int = 4):
        keys = list(ranks)
        self.n = n = len(keys)
        self.n_buckets = max(1, n // per_bucket)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        bucket = (h % np.uint64(self.n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.n_buckets + 1))
        sizes = np.diff(edges)
        taken = np.zeros(n, dtype=bool)
        self.shift = np.zeros(self.n_buckets, dtype=np.int64)
        slot_of = np.zeros(n, dtype=np.int64)
        tries = np.arange(256, dtype=np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if sizes[b] < 2:
                break
            own = order[edges[b] : edges[b + 1]]
            base = 0
            while True:
                at = self._slot(h[own][None, :], (base + tries)[:, None])
                ok = ~taken[at].any(axis=1)
                if at.shape[1] > 1:
                    s = np.sort(at, axis=1)
                    ok &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if ok.any():
                    k = int(np.argmax(ok))
                    break
                base += len(tries)
                if base > 1000 * n:
                    raise ValueError("no displacement: two keys share their hash")
            self.shift[b] = base + k
            slot_of[own] = at[k]
            taken[at[k]] = True
        free = iter(np.flatnonzero(~taken))
        for b in np.flatnonzero(sizes == 1):
            own = order[edges[b]]
            slot_of[own] = next(free)
            self.shift[b] = -1 - slot_of[own]
        self.keys: list[bytes] = [b""] * n
        self.ids = np.zeros(n, dtype=np.int64)
        for k, s in zip(keys, slot_of):
            self.keys[s] = k
            self.ids[s] = ranks[k]

    def _slot(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = h ^ ((shift.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, tokens: list[bytes]) -> np.ndarray:
        """The id of each token, -1 where it is no key."""
        if not tokens or not self.n:
            return np.full(len(tokens), -1, dtype=np.int64)
        h = np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], dtype=np.uint64)
        d = self.shift[(h % np.uint64(self.n_buckets)).astype(np.int64)]
        slot = np.where(d < 0, -1 - d, self._slot(h, np.maximum(d, 0)))
        out = self.ids[slot]
        keys = self.keys
        same = np.fromiter((keys[s] == t for s, t in zip(slot.tolist(), tokens)), dtype=bool, count=len(tokens))
        return np.where(same, out, -1)


def merge_bytes(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the lowest-ranked adjacent pair is joined until none is left.

    Symbols are spans in a linked list; the heap holds (rank, left, end), and an
    entry is stale once its left symbol is gone or no longer ends where it did.
    """
    n = len(token)
    after = list(range(1, n + 1))  # start of the next symbol
    before = list(range(-1, n - 1))
    alive = [True] * n
    heap = []
    for i in range(n - 1):
        r = ranks.get(token[i : i + 2])
        if r is not None:
            heap.append((r, i, i + 2))
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or after[j] != end:
            continue
        alive[j] = False
        after[i] = end
        if end < n:
            before[end] = i
            r = ranks.get(token[i : after[end]])
            if r is not None:
                heapq.heappush(heap, (r, i, after[end]))
        p = before[i]
        if p >= 0:
            r = ranks.get(token[p:end])
            if r is not None:
                heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Pre-tokens by pattern, then the two tiers; `encode` takes a list of texts or None."""

    def __init__(self, ranks: dict[bytes, int], table: PerfectHash, memory: int = 400_000):
        self.ranks, self.table = ranks, table
        self.find = regex.compile(PATTERN).findall
        self.find_ascii = re.compile(ASCII_PATTERN).findall
        self.known: dict[str, int] = {}
        self.memory = memory
        self._reset()

    def _reset(self) -> None:
        self.known = {}
        self.starts, self.flat = [0], []

    def _resolve(self, new: list[str]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        for t, b, i in zip(new, raw, self.table.lookup(raw).tolist()):
            self.known[t] = len(self.starts) - 1
            if i >= 0:
                self.flat.append(i)
            else:
                self.flat.extend(merge_bytes(b, self.ranks))
            self.starts.append(len(self.flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text k has ids[offsets[k]:offsets[k + 1]]."""
        if len(self.known) > self.memory:
            self._reset()
        tokens, counts = [], np.zeros(len(texts), dtype=np.int64)
        for k, t in enumerate(texts):
            if t:
                got = self.find_ascii(t) if t.isascii() else self.find(t)
                counts[k] = len(got)
                tokens += got
        new = set(tokens).difference(self.known)
        if new:
            self._resolve(sorted(new))
        at = np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        starts, flat = np.asarray(self.starts, dtype=np.int64), np.asarray(self.flat, dtype=np.int32)
        size = starts[at + 1] - starts[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total, dtype=np.int64) - np.repeat(ends - size, size) + np.repeat(starts[at], size)
        edges = np.concatenate([[0], np.cumsum(counts)])
        offsets = np.concatenate([[0], ends])[edges]
        return offsets, flat[where]


def _slices(texts: list, most: int = 4_000_000):
    """Index ranges of about `most` characters, so that long texts don't pile up in memory."""
    a = n = 0
    for b, t in enumerate(texts):
        n += len(t) if t else 0
        if n >= most:
            yield a, b + 1
            a, n = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizers: str = TOKENIZERS,
                  vocabulary: str = "byte_bpe_50k.tiktoken", counts_only: bool = False) -> DataFrame:
    """(id, ids array<int>) of every row, or (id, n_tokens int) with `counts_only`.

    A narrow map: no shuffle, one output row per input row, other columns unread.
    Null and empty texts give an empty list (0 tokens); a null id stays null;
    repeated ids give repeated rows; an empty table gives an empty result. Whole
    texts are encoded whatever their length. Special tokens' strings are plain text.
    The vocabulary and its hash (under 4 MB, fixed) are broadcast.
    """
    ranks = load_ranks(f"{tokenizers}/{vocabulary}")
    shared = df.sparkSession.sparkContext.broadcast((ranks, PerfectHash(ranks)))
    kind = df.schema[id_col].dataType
    out = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.IntegerType()) if counts_only else T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    src = df.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        encoder = Encoder(*shared.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _slices(texts):
                offsets, ids = encoder.encode(texts[a:b])
                if counts_only:
                    value = pa.array(np.diff(offsets).astype(np.int32))
                else:
                    value = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), value], names=[id_col, out.fieldNames()[1]])

    return src.mapInArrow(run, out)
