import random

import pytest
from pyspark.sql import functions as F

from loomspark.llm import encoding as E, packing as P


@pytest.fixture(scope="module")
def ranks():
    return E.load_ranks(f"{E.TOKENIZERS}/byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def table(ranks):
    return E.PerfectHash(ranks)


def reference(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_perfect_hash_is_minimal_and_exact(ranks, table):
    keys = list(ranks)
    assert table.lookup(keys).tolist() == list(ranks.values())
    assert sorted(table.keys) == sorted(keys) and len(table.keys) == len(keys)
    assert (table.lookup([b"no such token at all", b""]) == -1).all()


def test_random_texts(ranks, table):
    encode, own = reference(ranks), E.Encoder(ranks, table, memory=500)
    random.seed(1)
    letters = "ab'sl d\t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　é中文😀1٣½_<|endoftext|>́"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))) for _ in range(3000)] + ["a" * 20000, " " * 5000, "中" * 3000, "We've  the <|endoftext|> 12345's"]
    offsets, ids = own.encode(texts)
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == encode(t), repr(t[:50])


def test_operator(spark, ranks):
    rows = [(3, None, "x"), (1, "", "x"), (2, "Hello world", "x"), (None, "a b", "x"), (2, "Hello world", "x"), (9, "😀 " * 6000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [(r.doc_id, r.ids) for r in E.encode_corpus(df).collect()]
    encode = reference(ranks)
    key = lambda r: (str(r[0]), len(r[1]))
    assert sorted(got, key=key) == sorted(((i, encode(t or "")) for i, t, _ in rows), key=key)
    counts = E.encode_corpus(df, counts_only=True)
    assert dict(counts.dtypes) == {"doc_id": "bigint", "n_tokens": "int"}
    assert E.encode_corpus(df.limit(0)).count() == 0


def test_pack_fills_containers():
    random.seed(6)
    sizes = [min(2048, max(1, int(random.lognormvariate(5.3, 1.1)))) for _ in range(8000)]
    at = P.pack(sizes, 2048)
    used = {}
    for s, c in zip(sizes, at):
        used[c] = used.get(c, 0) + s
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))
    assert sum(sizes) / (2048 * len(used)) > 0.99


def test_packing_operator(spark):
    random.seed(7)
    rows = [(i, random.choice([5, 100, 300, 700, 2048, 5000]), "x") for i in range(900)] + [(2000, 0, "x"), (2001, None, "x"), (2002, -4, "x"), (None, 10, "x"), (1, 50, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int, container string")
    got = P.pack_items(df, 2048, shard_rows=120).collect()
    held, of = {}, {}
    for r in got:
        held.setdefault(r.container, []).append(r)
        of.setdefault((r.doc_id, r.piece), []).append(r.size)
    for rs in held.values():
        assert sum(r.size for r in rs) == rs[0].used <= 2048 and {r.used for r in rs} == {rs[0].used}
        assert sorted(r.position for r in rs) == list(range(len(rs)))
    assert sum(r.size for r in got) == sum(s for _, s, _ in rows if s and s > 0)
    assert not any(r.doc_id in (2000, 2001, 2002) for r in got)
    big = next(i for i, s, _ in rows if s == 5000)
    assert sorted(x for (i, _), xs in of.items() if i == big for x in xs) == [904, 2048, 2048]
    assert sum(r.size for r in got) / (2048 * len(held)) > 0.97
    assert P.pack_items(df.limit(0)).count() == 0


def test_items_that_never_fill_a_container_stay_in_bounded_shards(spark, monkeypatch):
    df = spark.range(200_000).select(F.col("id").alias("doc_id"), F.lit(1100).alias("n_tokens"))
    rounds, own = [], P._pack_shards
    monkeypatch.setattr(P, "_pack_shards", lambda rows, shards, *a: (rounds.append(shards), own(rows, shards, *a))[1])
    got = P.pack_items(df, 2048, shard_rows=20_000)
    assert rounds == [10, 10]  # the second round saves nothing, so there is no third, and no task holds more
    sizes = [r.n for r in got.groupBy(F.substring_index("container", "-", 2)).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 200_000 and max(sizes) < 22_000
    assert got.select("container").distinct().count() == 200_000


def test_one_id_for_all_rows_is_spread(spark):
    df = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 700 + 1).cast("int").alias("n_tokens"))
    got = P.pack_items(df, 2048, shard_rows=500)
    per = [r.n for r in got.where("container like '0-%'").groupBy(F.substring_index("container", "-", 2)).agg(F.count("*").alias("n")).collect()]
    assert len(per) == 10 and max(per) < 700
    total = sum(i % 700 + 1 for i in range(5000))
    assert got.agg(F.sum("size")).first()[0] == total and total / (2048 * got.select("container").distinct().count()) > 0.97
