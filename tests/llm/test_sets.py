"""Exact dedup, packing, sharding."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import exact_dedup as E
from quillon.llm.exact_dedup import PatriciaTrie, drop_exact_duplicates, exact_duplicates, shared_prefix
from quillon.llm import packing as P
from quillon.llm.packing import difference, pack, pack_documents
from quillon.llm.sharding import assign_shards, jump, write_sharded

SCHEMA = "doc_id bigint, text string, len string, hash string, bucket string, n string, __gone_ string, window_id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)


AWKWARD = [(1, "same text here"), (5, "same text here"), (3, "same text here"), (3, "same text here"), (None, "same text here"), (7, None), (8, None), (9, ""), (10, ""), (11, "x" * 300_000), (12, "x" * 300_000), (13, "x" * 299_999 + "y"), (14, "   "), (15, "one two three")]


def test_trie_against_dictionary():
    rng = random.Random(4)
    trie, want = PatriciaTrie(), {}
    for i in range(3000):
        key = bytes(rng.choice(b"ab") for _ in range(rng.randrange(0, 12)))
        ident = rng.randrange(10**6)
        want[key] = min(want.get(key, ident), ident)
        trie.insert(key, ident)
    assert trie.bytes > 0
    got = {}
    while trie.weight:
        got |= {k: (owner, len(members)) for k, owner, members in trie.spill()}
    assert {k: o for k, (o, _) in got.items()} == want and sum(n for _, n in got.values()) == 3000
    for a, b in ((b"", b""), (b"abc", b"abd"), (b"a" * 1000 + b"x", b"a" * 1000 + b"y"), (b"q" * 77, b"q" * 77)):
        n = min(len(a), len(b))
        assert shared_prefix(a, 0, b, 0, n) == next((i for i in range(n) if a[i] != b[i]), n)


def test_exact_duplicates(spark):
    got = {(r.doc_id, r.kept_doc_id) for r in exact_duplicates(docs(spark, AWKWARD)).collect()}
    assert got == {(5, 1), (3, 1), (10, 9), (12, 11)}
    kept = sorted((r.doc_id if r.doc_id is not None else -1) for r in drop_exact_duplicates(docs(spark, AWKWARD)).collect())
    assert kept == [-1, 1, 7, 8, 9, 11, 13, 14, 15]
    assert exact_duplicates(docs(spark, AWKWARD).limit(0)).count() == 0


@pytest.mark.parametrize("flush,part,fan", [(1 << 25, 1 << 22, 256), (3000, 1, 1), (3000, 1 << 22, 1), (0, 500, 256)])
def test_exact_duplicates_against_dictionary(spark, monkeypatch, flush, part, fan):
    for name, value in (("FLUSH", flush), ("PART", part), ("FAN", fan)):
        monkeypatch.setattr(E, name, value)
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(0, 9))) + "tail" * rng.randrange(3) for _ in range(400)]
    rows = [(rng.randrange(10**6), rng.choice(texts)) for _ in range(2500)]
    rows = list({i: t for i, t in rows}.items()) * 2
    first = {}
    for i, t in rows:
        first[t] = min(first.get(t, i), i)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(6)
    got = {r.doc_id: r.kept_doc_id for r in exact_duplicates(df).collect()}
    assert got == {i: first[t] for i, t in rows if first[t] < i}


def test_many_copies_of_one_text(spark):
    base = spark.range(50_000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'one licence' else concat('text ', id) end as text")
    got = exact_duplicates(base)
    assert got.count() == 16_666 and got.select("kept_doc_id").distinct().collect()[0][0] == 0


def naive_difference(sizes, k):
    parts = [[[(s, [i])] + [(0, [])] * (k - 1), i] for i, s in enumerate(sizes)]
    nxt = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[0][0][0] - p[0][-1][0]), p[1]))
        a, b = parts[0], parts[1]
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a[0], reversed(b[0]))]
        merged.sort(key=lambda x: -x[0])
        parts = [*parts[2:], [merged, nxt]]
        nxt += 1
    return [x[0] for x in parts[0][0]]


@pytest.mark.parametrize("seed", range(8))
def test_differencing_against_naive(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 60, rng.integers(2, 40))
    k = int(rng.integers(2, 7))
    where, sums = difference(sizes, k)
    assert sums.tolist() == naive_difference(sizes.tolist(), k)
    assert np.bincount(where, sizes, k).astype(int).tolist() == sums.tolist()
    packed = pack(sizes, 64)
    assert np.bincount(packed, sizes).max() <= 64
    assert np.bincount(packed).min() >= 1
    assert packed.max() + 1 >= -(-sizes.sum() // 64)


def test_pack_documents_covers_every_word(spark):
    rows = pack_documents(docs(spark, AWKWARD + [(i, "w " * (i * 37 % 500)) for i in range(100, 180)]), capacity=100, group=16).collect()
    words = defaultdict(list)
    load = defaultdict(int)
    for r in rows:
        words[r.doc_id].append((r.start_token, r.end_token))
        load[r.window_id] += r.n_tokens
        assert r.end_token - r.start_token == r.n_tokens > 0
    assert max(load.values()) <= 100
    for i in range(100, 180):
        spans = sorted(words[i])
        n = i * 37 % 500
        assert [a for a, _ in spans] == list(range(0, n, 100)) and (not n or spans[-1][1] == n)
    assert sorted(words[3]) == [(0, 3), (0, 3)] and words[None] == [(0, 3)]
    assert not {7, 8, 9, 10, 14} & set(words)
    assert words[11] == [(0, 1)]
    assert pack_documents(docs(spark, AWKWARD).limit(0)).count() == 0


@pytest.mark.parametrize("block", [4096, 7])
def test_packing_of_equal_rows(spark, monkeypatch, block):
    monkeypatch.setattr(P, "BLOCK", block)
    many = spark.range(50_000 if block > 100 else 300)
    for df, each in ((many.selectExpr("cast(null as bigint) as doc_id", "repeat('w ', 500) as text"), 500), (many.selectExpr("7L as doc_id", "repeat('w ', 2048 + 30) as text"), 2078)):
        rows = pack_documents(df.repartition(3))
        assert rows.agg({"n_tokens": "sum"}).first()[0] == each * many.count()
        assert rows.groupBy("window_id").agg({"n_tokens": "sum"}).agg({"sum(n_tokens)": "max"}).first()[0] <= 2048
        assert rows.select("window_id", "position").distinct().count() == rows.count()
        assert sorted(rows.collect()) == sorted(pack_documents(df.repartition(5)).collect())


def test_full_bucket_is_packed_in_parts(spark):
    df = spark.range(400).selectExpr("id as doc_id", "repeat('w ', cast(id % 90 + 1 as int)) as text")
    rows = pack_documents(df, capacity=100, group=2).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.window_id] += r.n_tokens
    assert sum(load.values()) == sum(i % 90 + 1 for i in range(400)) and max(load.values()) <= 100


def test_packing_fills_windows(spark, sf):
    rows = pack_documents(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    total = sum(r.n_tokens for r in rows)
    assert total / (2048 * len({r.window_id for r in rows})) > 0.8


def naive_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 2000).astype(np.uint64)
    for n in (1, 2, 7, 1024):
        assert jump(keys, n).tolist() == [naive_jump(int(k), n) for k in keys]
    a, b = jump(keys, 100), jump(keys, 120)
    assert ((a == b) | (b >= 100)).all() and abs((a != b).mean() - 20 / 120) < 0.04


def test_assign_shards(spark):
    rows = assign_shards(docs(spark, AWKWARD), shards=10, more=15).collect()
    assert len(rows) == len(AWKWARD)
    assert all((r.shard is None) == (r.doc_id is None) == (r.moved is None) for r in rows)
    assert len({r.shard for r in rows if r.doc_id == 3}) == 1
    assert assign_shards(docs(spark, AWKWARD).limit(0)).count() == 0


def test_write_sharded(spark, tmp_path):
    df = docs(spark, AWKWARD).selectExpr("*", "1 as shard", "2 as part")
    for spread in (1, 3):
        path = str(tmp_path / f"out{spread}")
        name = write_sharded(df, path, shards=4, spread=spread)
        back = spark.read.parquet(path)
        assert name == "shard_" and sorted(back.select(*df.columns).collect(), key=str) == sorted(df.collect(), key=str)
        want = {r.doc_id: r.shard for r in assign_shards(df, shards=4).collect()}
        assert all(r[name] == want[r.doc_id] for r in back.select("doc_id", name).collect())
    write_sharded(df.limit(0), str(tmp_path / "none"))
