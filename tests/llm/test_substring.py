"""Substring dedup: rank, backward search, and the operator against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest

from quillon.llm import substring as S


def test_wavelet_rank():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (63, 3), (64, 9), (1000, 700)):
        data = rng.integers(0, top, n)
        tree = S.Wavelet(data, top - 1)
        symbol, at = rng.integers(0, top, 300), rng.integers(0, n + 1, 300)
        assert tree.rank(symbol, at).tolist() == [int((data[:a] == s).sum()) for s, a in zip(symbol, at)]


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    text = np.concatenate([np.append(rng.integers(1, 4, 40), 0) for _ in range(5)])
    doc = np.repeat(np.arange(5), 41)
    index = S.FMIndex(text, doc, doc, 30)
    for _ in range(200):
        a = rng.integers(0, len(text) - 8)
        pattern = text[a : a + rng.integers(1, 8)]
        if 0 in pattern:
            continue
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        at = [i for i in range(len(text)) if text[i : i + len(pattern)].tolist() == pattern.tolist()]
        assert hi[0] - lo[0] == len(at)
        low, high = index.documents(lo, hi)
        assert (low[0], high[0]) == (min(doc[at]), max(doc[at]))


def brute(rows, length, later=False):
    where = defaultdict(set)
    words = defaultdict(list)
    for d, t in rows:
        if d is not None and t is not None:
            w = t.split()
            words[d].append(w)
            for i in range(len(w) - length + 1):
                where[tuple(w[i : i + length])].add(d)
    out = {}
    for d, texts in words.items():
        hit = set()
        for w in texts:
            for i in range(len(w) - length + 1):
                s = where[tuple(w[i : i + length])]
                if (min(s) < d) if later else len(s) > 1:
                    hit.update(range(i, i + length))
        runs = []
        for i in sorted(hit):
            if runs and runs[-1][1] == i:
                runs[-1][1] = i + 1
            else:
                runs.append([i, i + 1])
        if runs:
            out[d] = [tuple(r) for r in runs]
    return out


def got(spark, rows, length, later=False):
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "doc_id bigint, text string, h string, body string, word int")
    out = defaultdict(list)
    text = dict(rows)
    for r in S.repeated_passages(df, length=length, later=later).collect():
        out[r.doc_id].append((r.start_word, r.end_word))
        assert text[r.doc_id][r.start_char : r.end_char].split() == text[r.doc_id].split()[r.start_word : r.end_word]
    return {d: sorted(x) for d, x in out.items()}


def test_range_minima():
    rng = np.random.default_rng(4)
    for n in (1, 7, 8, 9, 100, 1000):
        data = rng.integers(0, 50, n).astype(np.int32)
        lo = rng.integers(0, n, 400)
        hi = np.minimum(lo + rng.integers(1, n + 1, 400), n)
        assert S.Minima(data).of(lo, hi).tolist() == [data[a:b].min() for a, b in zip(lo, hi)]
        assert (-S.Minima(-data).of(lo, hi)).tolist() == [data[a:b].max() for a, b in zip(lo, hi)]


@pytest.mark.parametrize("seed,shard,hot", [(0, 1 << 20, 4096), (1, 60, 4096), (2, 300, 6), (3, 1, 0)])
def test_against_brute_force(spark, seed, shard, hot, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "SHARD", shard)
    monkeypatch.setattr(S, "HOT", hot)
    base = [[f"w{rng.randrange(6)}" for _ in range(rng.randrange(5, 60))] for _ in range(6)]
    rows = []
    for d in range(60):
        w = []
        for _ in range(rng.randrange(4)):
            if rng.random() < 0.6:
                b = rng.choice(base)
                a = rng.randrange(len(b))
                w += b[a : a + rng.randrange(1, 40)]
            else:
                w += [f"é{rng.randrange(40)}" for _ in range(rng.randrange(12))]
        rows.append((d * 3, rng.choice([" ", "\n", "  "]).join(w)))
    for length in (8, 12):
        for later in (False, True):
            assert got(spark, rows, length, later) == brute(rows, length, later)


def test_awkward(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, long), (2, "x " + long), (3, None), (4, ""), (None, long), (5, "few words"), (6, "z " * 500), (7, " \n" + " ".join(["é"] * 60) + "\n"), (8, "q " + "é " * 55)]
    assert got(spark, rows, 50) == brute(rows, 50)
    assert got(spark, rows, 50, True) == brute(rows, 50, True)
    twice = [(1, "a b c d e f"), (1, "a b c d e f"), (9, "k l m n")]
    assert got(spark, twice, 3) == {}
    assert got(spark, [], 3) == {}


def test_a_passage_of_all_documents(spark, monkeypatch):
    licence = " ".join(f"l{i}" for i in range(55))
    rows = [(d, f"a{d} b{d} c{d} {licence} x{d} y{d}") for d in range(20_000)] + [(d, licence) for d in range(20_000, 40_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for later in (False, True):
        got = S.repeated_passages(df, later=later)
        assert {(r.start_word, r.end_word, r.own): r["count"] for r in got.withColumn("own", got.doc_id < 20_000).groupBy("start_word", "end_word", "own").count().collect()} == {(3, 58, True): 20_000 - later, (0, 55, False): 20_000}


def test_windows_of_long_words(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([3, 5, 900, 4000])))
    shared = [word() for _ in range(70)]
    rows = [(d, " ".join([word() for _ in range(30)] + shared[d : 60 + d] + [word() for _ in range(30)])) for d in range(8)]
    for later in (False, True):
        assert got(spark, rows, 50, later) == brute(rows, 50, later)
