"""Near dedup: alignment, sketches, whole operator against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import near_dedup as N
from quillon.llm.common import flat, find_words, fold, folded_hashes, word_hashes
from quillon.llm.components import components
from quillon.llm.near_dedup import alike, bags, banded_distance, least_distance, near_duplicates, normal_words, occurrences

SCHEMA = "doc_id bigint, text string, n string, key string, members string, g string, a string, b string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("seed", range(6))
def test_banded_distance(seed):
    rng = random.Random(seed)
    for _ in range(150):
        a = [rng.randrange(5) for _ in range(rng.randrange(0, 60))]
        b = list(a) if rng.random() < 0.7 else [rng.randrange(5) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 9)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = [rng.randrange(5)] * rng.randrange(2)
        for limit in (0, 1, 3, 8, 70):
            assert banded_distance(a, b, limit) == min(distance(a, b), min(limit, max(len(a), len(b))) + 1 if limit < distance(a, b) else 10**9)
        for s in (0.5, 0.8, 0.9):
            most = max(len(a), len(b))
            assert alike(np.array(a, np.int64), np.array(b, np.int64), s) == (distance(a, b) <= int((1 - s) * most + 1e-9))


def test_bags_bound_the_distance():
    rng = random.Random(9)
    for _ in range(200):
        a = [rng.randrange(300) for _ in range(rng.randrange(1, 40))]
        b = [x for x in a if rng.random() < 0.8] + [rng.randrange(300) for _ in range(rng.randrange(5))]
        bag = bags(np.array(a + b, np.uint64), np.array([0, len(a), len(a) + len(b)]))
        assert least_distance(bag[:1], bag[1:])[0] <= distance(a, b)


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["", "  a  bb\nccc ", None, "É école! ÉCOLE a", "x" * 1000, " "]
    buf, offs = flat(pa.array(texts))
    words = find_words(buf, offs)
    assert words.count.tolist() == [len((t or "").split()) for t in texts]
    got = [bytes(buf[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert got == [w for t in texts for w in (t or "").split()]
    hashes = word_hashes(buf, words)
    assert len(set(hashes.tolist())) == len(set(got)) and hashes[got.index("a")] == hashes[len(got) - 2]
    folded = folded_hashes(buf, words)
    assert folded[got.index("école!")] == folded[got.index("ÉCOLE")]
    assert bytes(fold(np.frombuffer("ÀÞ×ßAZ".encode(), np.uint8))).decode() == "àþ×ßaz"
    assert occurrences(np.array([3, 1, 3, 3, 1], np.uint64)).tolist() == [0, 0, 1, 2, 1]


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 6), (5, 5), (3, 1), (20, 6)]
    got = dict(components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {2: 1, 3: 1, 7: 6, 8: 6, 9: 6, 20: 6}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)] + ["the", "of", "and"] * 400
    rows, ident = [], 0
    boiler = [rng.choice(vocabulary) for _ in range(30)]
    for n in [6, 9, 14, 20, 30, 60, 70, 90, 150, 300, 400] * 6:
        base = [rng.choice(vocabulary) for _ in range(n)]
        rows.append((ident, " ".join(base)))
        ident += 1
        for _ in range(rng.randrange(4)):
            other = list(base)
            for _ in range(max(1, int(n * rng.uniform(0.0, 0.1)))):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[rng.choice(vocabulary)], [], [other[at], rng.choice(vocabulary)]])
            rows.append((ident, ", ".join(other).upper() if rng.random() < 0.3 else " ".join(other)))
            ident += 1
        rows.append((ident, " ".join(boiler + [rng.choice(vocabulary) for _ in range(20)])))
        ident += 1
    rows += [(ident + i, " ".join(["for"] * (500 + i))) for i in range(40)]
    return rows


def brute(rows):
    codes, of = normal_words(*flat(pa.array([t for _, t in rows])))
    seq = [codes[of[i] : of[i + 1]] for i in range(len(rows))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(seq[i], seq[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {(i, find(i)) for i in range(len(rows)) if find(i) != i}


@pytest.mark.parametrize("fan", [256, 3])
def test_near_duplicates_against_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(N, "FAN", fan)
    rows = corpus()
    want = brute(rows)
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert {i for i, _ in got} <= {i for i, _ in want}
    assert len(got & want) >= 0.9 * len(want)


def test_pairs_near_the_bound_are_found(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows = []
    for n in (64, 120, 200, 300, 400) * 24:
        base = [rng.choice(vocabulary) for _ in range(n)]
        other = list(base)
        for at in rng.sample(range(n), int(n * rng.uniform(0.1, 0.19))):
            other[at] = rng.choice(vocabulary)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    got = {tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    want = {(i + 1, i) for i in range(0, len(rows), 2)}
    assert got <= want and len(got) >= 0.9 * len(want)


def test_rare_words_meet_in_similar_texts(spark):
    rows = corpus(5)
    texts = spark.createDataFrame(rows, "doc_id bigint, text string")
    rare = {}
    for r in N.rare_words(texts).collect():
        rare.setdefault(r.doc_id, set()).add(r["item"])
    codes, of = normal_words(*flat(pa.array([t for _, t in rows])))
    seq = [codes[a:b] for a, b in zip(of, of[1:])]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(seq[i], seq[j])]
    assert pairs and all(rare[i] & rare[j] for i, j in pairs)


def test_a_line_that_all_share_and_copies_of_one_text(spark):
    line = " ".join(f"l{i}" for i in range(40))
    many = spark.range(20_000)
    shared = many.selectExpr("id as doc_id", f"concat('{line} ', array_join(transform(sequence(1, 24), i -> concat('u', id, '_', i)), ' ')) as text")
    near = many.selectExpr("id + 100000 as doc_id", f"concat('{line.replace('l', 'm')} {line.replace('l', 'n')} v', id) as text")
    same = many.selectExpr("id + 200000 as doc_id", f"'{line.replace('l', 'k')}' as text")
    got = near_duplicates(shared.unionByName(near).unionByName(same))
    assert sorted((r.kept_doc_id, r["count"]) for r in got.groupBy("kept_doc_id").count().collect()) == [(100_000, 19_999), (200_000, 19_999)]


def test_near_duplicates_awkward(spark):
    rows = [(1, "a b c d e f g h i j"), (4, "A, b c d e f g h i j."), (4, "A, b c d e f g h i j."), (None, "a b c d e f g h i j"), (5, None), (6, ""), (7, " | "), (8, "|"), (9, "one"), (10, "one"), (11, "two"), (12, "z " * 30000), (13, "z " * 30000 + "y")]
    df = spark.createDataFrame([(i, t, "a", "b", "c", "d", "e", "f") for i, t in rows], SCHEMA)
    assert {tuple(r) for r in near_duplicates(df).collect()} == {(4, 1), (10, 9), (13, 12)}
    assert near_duplicates(df.limit(0)).count() == 0
