"""CRF: marginals against enumeration, gradient, held-out documents, awkward rows."""

import itertools

import numpy as np
import pyarrow as pa

from quillon.llm import toxicity as T


def brute(e, trans):
    n = len(e)
    weight, p, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for tags in itertools.product((0, 1), repeat=n):
        s, last = 0.0, 0
        for x, t in zip(e, tags):
            s += trans[last][t] + x * t
            last = t
        w = np.exp(s)
        weight += w
        p += w * np.array(tags)
        for a, b in zip((0, *tags), tags):
            pairs[a, b] += w
    return p / weight, pairs / weight, np.log(weight)


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    for block in (1, 3, 64):
        T.BLOCK, old = block, T.BLOCK
        try:
            for _ in range(10):
                n = rng.integers(0, 9, 5)
                of = np.concatenate([[0], np.cumsum(n)])
                e, trans = rng.normal(0, 2, of[-1]), rng.normal(0, 1, (2, 2))
                p, pairs, z = T.marginals(e, of, trans, pairs=True)
                want = [brute(e[a:b], trans) for a, b in zip(of, of[1:])]
                assert np.allclose(p, np.concatenate([w[0] for w in want]))
                assert np.allclose(pairs, sum(w[1] for w in want))
                assert np.allclose(z, [w[2] for w in want])
                heavy = rng.normal(0, 1, 5)
                _, pairs, _ = T.marginals(e, of, trans, pairs=True, weigh=lambda _: heavy)
                assert np.allclose(pairs, sum(h * w[1] for h, w in zip(heavy, want)))
        finally:
            T.BLOCK = old


def test_long_row_equals_plain_recursion():
    rng = np.random.default_rng(2)
    e, trans = rng.normal(-2, 3, 5000), np.array([[1.0, -1.0], [0.2, 0.4]])
    p = T.marginals(e, np.array([0, 5000]), trans)
    a, al, be = np.exp(trans), np.zeros((5000, 2)), np.ones((5000, 2))
    v = np.array([1.0, 0.0])
    for t in range(5000):
        v = (v @ a) * [1, np.exp(e[t])]
        v /= v.sum()
        al[t] = v
    for t in range(4998, -1, -1):
        w = a @ (np.array([1, np.exp(e[t + 1])]) * be[t + 1])
        be[t] = w / w.sum()
    g = al * be
    assert np.allclose(p, g[:, 1] / g.sum(1))


def words_of(rows):
    return {r.doc_id: [(s.start, s.end) for s in r.spans] for r in rows}


def test_gradient_of_the_documents_likelihood():
    """Weights of the expected tags against differences of the log-likelihood that a toxic row has a toxic tag."""
    rng = np.random.default_rng(5)
    of, toxic = np.array([0, 4, 9, 9, 12]), np.array([True, False, False, True])
    e, trans = rng.normal(-1, 1, 12), rng.normal(0, 1, (2, 2))
    n = np.diff(of)

    def total(e, trans):
        z = T.marginals(e, of, trans, pairs=True)[2]
        for a, b, own in zip(of, of[1:], z):
            assert np.isclose(own, brute(e[a:b], trans)[2])
        return T.likelihood(z, n, toxic, trans)[0].sum()

    pull = np.zeros(4)

    def weigh(z):
        pull[:] = T.likelihood(z, n, toxic, trans)[1]
        return pull

    p, expected, _ = T.marginals(e, of, trans, pairs=True, weigh=weigh)
    expected[0, 0] -= (pull * n).sum()
    for i in range(12):
        step = np.eye(12)[i] * 1e-5
        assert np.isclose((total(e + step, trans) - total(e - step, trans)) / 2e-5, (p * np.repeat(pull, n))[i], atol=1e-5)
    for i in range(4):
        step = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert np.isclose((total(e, trans + step) - total(e, trans - step)) / 2e-5, expected.ravel()[i], atol=1e-5)


def test_densest_passage():
    p, of = np.random.default_rng(1).random(500) ** 3, np.array([0, 0, 3, 200, 500])
    want = []
    for a, b in zip(of, of[1:]):
        sure = [-np.log1p(-x) if x >= T.COUNTED else 0.0 for x in p[a:b]]
        want.append(max((sum(sure[i : i + T.WINDOW]) for i in range(b - a)), default=0.0))
    assert np.allclose(T.densest(p, of), want)


def test_a_passage_in_a_long_clean_text(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    field = T.train(docs, labels)
    field.rate = 0.01
    long = " ".join(["the of and to in that is"] * 3000)
    rows = [(1, long), (2, long[:40_000] + " you stupid idiot and worthless loser " + long[40_000:])]
    got = T.toxic_documents(spark.createDataFrame(rows, "doc_id bigint, text string"), field).collect()
    assert [r.doc_id for r in got] == [2] and all(39_990 < s.start < 40_060 for s in got[0].spans)


def test_held_out_documents(spark, sf):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    field = T.train(docs, labels.where("doc_id % 2 = 0"))
    held = docs.join(labels.where("doc_id % 2 = 1"), "doc_id")
    text = {r.doc_id: r.text for r in held.collect()}
    got = words_of(T.toxic_documents(held, field).collect())
    bad = {r.doc_id for r in held.where("toxic = 1 and quality = 1").collect()}
    good = {r.doc_id for r in held.where("toxic = 0").collect()}
    print(len(bad), len(bad & set(got)), len(good), len(good & set(got)))
    assert len(bad & set(got)) >= 0.85 * len(bad)
    assert len(good & set(got)) <= 0.01 * len(good)
    said = {text[d][a:b].strip(".,").lower() for d, s in got.items() for a, b in s if " " not in text[d][a:b]}
    assert said & {"idiot", "moron", "trash", "stupid", "scum", "loser"}


def test_awkward_rows(spark):
    rng = np.random.default_rng(3)
    some = lambda: " ".join(f"w{x}" for x in rng.integers(0, 60, 12))
    toxic = [(i, f"{some()} vile {some()}", 1) for i in range(60)]
    plain = [(100 + i, f"{some()} kind {some()}", 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t, _ in toxic + plain], "doc_id bigint, text string, spans string, score double")
    labels = spark.createDataFrame([(i, x, 1) for i, _, x in toxic + plain] + [(None, 1, 1), (5, None, 1)], "doc_id bigint, toxic int, quality int")
    field = T.train(docs, labels)
    rows = [(1, "é a VILE, thing"), (2, None), (3, ""), (4, "kind words"), (None, "vile"), (6, "vile"), (6, "vile"), (7, "kind " * 60000 + "vile " + "kind " * 60000)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id bigint, text string, spans string, score double")
    got = T.toxic_documents(df, field).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 6, 6, 7]
    assert words_of(got)[1] == [(4, 9)] and words_of(got)[7] == [(300000, 300004)]
    assert T.toxic_documents(df.limit(0), field).count() == 0
    assert T.toxic_documents(df, T.train(docs, labels.limit(0))).count() == 0
    assert T.toxic_documents(df, T.train(docs, labels.where("toxic = 0"))).count() == 0
