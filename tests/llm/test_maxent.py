"""Maximum entropy: the tree of classes, scores against plain Python, the gradient, held-out text, awkward rows."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import maxent as M
from quillon.llm.common import flat


def hashed(words):
    return np.sort(M.words_of(*flat(pa.array([" ".join(words)])))[0])


def random_model(seed=0, words=("the", "cat", "sat", "on", "a", "mat", "end", *(f"w{i}" for i in range(300))), size=1 << 12):
    rng = np.random.default_rng(seed)
    codes = np.unique(hashed(words))
    tree = M.grow(codes, rng.integers(2, 1000, len(codes)) ** 2, 50)
    return M.Model(tree, rng.normal(0, 0.5, (size, M.WAYS)).astype(np.float32), size)


def plain(model, codes):
    """log-probability of each word's leaf, word by word and level by level."""
    out, tree = [], model.tree
    for t, code in enumerate(codes.tolist()):
        hit = np.flatnonzero(tree.codes == np.uint64(code))
        leaf = int(hit[0]) if len(hit) else len(tree.codes)
        found = M.features(codes, np.array([0, len(codes)]))[:, t]
        total = 0.0
        for level in range(tree.depth[leaf]):
            node, digit = tree.node[level][leaf], tree.digit[level][leaf]
            logits = tree.prior[node].astype(float)
            if level < M.CONTEXT:
                for row in M.rows_of(found, np.full(M.HISTORY, node), model.size):
                    logits = logits + model.weights[row]
            total += logits[digit] - math.log(sum(math.exp(x) for x in logits))
        out.append(total)
    return out


@pytest.mark.parametrize("n", [0, 1, 2, 40, 5000])
def test_tree_has_each_word_once_at_its_share(n):
    rng = np.random.default_rng(n)
    counts = (rng.pareto(1.0, n) * 5 + 2).astype(np.int64)
    tree = M.grow(np.arange(n, dtype=np.uint64), counts, 17)
    paths = {tuple((int(tree.node[k][w]), int(tree.digit[k][w])) for k in range(tree.depth[w])) for w in range(n + 1)}
    assert len(paths) == n + 1 and (n == 0 or min(map(len, paths)) > 0)
    everyone = counts.sum() + 18
    for w in range(n + 1):
        share = sum(float(tree.prior[node, digit]) for node, digit in ((tree.node[k][w], tree.digit[k][w]) for k in range(tree.depth[w])))
        assert abs(share - math.log((18 if w == n else counts[w]) / everyone)) < 1e-4
    assert len(tree.digit) < 14 and tree.find(np.array([n + 5], np.uint64))[0] == n


def test_scores_against_plain_python():
    model = random_model()
    texts = ["the cat sat on the mat", "", "a", "| . the End w7 w200 unheard"]
    codes, of = M.words_of(*flat(pa.array(texts)))
    got, _ = M.log_probs(model, codes, of)
    for a, b in zip(of, of[1:]):
        assert np.allclose(got[a:b], plain(model, codes[a:b]), atol=1e-4)


def test_probabilities_sum_to_one():
    model = random_model(1)
    context = hashed(["the"]), hashed(["cat"])
    total = 0.0
    for code in [*model.tree.codes, np.uint64(12345)]:
        codes = np.array([context[0][0], context[1][0], code], np.uint64)
        total += math.exp(M.log_probs(model, codes, np.array([0, 3]))[0][2])
    assert abs(total - 1) < 1e-4


def test_step_is_the_gradient():
    """One step from zero squares moves each touched row by RATE along its gradient, scaled by its root mean square."""
    model = random_model(2)
    trainer = M.Trainer(model)
    rows = np.array([[5, 6, 5, 7, 5, 6], [9, 9, 8, 8, 5, 9]], np.uint32)
    prior = model.tree.prior[np.array([0, 0, 1, 1, 0, 2])]
    target = np.array([1, 2, 3, 1, 1, 0])

    def loss(weights):
        return -sum(math.log(M.softmax(prior.astype(float), weights, rows)[i, t]) for i, t in enumerate(target))

    before = model.weights.astype(np.float64)
    trainer.step(prior, rows, target)
    for row in (5, 6, 7, 8, 9):
        numeric = np.zeros(M.WAYS)
        for j in range(M.WAYS):
            up, down = before.copy(), before.copy()
            up[row, j] += 1e-4
            down[row, j] -= 1e-4
            numeric[j] = (loss(up) - loss(down)) / 2e-4
        want = -M.RATE * numeric / math.sqrt((numeric**2).mean() + 1e-6)
        assert np.allclose(trainer.weights[row] - before[row], want, atol=2e-2)
        assert trainer.seen[row] == (rows == row).sum()
    assert (trainer.weights[10:] == model.weights[10:]).all()


def test_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'")
    seen = docs.where("doc_id % 5 > 0")
    counted = M.count(seen)
    held = docs.where("doc_id % 5 = 0")
    rng = random.Random(1)
    texts = [r.text for r in held.select("text").collect()]
    mixed = spark.createDataFrame([(i, " ".join(rng.sample(t.split(), len(t.split())))) for i, t in enumerate(texts)], "doc_id bigint, text string")
    mean = lambda df, model: (lambda r: -r[0] / r[1] / math.log(2))(M.score(df, model, counted=counted).selectExpr("sum(log_prob)", "sum(n_words)").first())
    none, one, two = (M.train(seen, rounds=r, counted=counted) for r in (0, 1, 2))
    none.weights = np.zeros((none.size, M.WAYS), np.float32)
    unigram, first, natural = (mean(held, m) for m in (none, one, two))
    assert natural < mean(mixed, two) and natural < first < unigram < 14


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "same thing"), (3, "same thing"), (None, "x"), (5, "very long " * 50_000), (6, " | | ")]
    df = spark.createDataFrame([(*r, "a", 1.0) for r in rows], "doc_id bigint, text string, w string, log_prob double")
    model = M.train(df)
    got = {(r.doc_id, r.n_words): r for r in M.score(df, model).collect()}
    assert got[(1, None)].log_prob is None and got[(2, 0)].log_prob == 0 and got[(2, 0)].bits_per_word is None
    assert got[(6, 2)].log_prob < 0 and (5, 100_000) in got and len(got) == 6
    assert M.train(df.limit(0)) is None and M.train(df.where("doc_id < 3")) is None
    assert M.score(df.limit(0), model).count() == 0 and M.score(df, None).where("log_prob is not null").count() == 0
    few = df.where("doc_id is null or doc_id = 6")
    once = M.train(few)
    assert M.score(df, once, counted=M.count(few)).where("n_words > 0 and (log_prob is null or log_prob > 1e-6)").count() == 0


def test_table_grows_with_contexts(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.where("text is not null").collect()]
    exact = len(np.unique(M.features(*M.words_of(*flat(pa.array(texts)))) >> np.uint64(1)))
    monkeypatch.setattr(M, "BITS", 8)
    monkeypatch.setattr(M, "CONTEXTS", 64)
    one, three = M.train(docs.where("doc_id % 3 = 0"), rounds=1), M.train(docs, rounds=1)
    assert 0.85 * 256 * (exact / 64) ** 0.5 < three.size < 1.15 * 256 * (exact / 64) ** 0.5 and one.size < 0.8 * three.size
    weights = three.loaded().weights
    assert len(weights) == three.size and (weights != 0).any(1).mean() > 0.5
    assert len(one.tree.codes) < len(three.tree.codes) and M.table_size(1e30) == M.MOST


def test_rows_are_averaged_over_the_words_that_touched_them(spark):
    count = np.zeros((3, M.BLOCK), np.float32)
    count[:, 0], count[1, 1] = (1, 3, 4), 5
    deltas = [np.full((M.BLOCK, M.WAYS), x, np.float16) for x in (4, 8, 2)]
    for salts in ((0, 0, 0), (0, 1, 2), (5, 5, 1)):
        parts = spark.createDataFrame([(0, s, c.tobytes(), d.tobytes()) for s, c, d in zip(salts, count, deltas)], "block int, salt int, n binary, delta binary")
        got = np.frombuffer(M.add_up(parts).first().total, np.float32).reshape(M.BLOCK, -1)
        assert np.allclose(got[0], (4 + 24 + 8) / 8) and (got[1] == 8).all() and (got[2:] == 0).all()


def test_words_without_leaves_are_told_apart(spark):
    texts = ["the cat sat on the mat", "the dog sat on a mat", "the cat", None, "", "zebra zebra zebra quagga"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(None, "the cat"), (1, "the okapi")], "doc_id bigint, text string")
    counted = M.count(df)
    counts = Counter(w for t in [*texts, "the cat", "the okapi"] for w in (t or "").split())
    assert counted.where("not context").count() == len(counts)
    asked = df.union(spark.createDataFrame([(50, "the unheard")], "doc_id bigint, text string"))
    for own in (0, 2, 100):
        model = M.train(df, counted=counted, own=own)
        known = {w: len(model.tree.codes) > model.tree.find(hashed([w]))[0] for w in [*counts, "unheard"]}
        assert sum(known.values()) == len(model.tree.codes) == (0 if own == 0 else sum(c >= {2: 5, 100: 2}[own] - (own == 2) for c in counts.values())) and model.tree.rest == sum(c for w, c in counts.items() if not known[w])
        plain_ = sorted((r.doc_id or -1, r.n_words or 0, r.log_prob) for r in M.score(asked, model).collect() if r.n_words)
        for common in (M.COMMON, 2, 0):  # with and without words that are not broadcast
            rows = M.score(asked, model, counted=counted, common=common).collect()
            assert len(rows) == 9
            got = sorted((r.doc_id or -1, r.n_words or 0, r.log_prob) for r in rows if r.n_words)
            want = {(r.doc_id or -1, len(r.text.split())): sum(math.log(counts.get(w, 1) / (model.tree.rest + 1)) for w in r.text.split() if not known[w]) for r in asked.collect() if r.text}
            for (i, k, a), (j, m, b) in zip(plain_, got):
                assert (i, k) == (j, m) and abs(b - a - want[(i, k)]) < 1e-4
            assert all(abs(r.bits_per_word + r.log_prob / r.n_words / math.log(2)) < 1e-9 for r in rows if r.n_words)


def test_a_step_reads_each_row_once(monkeypatch):
    """Rows that are touched by one, a few and many words move as summed up one by one, and none is looked up twice."""
    model, rng = random_model(3), np.random.default_rng(3)
    n = 600
    rows = np.stack([np.minimum(rng.zipf(1.3, n), 900), 1000 + np.arange(n) // 3, 2000 + np.arange(n)])
    rows[2, :5] = rows[0, :5]  # one word, two features, one row
    prior, target = model.tree.prior[rng.integers(0, 3, n)], rng.integers(0, M.WAYS, n)
    counts = Counter(rows.ravel().tolist())
    assert {1, 2, 3} < set(counts.values()) and max(counts.values()) > 50
    p = M.softmax(prior.astype(float), model.weights.astype(float), rows)
    p[np.arange(n), target] -= 1
    want = dict.fromkeys(counts, 0.0)
    for r in rows:
        for i, row in enumerate(r.tolist()):
            want[row] = want[row] + p[i]
    trainer, read, take = M.Trainer(model), [], np.take

    def spy(a, indices, *args, **named):
        if a is trainer.weights:
            read.extend(np.asarray(indices).ravel().tolist())
        return take(a, indices, *args, **named)

    monkeypatch.setattr(np, "take", spy)
    trainer.step(prior, rows, target)
    assert sorted(read) == sorted(counts)
    for row, g in want.items():
        assert trainer.seen[row] == counts[row]
        assert np.allclose(trainer.weights[row] - model.weights[row], -M.RATE * g / math.sqrt((g**2).mean() + 1e-6), atol=1e-4)
    others = np.setdiff1d(np.arange(model.size), list(counts))
    assert (trainer.weights[others] == model.weights[others]).all() and not trainer.seen[others].any()


def test_leaves_of_words_that_begin_alike():
    rng = np.random.default_rng(4)
    for codes in (rng.integers(0, 1 << 63, 3000).astype(np.uint64) * np.uint64(2), np.arange(100, 160), np.uint64(2**64 - 1) - np.arange(40, dtype=np.uint64), np.array([7])):
        codes = np.unique(codes.astype(np.uint64))
        tree = M.grow(codes, rng.integers(2, 99, len(codes)), 3)
        asked = np.concatenate([codes, codes + np.uint64(1), codes - np.uint64(1), np.array([0, 1 << 63, 2**64 - 1], np.uint64)])
        place = {c: i for i, c in enumerate(codes.tolist())}
        assert tree.find(asked).tolist() == [place.get(c, len(codes)) for c in asked.tolist()]


def test_words_of_odd_bytes():
    rng = random.Random(5)
    signs = ["À", "É", "×", "Þ", "ß", "é", "Ÿ", "A", "z", "7", ".", "|", " ", "\n", "\t", "中"]
    texts = ["", " ", "É", *("".join(rng.choices(signs, k=k)) for k in range(1, 200))]
    codes, of = M.words_of(*flat(pa.array(texts)))
    lower = {c: c.lower() for c in signs if "À" <= c <= "Þ" and c != "×"} | {"A": "a", ".": "", "|": ""}
    want = [["".join(lower.get(c, c) for c in w) for w in t.split()] for t in texts]
    assert np.diff(of).tolist() == [len(w) for w in want]
    known = {}
    for word, code in zip((w for ws in want for w in ws), codes.tolist()):
        assert known.setdefault(word, code) == code
    assert len(set(known.values())) == len(known)
