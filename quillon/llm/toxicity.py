"""Toxic spans by a linear-chain conditional random field over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm.common import Words, clean, find_words, flat, folded_hashes, pieces
from quillon.session import prepare, table, written

TRAIN_DOCS = (2000, 1000)  # labelled clean and toxic documents, at most, that the field is fitted on
CONTEXTS = 5  # distinct neighbourhoods in toxic documents that a word must have to have weights
FRONT = 4  # bytes of a word that are a feature beside the whole word, so that endings do not hide it
START = -7.0  # log-odds of a toxic tag to begin with
PENALTY = 0.005  # of squared weights
ASIDE = 200.0  # times as much for neighbours
STIFF = 50.0  # of squared transitions: a toxic word is little reason for the next one to be toxic
RATE = 0.25
THRESHOLD = 0.5  # of a span's words
COUNTED = 0.1  # of words that are evidence
WINDOW = 64  # words that are judged as a passage, however long the text is
HELD = 4  # every so many labelled documents are kept for the bounds on evidence
ALARMS = 0.004  # share of clean labelled documents that the bound on a whole text may let through
CHANCE = 4.0  # times the clean documents' evidence a word that a text is allowed for its length
BLOCK = 64
STEPS = 60


@dataclass
class Field:
    """codes: sorted hashes; weights[f]: log-odds of a toxic tag from the word, its left and its right neighbour, and its front.
    trans[i, j]: from tag i (0 clean, 1 toxic) to tag j; every text starts after a clean tag. A text is toxic where its
    evidence exceeds `least` + `rate` * its words, or that of WINDOW neighbouring words exceeds `dense`."""

    codes: np.ndarray
    weights: np.ndarray
    bias: float
    trans: np.ndarray
    least: float = 0.0
    rate: float = 0.0
    dense: float = 0.0

    def emissions(self, codes: np.ndarray, fronts: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Log-odds of the toxic tag of each word on its own; rows do not see each other's words."""
        padded = np.append(self.weights, np.zeros((len(self.weights), 1)), axis=1)
        out = np.full(len(codes), self.bias)
        for weights, slot in zip(padded, slots_of(self.codes, codes, fronts, of)):
            out += weights[slot]
        return np.clip(out, -30, 30)


def slots_of(known: np.ndarray, codes: np.ndarray, fronts: np.ndarray, of: np.ndarray) -> list[np.ndarray]:
    """Places in `known` (len(known) where it is not there) of each word, its left and its right neighbour, and its front."""

    def find(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        return np.where(known[at] == x, at, len(known))

    slot = find(codes)
    first = np.zeros(len(codes) + 1, bool)
    first[of] = True
    return [slot, np.where(first[: len(codes)], len(known), np.roll(slot, 1)), np.where(first[1:], len(known), np.roll(slot, -1)), find(fronts)]


def coded(buf: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and of their first FRONT bytes (0 for words that are not longer), which are told from words."""
    codes, fronts = folded_hashes(buf, words), folded_hashes(buf, words, FRONT)
    return codes, np.where(fronts == codes, np.uint64(0), fronts ^ np.uint64(0xA5A5A5A5A5A5A5A5))


def marginals(e: np.ndarray, of: np.ndarray, trans: np.ndarray, pairs: bool = False, weigh=None):
    """Probability of the toxic tag at each position by forward-backward; with `pairs` also the expected number of each
    transition, summed over rows by the weights that `weigh` gives for their log partitions (1 without it), and those.

    Rows are cut into blocks whose 2 x 2 transfer products are taken side by side; a scan over each row's
    blocks then gives every block its exact entry and exit vectors, so a long text needs length / BLOCK steps.
    """
    n = np.diff(of)
    blocks = -(-n // BLOCK)
    total = int(blocks.sum())
    if not total:
        return (np.zeros(0), np.zeros((2, 2)), np.zeros(len(n))) if pairs else np.zeros(0)
    start = np.cumsum(blocks) - blocks
    row = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(e)) - np.repeat(of[:-1], n)
    cell = (start[row] + inside // BLOCK) * BLOCK + inside % BLOCK
    x = np.ones(total * BLOCK)
    x[cell] = np.exp(e)
    valid = np.zeros(total * BLOCK, bool)
    valid[cell] = True
    x, valid = np.ascontiguousarray(x.reshape(total, BLOCK).T), np.ascontiguousarray(valid.reshape(total, BLOCK).T)
    a = np.exp(trans)
    # products over blocks, scaled
    p = np.zeros((2, 2, total))
    p[0, 0] = p[1, 1] = 1.0
    for k in range(BLOCK):
        q0 = p[:, 0] * a[0, 0] + p[:, 1] * a[1, 0]
        q1 = (p[:, 0] * a[0, 1] + p[:, 1] * a[1, 1]) * x[k]
        top = np.maximum(q0, q1).max(0)
        p[:, 0] = np.where(valid[k], q0 / top, p[:, 0])
        p[:, 1] = np.where(valid[k], q1 / top, p[:, 1])
    enter, leave = np.zeros((2, total)), np.ones((2, total))
    order = np.argsort(-blocks, kind="stable")
    sizes = blocks[order]
    now = np.zeros((2, len(n)))
    now[0] = 1.0
    for b in range(int(sizes[0])):
        rows = order[: np.searchsorted(-sizes, -b, side="left")]
        at = start[rows] + b
        enter[:, at] = now[:, rows]
        v0, v1 = now[0, rows], now[1, rows]
        w0, w1 = v0 * p[0, 0, at] + v1 * p[1, 0, at], v0 * p[0, 1, at] + v1 * p[1, 1, at]
        z = w0 + w1
        now[0, rows], now[1, rows] = w0 / z, w1 / z
    back = np.ones((2, len(n)))
    for b in range(int(sizes[0]) - 1, -1, -1):
        rows = order[: np.searchsorted(-sizes, -b, side="left")]
        at = start[rows] + b
        leave[:, at] = back[:, rows]
        v0, v1 = back[0, rows], back[1, rows]
        w0, w1 = p[0, 0, at] * v0 + p[0, 1, at] * v1, p[1, 0, at] * v0 + p[1, 1, at] * v1
        z = np.maximum(w0, w1)
        back[0, rows], back[1, rows] = w0 / z, w1 / z
    alpha = np.empty((BLOCK + 1, 2, total))
    alpha[0] = enter
    log_z = np.zeros(total)
    for k in range(BLOCK):
        v0, v1 = alpha[k]
        w0, w1 = v0 * a[0, 0] + v1 * a[1, 0], (v0 * a[0, 1] + v1 * a[1, 1]) * x[k]
        z = w0 + w1
        if pairs:
            log_z += np.log(np.where(valid[k], z, 1.0))
        alpha[k + 1, 0] = np.where(valid[k], w0 / z, v0)
        alpha[k + 1, 1] = np.where(valid[k], w1 / z, v1)
    owner = np.repeat(np.arange(len(n)), blocks)
    log_z = np.bincount(owner, log_z, len(n))
    heavy = np.ones(total) if weigh is None else weigh(log_z)[owner]
    beta = leave.copy()
    out = np.empty((BLOCK, total))
    expected = np.zeros((2, 2))
    for k in range(BLOCK - 1, -1, -1):
        f0, f1 = alpha[k + 1, 0] * beta[0], alpha[k + 1, 1] * beta[1]
        out[k] = f1 / (f0 + f1)
        b0, b1 = beta[0], beta[1] * x[k]
        if pairs:
            joint = np.array([[alpha[k, 0] * a[0, 0] * b0, alpha[k, 0] * a[0, 1] * b1], [alpha[k, 1] * a[1, 0] * b0, alpha[k, 1] * a[1, 1] * b1]])
            expected += (joint / joint.sum((0, 1)) * heavy)[:, :, valid[k]].sum(-1)
        w0, w1 = a[0, 0] * b0 + a[0, 1] * b1, a[1, 0] * b0 + a[1, 1] * b1
        z = np.maximum(w0, w1)
        beta = np.where(valid[k], np.array([w0 / z, w1 / z]), beta)
    got = out.T.ravel()[cell]
    if not pairs:
        return got
    # with entry vectors that sum to 1, each step's sum is that position's share of the partition
    return got, expected, log_z


def known_words(codes: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Sorted hashes of the words that have weights: those that stand in CONTEXTS different neighbourhoods or more, and
    in as many documents, of toxic texts, so that neither copies of a text nor one that repeats itself make words known."""
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    around = codes * np.uint64(3) ^ (np.roll(codes, 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.roll(codes, -1) * np.uint64(0xC2B2AE3D27D4EB4F))
    bad = np.flatnonzero(toxic[row])
    bad = bad[np.unique(around[bad], return_index=True)[1]]
    kinds, which, count = np.unique(codes[bad], return_inverse=True, return_counts=True)
    texts = np.bincount(np.unique(which * np.int64(len(of)) + row[bad]) // len(of), minlength=len(kinds))
    return kinds[(count >= CONTEXTS) & (texts >= CONTEXTS) & (kinds != 0)]


def likelihood(log_z: np.ndarray, n: np.ndarray, toxic: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the log-likelihood of its label and the weight of its expected tags in the gradient: a clean row has no
    toxic tag, a toxic one has one at least."""
    quiet = np.minimum(n * trans[0, 0] - log_z, -1e-12)  # log P(no tag is toxic)
    loud = np.log(-np.expm1(quiet))
    return np.where(toxic, loud, quiet), np.where(toxic, np.exp(np.clip(quiet - loud, -700, 7)), -1.0)


def learnt(codes: np.ndarray, fronts: np.ndarray, of: np.ndarray, toxic: np.ndarray, steps: int = STEPS) -> Field:
    """Field of greatest penalised likelihood of the documents' labels, by Adam on the exact gradient.

    Which words are toxic is not told. The likelihood of a toxic document is 1 - P(no tag is toxic), so the gradient is its
    expected tags given that one is toxic, less its expected tags: the field labels the tokens itself, as in
    expectation-maximisation, and what clean documents have too cannot stay toxic.
    """
    kinds = np.union1d(known_words(codes, of, toxic), known_words(fronts, of, toxic))
    if not len(kinds):
        return Field(np.zeros(1, np.uint64), np.zeros((4, 1)), START, np.zeros((2, 2)))
    size, n = len(kinds), np.diff(of)
    field = Field(kinds, np.zeros((4, size)), START, np.zeros((2, 2)))
    slots = slots_of(kinds, codes, fronts, of)
    row = np.repeat(np.arange(len(n)), n)
    params = np.zeros(4 * size + 5)
    params[-5] = START
    pull = np.zeros(len(n))
    price = np.repeat([PENALTY, ASIDE * PENALTY, ASIDE * PENALTY, PENALTY], size)  # else a word could be toxic for its neighbour's sake

    def weigh(log_z: np.ndarray) -> np.ndarray:
        pull[:] = likelihood(log_z, n, toxic, field.trans)[1]
        return pull

    m = v = np.zeros(len(params))
    for step in range(1, steps + 1):
        field.weights, field.bias, field.trans = params[: 4 * size].reshape(4, size), params[-5], params[-4:].reshape(2, 2)
        p, expected, _ = marginals(field.emissions(codes, fronts, of), of, field.trans, pairs=True, weigh=weigh)
        g = p * pull[row]
        expected[0, 0] -= float((pull * n).sum())
        grad = np.concatenate([*(np.bincount(s, g, minlength=size + 1)[:size] for s in slots), [g.sum()], expected.ravel()])
        grad[:-5] -= price * params[:-5]
        grad[-4:] -= STIFF * params[-4:]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        params = params + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.weights, field.bias, field.trans = params[: 4 * size].reshape(4, size).copy(), float(params[-5]), params[-4:].reshape(2, 2).copy()
    return field


def fit(texts: pa.Array, toxic: np.ndarray, steps: int = STEPS) -> Field:
    """Field learnt from labelled texts, every HELD-th left out, and the bounds on evidence that those of the clean ones need."""
    buf, offs = flat(texts)
    words = find_words(buf, offs)
    (codes, fronts), of, toxic = coded(buf, words), words.of, toxic.astype(bool)
    held = np.arange(len(toxic)) % HELD == HELD - 1
    if len(toxic) < 10 * HELD:
        held[:] = False

    def part(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.diff(of)
        return codes[np.repeat(rows, n)], fronts[np.repeat(rows, n)], np.append(0, np.cumsum(n[rows]))

    field = learnt(*part(~held), toxic[~held], steps)
    own, front, its = part((held if held.any() else ~held) & ~toxic)
    if len(its) > 1:  # how much evidence clean texts show by chance
        p = marginals(field.emissions(own, front, its), its, field.trans)
        found, length = evidence(p, its), np.diff(its)
        field.rate = CHANCE * float(found.sum()) / max(1, int(length.sum()))
        over = np.sort(found - field.rate * length)[::-1]
        field.least, field.dense = max(0.0, float(over[int(ALARMS * len(over))])), float(densest(p, its).max())
    return field


def doubts(p: np.ndarray) -> np.ndarray:
    """Sums up to each place of minus the log-probabilities that words of COUNTED or more are not toxic."""
    return np.append(0.0, np.cumsum(np.where(p >= COUNTED, -np.log1p(-np.minimum(p, 1 - 1e-12)), 0.0)))


def evidence(p: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Minus the log-probability that no word of COUNTED or more is toxic, for each row."""
    total = doubts(p)
    return total[of[1:]] - total[of[:-1]]


def densest(p: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Greatest evidence() of WINDOW neighbouring words of each row."""
    total = doubts(p)
    at = np.arange(len(p))
    here = total[np.minimum(at + WINDOW, np.repeat(of[1:], np.diff(of)))] - total[at]
    out = np.zeros(len(of) - 1)
    some = np.diff(of) > 0
    if some.any():
        out[some] = np.maximum.reduceat(here, of[:-1][some])
    return out


def train(docs: DataFrame, labels: DataFrame, most: tuple[int, int] = TRAIN_DOCS) -> Field | None:
    """Field fitted on at most `most` clean and toxic documents of labels (doc_id, toxic), chosen by a hash of
    their ids, ties by the id. None where nothing is labelled. Rows with a null id, label or text are not used; of
    repeated labels the toxic one counts, and all rows of a repeated document are used."""
    prepare(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), (F.col("toxic") > 0).alias("toxic")).where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = written(known.withColumn("r", rank).where(F.col("r") <= F.when(F.col("toxic"), most[1]).otherwise(most[0])).drop("r"), "chosen")
    sample = clean(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def learn(rows: pa.Table) -> pa.Table:
        order = pa.array(rows["doc_id"].to_numpy().argsort(kind="stable"))
        field = fit(rows["text"].take(order).combine_chunks(), rows["toxic"].take(order).to_numpy())
        return pa.table({"codes": pa.array([field.codes.view(np.int64)]), "weights": pa.array([field.weights.ravel()]), "bias": [field.bias], "trans": pa.array([field.trans.ravel()]), "bounds": pa.array([[field.least, field.rate, field.dense]])})

    found = sample.withColumn("all", F.lit(1)).groupBy("all").applyInArrow(learn, "codes array<bigint>, weights array<double>, bias double, trans array<double>, bounds array<double>").collect()
    if not found:
        return None
    r = found[0]
    return Field(np.array(r.codes, np.int64).view(np.uint64), np.array(r.weights).reshape(4, -1), r.bias, np.array(r.trans).reshape(2, 2), *r.bounds)


def tag(buf: np.ndarray, offs: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray, list[list[dict]]]:
    """Of each row: whether it is toxic, its score, and its spans of words of THRESHOLD or more as offsets in characters."""
    words = find_words(buf, offs)
    p = marginals(field.emissions(*coded(buf, words), words.of), words.of, field.trans)
    n = len(offs) - 1
    found = evidence(p, words.of)
    toxic = (found > 0) & ((found > field.least + field.rate * words.count) | (densest(p, words.of) > field.dense))
    spans: list[list[dict]] = [[] for _ in range(n)]
    hit = p >= THRESHOLD
    if hit.any():
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        first = np.zeros(len(p) + 1, bool)
        first[words.of] = True
        begin = np.flatnonzero(hit & (first[:-1] | ~np.roll(hit, 1)))
        end = np.flatnonzero(hit & (first[1:] | ~np.roll(hit, -1)))
        rows = np.searchsorted(words.of, begin, side="right") - 1
        lo, hi = chars[words.start[begin]] - chars[offs[rows]], chars[words.end[end]] - chars[offs[rows]]
        for r, a, b, i, j in zip(rows.tolist(), lo.tolist(), hi.tolist(), begin.tolist(), end.tolist()):
            spans[r].append({"start": a, "end": b, "score": float(p[i : j + 1].max())})
    return toxic, -np.expm1(-found), spans


def toxic_documents(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, n_spans, spans) of the toxic rows.

    score is the probability that some word of the text is toxic, over the words whose marginal is COUNTED or
    more, each on its own; a row is toxic where this evidence, or that of its densest WINDOW words, is beyond what clean
    labelled documents show by chance. A span is a run of words whose
    marginal is THRESHOLD or more, as character offsets [start, end) and its own greatest marginal. Null
    and empty texts hold none. Rows with a null id are judged too, repeated rows each. Without a field, or for an
    empty table, there are no rows. Other columns are not read.
    """
    shared = prepare(docs.sparkSession).sparkContext.broadcast(field)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, buf, offs in pieces(batches):
            if own is None:
                return
            toxic, scores, spans = tag(buf, offs, own)
            at = np.flatnonzero(toxic)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(scores[at]), pa.array([len(spans[i]) for i in at], pa.int64()), pa.array([spans[i] for i in at], span)], names=["doc_id", "score", "n_spans", "spans"])

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, score double, n_spans bigint, spans array<struct<start: bigint, end: bigint, score: double>>")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxic_documents(docs, train(docs, table(spark, sf_dir, "labels")))
