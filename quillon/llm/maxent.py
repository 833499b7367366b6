"""Hashed maximum-entropy language model with a class-factored softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyarrow import parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import U, find_words, folded_hashes, mix, pieces
from quillon.session import prepare, table, written

WAYS = 16  # classes of a class
CONTEXT = 3  # levels of classes that the context is asked for; deeper ones go by the corpus counts
OWN = 1 << 18  # most frequent words that have leaves of their own
BITS = 14  # the weight table has at least 2**BITS rows
MOST = 1 << 21  # and at most so many: 128 MB a worker
CONTEXTS = 1 << 14  # distinct contexts that 2**BITS rows are for; rows follow the root of their number
SKETCH = 1024  # least hashes that the number of distinct contexts is told from
HELD = 1 << 20  # distinct words that a counting task holds
COMMON = 4_000_000  # words whose counts are broadcast
SPREAD = 2  # training tasks to a core: each sends a whole table, so their number must not grow with the corpus
FAN = 64  # tasks whose changes of a block are added up at once
BATCH = 8192
PART = 1 << 20  # bytes of text at a time, as tasks hold tables beside it
RATE = 0.08
ROUNDS = 2
BLOCK = 1024
HISTORY = 3
NOTHING = -30.0  # logit of a class without words
NEAR = 4  # codes that are gone past before a search by halves
FEW = 6  # gradients of a row that are added up place by place
_LINE = np.dtype((np.void, 4 * WAYS))  # a row of weights as one value, which numpy moves at once
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


# ------------------------------------------------------------------------------------------------------------- classes


@dataclass
class Tree:
    """Words as leaves of nested classes, WAYS to a class, so that each class's words are about as frequent as the next one's:
    a frequent word is near the root. codes: sorted hashes; the word after the last stands for all others, `rest` occurrences.
    A word takes digit[level, word] of class node[level, word] at each level below depth[word]. prior[node]: logarithms
    of the classes' shares of the corpus."""

    codes: np.ndarray
    depth: np.ndarray
    digit: np.ndarray
    node: np.ndarray
    prior: np.ndarray
    rest: int

    @cached_property
    def begins(self) -> tuple[np.ndarray, np.uint64]:
        """Where the codes of each value of the first bits begin, four values or more to a code, and how far to shift for it."""
        bits = max(8, (4 * len(self.codes)).bit_length())
        shift = U(64 - bits)
        return np.searchsorted(self.codes, np.arange(1 << bits, dtype=np.uint64) << shift).astype(np.int32), shift

    @cached_property
    def deeper(self) -> np.ndarray:
        """Of each word, the sum of the priors below the levels that the context is asked for."""
        out = np.zeros(len(self.depth))
        for level in range(CONTEXT, len(self.digit)):
            at = np.flatnonzero(self.depth > level)
            out[at] += self.prior[self.node[level][at], self.digit[level][at]]
        return out

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Leaf of each word."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64)
        begins, shift = self.begins
        last = len(self.codes) - 1
        at = np.minimum(begins.take((codes >> shift).astype(np.int64)), last).astype(np.int64)
        low = np.flatnonzero(self.codes.take(at) < codes)
        for _ in range(NEAR):  # as codes are hashes, few begin alike
            at[low] += 1
            low = low[at.take(low) <= last]
            low = low[self.codes.take(at.take(low)) < codes.take(low)]
        at[low] = np.searchsorted(self.codes, codes[low])
        np.minimum(at, last, out=at)
        return np.where(self.codes.take(at) == codes, at, len(self.codes))


def grow(codes: np.ndarray, counts: np.ndarray, rest: int) -> Tree:
    """Tree of words (sorted hashes) with their counts, and of the rest."""
    counts = np.append(counts, rest + 1).astype(np.float64)
    order = np.lexsort((np.arange(len(counts)), -counts))
    mass = counts[order]
    upto = np.append(0.0, np.cumsum(mass))
    depth = np.zeros(len(counts), np.uint8)
    digits, nodes, priors = [], [], []
    group = np.zeros(len(counts), np.int64)  # of the words in order; -1 where a word is alone
    made = 0
    while (group >= 0).any():
        live = np.flatnonzero(group >= 0)
        first = live[np.append(True, group[live][1:] != group[live][:-1])]
        which = np.cumsum(np.append(True, group[live][1:] != group[live][:-1])) - 1
        size = np.diff(np.append(np.flatnonzero(np.append(True, group[live][1:] != group[live][:-1])), len(live)))
        low, whole = upto[first], upto[first + size] - upto[first]
        place = ((upto[live] + mass[live] / 2) - low[which]) / whole[which]
        own = np.minimum((place * WAYS).astype(np.int64), WAYS - 1)
        level_digit, level_node = np.zeros(len(counts), np.uint8), np.zeros(len(counts), np.int32)
        level_digit[order[live]], level_node[order[live]] = own, made + which
        digits.append(level_digit)
        nodes.append(level_node)
        depth[order[live]] += 1
        share = np.bincount(which * WAYS + own, mass[live], len(first) * WAYS).reshape(-1, WAYS)
        priors.append(np.where(share > 0, np.log(np.maximum(share, 1e-300) / whole[:, None]), NOTHING))
        many = np.bincount(which * WAYS + own, minlength=len(first) * WAYS)[which * WAYS + own]
        group[live] = np.where(many > 1, which * WAYS + own, -1)
        made += len(first)
    return Tree(codes, depth, np.array(digits), np.array(nodes), np.concatenate(priors).astype(np.float32), rest)


# --------------------------------------------------------------------------------------------------------------- model


@dataclass
class Model:
    """weights: rows of logits of the WAYS classes of a class, each for a hash of a class and a feature of the context.
    Where weights is None, the files of a written table have the blocks, for tasks to read."""

    tree: Tree
    weights: np.ndarray | None
    size: int = 1 << BITS
    files: tuple[str, ...] = ()

    def loaded(self) -> Model:
        """The model with its weights in memory; a worker keeps those it read last."""
        if self.weights is not None:
            return self
        if self.files not in _read:
            _read.clear()
            weights = np.zeros((self.size, WAYS), np.float32)
            for block, body in self.blocks():
                weights[block * BLOCK : (block + 1) * BLOCK] = body
            _read[self.files] = weights
        return Model(self.tree, _read[self.files], self.size, self.files)

    def blocks(self) -> Iterator[tuple[int, np.ndarray]]:
        for file in self.files:
            system, path = fs.FileSystem.from_uri(file)
            blocks = pq.read_table(path, filesystem=system)
            for block, body in zip(blocks["block"].to_pylist(), blocks["total"]):
                yield block, np.frombuffer(body.as_buffer(), np.float32).reshape(BLOCK, WAYS)


_read: dict[tuple[str, ...], np.ndarray] = {}


def table_size(contexts: float) -> int:
    """Rows of the weight table (whole blocks) for so many distinct contexts."""
    return min(MOST, max(1 << BITS, -(-int((1 << BITS) * (contexts / CONTEXTS) ** 0.5) // BLOCK) * BLOCK))


def features(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """[HISTORY, words]: hashes of each word's context in its row: the word before, the two before, and (a skip) the
    one before that alone. Before a row stands a sign of its own."""
    n = len(codes)
    at = np.arange(n) - np.repeat(of[:-1], np.diff(of))
    one = np.where(at > 0, np.roll(codes, 1), U(1))
    two = np.where(at > 1, np.roll(codes, 2), U(2))
    out = np.empty((HISTORY, n), np.uint64)
    out[0] = mix(one * _SALT[0])
    out[1] = mix(one * _SALT[1] + two)
    out[2] = mix(two * _SALT[2])
    return out


def rows_of(hashes: np.ndarray, node: np.ndarray, size: int) -> np.ndarray:
    """[HISTORY, words]: weight rows of each word's features in a class."""
    return ((mix(hashes + (node.astype(np.uint64) + U(1)) * _SALT[0]) >> U(20)) % U(size)).astype(np.int64)


def logits(prior: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits given each position's prior logits and its active weight rows (a sparse row of ones)."""
    p = prior.copy()
    more = np.empty_like(p)
    for r in rows:
        p += np.take(weights, r, axis=0, mode="clip", out=more)
    return np.clip(p, -60, 30, out=p)


def softmax(prior: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities given each position's prior logits and its active weight rows."""
    p = logits(prior, weights, rows)
    np.exp(p, out=p)
    p *= 1.0 / (p @ np.ones((p.shape[1], 1), p.dtype))
    return p


def places(tree: Tree, found: np.ndarray, leaf: np.ndarray, level: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which words have a class at a level, its prior logits, their weight rows and their digits."""
    at = np.flatnonzero(tree.depth.take(leaf) > level)
    own = leaf.take(at)
    node = tree.node[level].take(own)
    return at, tree.prior.take(node, axis=0), rows_of(found.take(at, axis=1), node, size), tree.digit[level].take(own).astype(np.int64)


def log_probs(model: Model, codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log P(leaf | context) of each word, the sum over its classes' levels, and which leaf it is."""
    tree, found, leaf = model.tree, features(codes, of), model.tree.find(codes)
    out = np.zeros(len(codes), np.float64)
    for i in range(0, len(codes), BATCH):
        own = leaf[i : i + BATCH]
        for level in range(min(CONTEXT, len(tree.digit))):
            at, prior, rows, digit = places(tree, found[:, i : i + BATCH], own, level, model.size)
            if not len(at):
                break
            p = logits(prior, model.weights, rows)
            wanted = p.ravel().take(np.arange(0, p.size, WAYS) + digit)
            np.exp(p, out=p)
            out[i + at] += np.maximum(wanted - np.log(p @ np.ones(WAYS, p.dtype)), np.log(1e-30))
    return out + tree.deeper.take(leaf), leaf


def summed(p: np.ndarray, example: np.ndarray, first: np.ndarray, count: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of several, and for each the sum of p over the examples from its first one on; up to FEW examples are added
    place by place for all rows with so many, as sums over short stretches are slow."""
    capped = np.minimum(count.take(several), FEW)
    several = several.take(np.argsort((FEW - capped).astype(np.uint8), kind="stable"))  # the most examples first
    upto = np.cumsum(np.bincount(capped, minlength=FEW + 1)[::-1])[::-1].tolist()  # upto[k] rows have k examples or more
    start, many = first.take(several), upto[FEW]
    total = np.take(p, example.take(start), axis=0, mode="clip")
    for k in range(1, FEW - 1):
        if upto[k + 1] > many:
            total[many : upto[k + 1]] += np.take(p, example.take(start[many : upto[k + 1]] + k), axis=0, mode="clip")
    if many:
        each = count.take(several[:many])
        among = np.take(p, example.compress(np.repeat(count >= FEW, count)), axis=0, mode="clip")
        total[:many] = np.add.reduceat(among, np.cumsum(each) - each, axis=0)
    return several, total.view(_LINE).ravel()


class Trainer:
    """Gradient steps on one task's part of the corpus, from given weights, with a step size per row."""

    def __init__(self, model: Model):
        self.model = model
        loaded = model.loaded()
        self.tree, self.size = model.tree, model.size
        self.weights = loaded.weights.copy() if model.weights is not None or model.files else np.zeros((model.size, WAYS), np.float32)
        self.state = np.full(model.size, 1e-6, np.complex64)  # of each row the sum of squares and the words that touched it, side by side

    @property
    def seen(self) -> np.ndarray:
        """Words that touched each row."""
        return self.state.imag

    def step(self, prior: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
        """Each distinct row is read and written once, in the order of the table; what is between is small enough for the cache."""
        n, lines = len(target), self.weights.view(_LINE).ravel()
        bits = U(rows.size.bit_length())
        key = rows.astype(np.uint64).ravel() << bits | np.arange(rows.size, dtype=np.uint64)
        key.sort()  # by row, then by place
        there, place = key >> bits, (key & ((U(1) << bits) - U(1))).astype(np.int64)
        new = np.concatenate([[True], there[1:] != there[:-1]])
        first = np.flatnonzero(new)
        own, count = there.take(first).astype(np.int64), np.diff(first, append=rows.size)
        where = np.empty(rows.size, np.int64)
        where[place] = np.cumsum(new) - 1
        weights = np.take(self.weights, own, axis=0, mode="clip")
        p = softmax(prior, weights, where.reshape(rows.shape))
        p.reshape(-1)[np.arange(0, p.size, WAYS) + target] -= 1.0  # gradient of the negative log-likelihood by the logits
        example = np.tile(np.arange(n), len(rows)).take(place)
        gradient = np.take(p, example.take(first), axis=0, mode="clip")
        several = np.flatnonzero(count > 1)  # most rows of long contexts are touched once
        if len(several):
            gradient.view(_LINE).ravel().put(*summed(p, example, first, count, several), mode="clip")
        state = self.state.take(own)
        square, seen = state.view(np.float32).reshape(-1, 2).T
        square += (gradient * gradient) @ np.full(WAYS, 1.0 / WAYS, np.float32)
        seen += count
        self.state[own] = state
        gradient *= np.repeat(-RATE / np.sqrt(square), WAYS).reshape(-1, WAYS)
        gradient += weights
        lines.put(own, gradient.view(_LINE).ravel(), mode="clip")

    def learn(self, codes: np.ndarray, of: np.ndarray) -> None:
        tree, found, leaf = self.tree, features(codes, of), self.tree.find(codes)
        for i in range(0, len(codes), BATCH):
            for level in range(min(CONTEXT, len(tree.digit))):
                at, prior, rows, digit = places(tree, found[:, i : i + BATCH], leaf[i : i + BATCH], level, self.size)
                if len(at):
                    self.step(prior, rows, digit)

    def deltas(self, salt: int) -> Iterator[pa.RecordBatch]:
        """What the steps have changed and how many words touched each row, in blocks of BLOCK rows."""
        start = self.model.loaded().weights if self.model.files or self.model.weights is not None else None
        count = self.seen.reshape(-1, BLOCK)
        some = np.flatnonzero(count.any(1))
        for part in np.array_split(some, -(-len(some) // 64) or 1):
            rows = [slice(b * BLOCK, (b + 1) * BLOCK) for b in part.tolist()]
            bodies = [(self.weights[r] - (0 if start is None else start[r])).astype(np.float16).tobytes() for r in rows]
            columns = [pa.array(part, pa.int32()), pa.array(np.full(len(part), salt), pa.int32()), pa.array([count[b].tobytes() for b in part.tolist()], pa.binary()), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "salt", "n", "delta"])


def words_of(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = find_words(buf, offs)
    return folded_hashes(buf, words), words.of


def least(hashes: np.ndarray) -> np.ndarray:
    """The SKETCH least distinct ones."""
    return np.unique(hashes)[:SKETCH]


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, code, n): the counts of words by their 64-bit hashes, and the least hashes of contexts."""

    def said(context: bool, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(code), context)), pa.array(code.view(np.int64)), pa.array(n)], names=["context", "code", "n"])

    low = np.zeros(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for _, buf, offs in pieces(batches, limit=PART):
        codes, of = words_of(buf, offs)
        found = features(codes, of).ravel() >> U(1)
        low = least(np.append(low, found[found <= low[-1]] if len(low) == SKETCH else found))
        held.append(np.unique(codes, return_counts=True))
        if sum(len(c) for c, _ in held) > HELD:
            yield said(False, *tally(held))
            held = []
    if held:
        yield said(False, *tally(held))
    yield said(True, low, np.zeros(len(low), np.int64))


def tally(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
    return codes, np.bincount(which, np.concatenate([n for _, n in held]), len(codes)).astype(np.int64)


def count(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Written (context, code, n) of all texts of df: each distinct word's hash with its count, and hashes of contexts."""
    prepare(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text")).where("text is not null")
    return written(texts.mapInArrow(count_words, "context boolean, code bigint, n bigint").groupBy("context", "code").agg(F.sum("n").alias("n")), "counted")


def contexts(low: np.ndarray) -> float:
    """Number of distinct contexts of which these are the least SKETCH hashes (of 63 bits)."""
    return len(low) if len(low) < SKETCH else (SKETCH - 1) / (float(low.max()) / 2.0**63)


def bound_of(words: DataFrame, most: int) -> int:
    """The least power of two, 2 or more, that at most `most` words occur so often."""
    power = F.length(F.bin("n")) - 1  # n >= 2 ** power
    by = sorted(((r.power, r.n) for r in words.groupBy(power.alias("power")).agg(F.count("*").alias("n")).collect()), reverse=True)
    bound, so_far = max((p for p, _ in by), default=0) + 1, 0
    for p, n in by:
        so_far += n
        if p < 1 or so_far > most:
            break
        bound = p
    return 1 << bound


def arrays(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words, and their counts; of a checked number."""
    known = words.select("code", "n").toArrow()
    codes, n = known["code"].to_numpy().view(np.uint64), known["n"].to_numpy()
    order = np.argsort(codes)
    return codes[order], n[order]


def weighted(rows: pa.Table, by_salt: bool) -> pa.Table:
    """Changes of each row of a block, averaged over the words that touched it, with the number of those."""
    total = n = None
    for body, seen in zip(rows["delta"], rows["n"]):
        own = np.frombuffer(seen.as_buffer(), np.float32).astype(np.float64)
        part = np.frombuffer(body.as_buffer(), np.float16 if by_salt else np.float32).astype(np.float64).reshape(BLOCK, -1) * own[:, None]
        total, n = (part, own) if total is None else (total + part, n + own)
    mean = (total / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()
    if by_salt:
        return pa.table({"block": rows["block"].slice(0, 1).cast(pa.int32()), "n": pa.array([n.astype(np.float32).tobytes()], pa.binary()), "delta": pa.array([mean], pa.binary())})
    return pa.table({"block": rows["block"].slice(0, 1).cast(pa.int32()), "total": pa.array([mean], pa.binary())})


def add_up(parts: DataFrame) -> DataFrame:
    """(block, total) of (block, salt, n, delta): first the changes of FAN tasks each, then theirs, so that none is held with all others."""
    near = parts.groupBy("block", "salt").applyInArrow(lambda rows: weighted(rows, True), "block int, n binary, delta binary")
    return near.groupBy("block").applyInArrow(lambda rows: weighted(rows, False), "block int, total binary")


def plus(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(body.as_buffer(), np.float32) for body in rows["total"])
    return pa.table({"block": rows["block"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})


def train(df: DataFrame, text_col: str = "text", rounds: int = ROUNDS, counted: DataFrame | None = None, own: int = OWN) -> Model | None:
    """Model of all texts of df, of which counted is count(); None where they have no words.

    Word counts are summed over all documents. The at most `own` most frequent words that occur twice or more are the leaves
    of a tree of classes made from the counts; one leaf is for the rest. The weight table's rows follow the root of
    the number of distinct contexts of the corpus, up to MOST. In each round every task makes gradient steps over its
    whole part of the corpus, and the changes of each row are averaged over the words that touched it. The table is
    written to the shared folder, where tasks read it.

    Null and empty texts add nothing; repeated rows count each. Ties of counts go by the words' hashes. As tasks step
    through their parts by themselves, weights depend on how the input is parted; the counts do not. Other columns
    are not read.
    """
    spark = prepare(df.sparkSession)
    texts = df.select(F.col(text_col).alias("text")).where("text is not null")
    counted = count(df, text_col) if counted is None else counted
    words = counted.where("not context")
    total = words.agg(F.sum("n")).first()[0]
    if not total:
        return None
    codes, n = arrays(words.where(F.col("n") >= bound_of(words, own)))
    low = [r.code for r in counted.where("context").orderBy("code").limit(SKETCH).collect()]
    model = Model(grow(codes, n, int(total - n.sum())), None, table_size(contexts(np.array(low))))
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            trainer = Trainer(shared.value)
            for _, buf, offs in pieces(batches, limit=PART):
                codes, of = words_of(buf, offs)
                if len(codes):
                    trainer.learn(codes, of)
            yield from trainer.deltas(TaskContext.get().partitionId() // FAN)

        parts = texts.coalesce(SPREAD * spark.sparkContext.defaultParallelism).mapInArrow(run, "block int, salt int, n binary, delta binary")
        merged = add_up(parts)
        if model.files:
            old = spark.read.schema(merged.schema).parquet(*model.files)
            merged = old.unionByName(merged).groupBy("block").applyInArrow(plus, "block int, total binary")
        model = Model(model.tree, None, model.size, tuple(sorted(written(merged, "weights").inputFiles())))
        shared.unpersist()
    return model


@dataclass
class Shares:
    """Logarithms of the counts of words without a leaf of their own that occur `least` times or more."""

    least: int
    codes: np.ndarray
    logs: np.ndarray

    def of(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Logarithm of each word's count (0 where it is not here), and which words are here."""
        if not len(self.codes):
            return np.zeros(len(codes)), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        here = self.codes[at] == codes
        return np.where(here, self.logs[at], 0.0), here


def shares(model: Model, counted: DataFrame, common: int = COMMON) -> Shares:
    """The at most `common` most frequent words, those that occur twice or more if they are not more than that, but for leaves."""
    words = counted.where("not context")
    least = bound_of(words, common)
    codes, n = arrays(words.where(F.col("n") >= least))
    other = model.tree.find(codes) == len(model.tree.codes)
    return Shares(least, codes[other], np.log(n[other]).astype(np.float32))


def score(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", counted: DataFrame | None = None, common: int = COMMON) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_word) of every row of df, repeated rows and null ids included.

    log_prob is the natural logarithm of the probability of the text's words (in lower case without ASCII
    punctuation; a word of punctuation only is one sign) given those before: of their leaves and, given counted (the
    count() of the corpus), of each word without a leaf among all such by its share of their occurrences. Words that the
    corpus does not have count as one occurrence. Without counted, words without leaves are one. A null text
    has nulls; one without words has 0 words, log_prob 0 and no bits_per_word. Texts may be of any length. Without a model
    log_prob is null. An empty table gives no rows. Other columns are not read.

    The `common` most frequent words are broadcast. If others occur twice or more, their counts are joined by a shuffle.
    """
    spark = prepare(df.sparkSession)
    charged = None if model is None or counted is None else shares(model, counted, common)
    shared = spark.sparkContext.broadcast((model, charged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, charge = shared.value
        own = own and own.loaded()
        for batch, buf, offs in pieces(batches, limit=PART):
            codes, of = words_of(buf, offs)
            n = np.diff(of)
            void = batch.column(1).is_null().to_numpy(zero_copy_only=False)
            total = np.zeros(batch.num_rows)
            rest, ends = codes[:0], np.zeros(len(of), np.int64)
            if own is not None and len(codes):
                each, leaf = log_probs(own, codes, of)
                if charge is not None:
                    other = np.flatnonzero(leaf == len(own.tree.codes))
                    logs, here = charge.of(codes[other])
                    each[other] += logs - np.log(own.tree.rest + 1.0)
                    if charge.least > 2:
                        open_ = np.zeros(len(codes), bool)
                        open_[other[~here]] = True
                        rest, ends = codes[open_], np.append(0, np.cumsum(open_))[of]
                total[n > 0] = np.add.reduceat(each, of[:-1][n > 0])
            blind = void | (own is None)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rest.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, mask=void), pa.array(total, mask=blind), lists], names=["doc_id", "n_words", "log_prob", "rest"])

    base = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    out = base.mapInArrow(run, "doc_id bigint, n_words bigint, log_prob double, rest array<bigint>")
    if charged is not None and charged.least > 2:
        out = written(out.withColumn("key", F.monotonically_increasing_id()), "scored")
        rarer = counted.where(~F.col("context") & (F.col("n") < charged.least) & (F.col("n") > 1)).select("code", "n")
        more = out.select("key", F.explode("rest").alias("code")).join(rarer, "code").groupBy("key").agg(F.sum(F.ln("n")).alias("more"))
        out = out.join(more, "key", "left").withColumn("log_prob", F.col("log_prob") + F.coalesce("more", F.lit(0.0)))
    bits = F.when(F.col("n_words") > 0, -F.col("log_prob") / F.lit(float(np.log(2))) / F.col("n_words"))
    return out.select("doc_id", "n_words", "log_prob", bits.alias("bits_per_word"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted = count(docs)
    return score(docs, train(docs, counted=counted), counted=counted)
