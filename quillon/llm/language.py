"""Language identification by unigram pieces, summed over all segmentations."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm.common import find_words, flat, fold, pieces, run_hashes
from quillon.session import prepare, table, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 400  # labelled documents per language that the classifier is fitted on
ROUNDS = 4
LONG = 64  # bytes without a place where pieces must end, beyond which a stretch is summed on its own
CASE = 0.1  # chance that a word with capitals is counted in lower case
SCALE = 10.0  # per byte, so that sums neither vanish nor overflow
MARK = 32  # the sign that begins a word; words have no white space of their own
#: A document is rejected where its likeness() to its best language is below that language's median in fitting by more than SPREAD median absolute deviations (scaled to a standard deviation), which a minority of mislabelled documents hardly moves.
SPREAD = 40.0
LEAST_DEVIATION = 0.03
ALLOWED = 20.0  # log-probability that a text may lack beside that: a few words are no evidence

_LETTER = np.ones(256, bool)
for _b in range(128):
    _LETTER[_b] = chr(_b).isalpha()


@dataclass
class Pieces:
    """The vocabulary as a double-array trie over bytes: from state s by byte b to base[s] + b, if check of that is s.
    State 0 is the root. piece[s] is -1 or an index; size[i] is the length of piece i."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray
    size: np.ndarray

    @property
    def depth(self) -> int:
        return int(self.size.max())


def load_pieces(path: str = VOCABULARY) -> Pieces:
    """All pieces of the vocabulary that a text can hold, and every single byte, so that each text has a segmentation.
    Runs of white space count as one, so pieces with more than a leading sign for it cannot occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            raw = model.id_to_piece(i).encode().replace("▁".encode(), bytes([MARK]))
            if bytes([MARK]) not in raw[1:]:
                words.add(raw)
    return double_array(sorted(words))


def double_array(words: list[bytes]) -> Pieces:
    nodes: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for index, word in enumerate(words):
        node = 0
        for byte in word:
            if byte not in nodes[node]:
                nodes.append({})
                nodes[node][byte] = len(nodes) - 1
            node = nodes[node][byte]
        ends[node] = index
    room = 2 * len(nodes) + 1024
    base, check, piece = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
    free = np.ones(room, bool)
    free[0] = False
    slot = np.zeros(len(nodes), np.int64)
    low = 256  # below it all is taken or left alone
    todo = [0]
    for node in todo:  # breadth first, so a node's own place is known before its children's
        if not nodes[node]:
            continue
        to = np.array(sorted(nodes[node]))
        while not free[low]:
            low += 1
        at = low
        while True:
            places = at + np.flatnonzero(free[at : at + 4096]) - to[0]
            fits = places[free[places[:, None] + to].all(1)] if len(to) > 1 else places
            if len(fits):
                break
            at += 4096
        own = int(fits[0])
        base[slot[node]] = own
        free[own + to] = False
        check[own + to] = slot[node]
        for byte, child in nodes[node].items():
            slot[child] = own + byte
            todo.append(child)
    for node, index in ends.items():
        piece[slot[node]] = index
    last = int(slot.max()) + 257
    return Pieces(base[:last], check[:last], piece[:last], np.array([len(w) for w in words]))


@dataclass
class Lattice:
    """Stretches of bytes that no piece reaches across, each a run of `length` + 1 slots from `begin`. of: each word's
    offsets in the stretches. runs: (end slots, pieces, size) of the pieces, in order of their ends within a stretch,
    each end once. long: of the stretches over LONG bytes, (stretch, offsets of the pieces by end, sizes, pieces)."""

    begin: np.ndarray
    length: np.ndarray
    of: np.ndarray
    slots: int
    runs: list[tuple[np.ndarray, np.ndarray, int]]
    long: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def lattice(data: np.ndarray, begin: np.ndarray, length: np.ndarray, pieces_: Pieces, most: int | None = None) -> Lattice:
    """data[begin : begin + length] are the words (all of data, in order). With `most`, stretches are cut after so many
    bytes, and pieces across the cuts left out, as in fitting."""
    n = len(data)
    left = (np.repeat(begin + length, length) - np.arange(n)).astype(np.int32)
    live, state = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
    starts, sizes, found = [], [], []
    for k in range(pieces_.depth):
        to = pieces_.base.take(state) + data.take(live + k)
        on = np.flatnonzero(pieces_.check.take(to) == state)
        live, state = live.take(on), to.take(on)
        hit = pieces_.piece.take(state)
        ok = np.flatnonzero(hit >= 0)
        starts.append(live.take(ok))
        found.append(hit.take(ok))
        sizes.append(np.full(len(ok), k + 1, np.int16))
        more = np.flatnonzero(left.take(live) > k + 1)
        live, state = live.take(more), state.take(more)
        if not len(live):
            break
    start, size, hit = np.concatenate(starts).astype(np.int64), np.concatenate(sizes).astype(np.int64), np.concatenate(found)
    wide = size > 1
    across = np.cumsum(np.bincount(start[wide] + 1, minlength=n + 1) - np.bincount(start[wide] + size[wide], minlength=n + 1))[:n]
    fresh = across == 0
    fresh[begin] = True
    if most:
        at = np.arange(n)
        for _ in range(2):  # cuts are counted from the stretch's own begin
            fresh |= (at - np.maximum.accumulate(np.where(fresh, at, 0))) % most == 0
        unit = np.cumsum(fresh) - 1
        inside = unit[start] == unit[start + size - 1]
        start, size, hit = start[inside], size[inside], hit[inside]
    unit = np.cumsum(fresh) - 1
    first = np.flatnonzero(fresh)
    many = np.diff(first, append=n)
    own = unit[start]
    end = start + size + own
    place = start + size - first[own]
    short = many[own] <= LONG
    key = (place * 64 + size)[short].astype(np.uint16)
    order = np.argsort(key, kind="stable")
    key = key[order]
    cuts = np.flatnonzero(np.diff(key)) + 1
    runs = [(e, h, int(k & 63)) for e, h, k in zip(np.split(end[short][order], cuts), np.split(hit[short][order], cuts), key[np.concatenate([[0], cuts])] if len(key) else [])]
    long = []
    if not short.all():
        rest = np.flatnonzero(~short)
        rest = rest[np.lexsort((place[rest], own[rest]))]
        for u in np.unique(own[rest]).tolist():
            mine = rest[np.searchsorted(own[rest], u) : np.searchsorted(own[rest], u, side="right")]
            long.append((u, np.searchsorted(place[mine], np.arange(1, many[u] + 2)), size[mine], hit[mine]))
    return Lattice(first + np.arange(len(first)), many, np.append(unit[begin], len(first)), n + len(first), runs, long)


def forward(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """Sum over all segmentations of the product of scaled piece probabilities up to each slot, but for long
    stretches. prob: [pieces, models]."""
    alpha = np.zeros((lat.slots, prob.shape[1]))
    alpha[lat.begin] = 1.0
    take = lambda a, at: np.take(a, at, axis=0, mode="clip")
    for end, piece, size in lat.runs:
        more = take(prob, piece)
        more *= take(alpha, end - size)
        more += take(alpha, end)
        alpha[end] = more
    return alpha


def chain(of: np.ndarray, size: np.ndarray, piece: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Logarithm of the forward sum of one long stretch, rescaled on the way: work in proportion to its length."""
    n, depth = len(of) - 1, int(size.max())
    alpha = np.zeros((n + 1, prob.shape[1]))
    alpha[0] = 1.0
    shift = np.zeros(prob.shape[1])
    flow = prob[piece]
    for i in range(n):
        a, b = of[i], of[i + 1]
        alpha[i + 1] = (alpha[i + 1 - size[a:b]] * flow[a:b]).sum(0)
        if i % 32 == 31:
            low = max(0, i + 2 - depth)
            top = alpha[low : i + 2].max(0)
            alpha[low : i + 2] /= top
            shift += np.log(top)
    return np.log(alpha[n]) + shift


def log_sums(lat: Lattice, prob: np.ndarray) -> np.ndarray:
    """[words, models]: logarithm of the sum over all segmentations of each word, scaled per byte."""
    last = lat.begin + lat.length
    whole = forward(lat, prob)[last]
    if lat.long:
        whole[[u for u, *_ in lat.long]] = 1.0
    out = np.log(whole)
    for u, of, size, piece in lat.long:
        out[u] = chain(of, size, piece, prob)
    return np.add.reduceat(out, lat.of[:-1]) - np.log(SCALE) * np.add.reduceat(lat.length, lat.of[:-1])[:, None]


def scaled(prob: np.ndarray, size_of: np.ndarray) -> np.ndarray:
    return prob * SCALE ** size_of[:, None]


@dataclass
class Distinct:
    """Distinct words of a chunk, each with MARK in front: data[begin : begin + length]. The first `own` stand in the
    texts, word for word as `which` says; the others are lower-case forms of those in `capital`, as `lower` says. rows: rows'
    offsets in which."""

    data: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    own: int
    which: np.ndarray
    rows: np.ndarray
    capital: np.ndarray
    lower: np.ndarray


def marked(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words buf[lo : hi] with MARK before each, and their lengths."""
    length = hi - lo + 1
    begin = np.cumsum(length) - length
    data = np.full(int(length.sum()), MARK, np.uint8)
    inside = np.arange(len(data)) - np.repeat(begin, length)
    body = inside > 0
    data[body] = buf[(np.repeat(lo, length) + inside - 1)[body]]
    return data, length


def distinct_words(buf: np.ndarray, offs: np.ndarray) -> Distinct:
    words = find_words(buf, offs)
    lo, hi = words.start, words.end
    none = np.zeros(0, np.int64)
    if not len(lo):
        return Distinct(buf[:0], none, none, 0, none, words.of, none, none)
    _, first, which = np.unique(run_hashes(buf, lo, hi), return_index=True, return_inverse=True)
    data, length = marked(buf, lo[first], hi[first])
    begin = np.cumsum(length) - length
    low = fold(data)
    capital = np.flatnonzero(np.add.reduceat(low != data, begin))
    if len(capital):
        order = np.sort(begin[capital])
        _, once, lower = np.unique(run_hashes(low, order, order + length[capital]), return_index=True, return_inverse=True)
        more = [low[begin[w] : begin[w] + length[w]] for w in capital[once].tolist()]
        data = np.concatenate([data, *more])
        length = np.append(length, length[capital[once]])
        begin = np.cumsum(length) - length
        return Distinct(data, begin, length, len(first), which, words.of, capital, len(first) + lower)
    return Distinct(data, begin, length, len(first), which, words.of, none, none)


def word_log_probs(words: Distinct, pieces_: Pieces, prob: np.ndarray) -> np.ndarray:
    """[distinct words that stand in the texts, models]: log-probability over all segmentations and both forms, a
    share of CASE for the lower-case one where the two differ."""
    out = log_sums(lattice(words.data, words.begin, words.length, pieces_), prob)
    own = out[: words.own].copy()
    own[words.capital] = np.logaddexp(own[words.capital] + np.log1p(-CASE), out[words.lower] + np.log(CASE))
    return own


def likeness(each: np.ndarray, size: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Mean log-probability per byte of the likelier half of each row's bytes: numbers, codes and names in a text of the
    language do not count against it, while a text of another language has no such half. each: of each word, of `size` bytes."""
    n = len(rows) - 1
    row = np.repeat(np.arange(n), np.diff(rows))
    rate = each / size
    order = np.lexsort((-rate, row))
    rate, size, row = rate[order], size[order], row[order]
    total = np.bincount(row, size, n)
    before = np.cumsum(size) - size - (np.cumsum(total) - total)[row]
    used = np.clip(total[row] / 2 - before, 0, size)
    return np.bincount(row, used * rate, n) / np.maximum(total / 2, 1)


def fit(texts: pa.Array, pieces_: Pieces, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Piece probabilities by expectation-maximisation over all segmentations, and the texts' likeness()."""
    words = distinct_words(*flat(texts))
    sizes = pieces_.size
    prob = np.full(len(sizes), 1.0 / len(sizes))
    if not words.own:
        return prob, np.zeros(0)
    lat = lattice(words.data, words.begin, words.length, pieces_, LONG)
    count = np.bincount(words.which, minlength=len(words.begin)).astype(float)
    count[words.lower] += CASE * count[words.capital]
    count[words.capital] *= 1 - CASE
    count = np.repeat(count, np.diff(lat.of))
    last = lat.begin + lat.length
    for _ in range(rounds):
        own = scaled(prob[:, None], sizes)
        alpha = forward(lat, own)[:, 0]
        beta = np.zeros(lat.slots)
        beta[last] = count / alpha[last]
        hits = np.zeros(len(sizes))
        for end, piece, size in reversed(lat.runs):
            flow = own[piece, 0] * beta[end]
            np.add.at(hits, piece, alpha[end - size] * flow)
            beta[end - size] += flow
        prob = hits + 0.001
        prob /= prob.sum()
    return prob, alike(texts, pieces_, prob)


def alike(texts: pa.Array, pieces_: Pieces, prob: np.ndarray) -> np.ndarray:
    """likeness() of the texts of 100 bytes or more."""
    words = distinct_words(*flat(texts))
    if not words.own:
        return np.zeros(0)
    each = word_log_probs(words, pieces_, scaled(prob[:, None], pieces_.size))[:, 0]
    size = words.length[words.which]
    nbytes = np.bincount(np.repeat(np.arange(len(texts)), np.diff(words.rows)), size, len(texts))
    return likeness(each[words.which], size, words.rows)[nbytes >= 100]


def held_out(texts: pa.Array, pieces_: Pieces) -> np.ndarray:
    """likeness() of every second text by a fit to the others, as texts that were not fitted have it."""
    odd = np.arange(len(texts)) % 2 == 1
    return alike(texts.filter(pa.array(odd)), pieces_, fit(texts.filter(pa.array(~odd)), pieces_)[0])


@dataclass
class Model:
    languages: list[str]
    pieces: Pieces
    prob: np.ndarray  # [pieces, languages], scaled
    floor: np.ndarray  # of each language


def floor_of(seen: np.ndarray) -> float | None:
    """Lowest likeness to accept, given those of the documents of a language."""
    if not len(seen):
        return None
    middle = np.median(seen)
    return float(middle - SPREAD * max(1.4826 * np.median(np.abs(seen - middle)), LEAST_DEVIATION))


def train(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = TRAIN_DOCS, vocabulary: str = VOCABULARY) -> Model | None:
    """Model of the languages named in lang_col, fitted on at most `docs` documents each (chosen by a hash of their
    ids, ties by the id). None where no row has a language and a text. Of rows that repeat an identifier all are used;
    rows of a null id, language or text are not. Empty texts add nothing."""
    spark = prepare(df.sparkSession)
    named = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("doc_id is not null and lang is not null and text is not null")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = written(named.select("lang", "doc_id").withColumn("r", rank).where(F.col("r") <= docs).select("lang", "doc_id").distinct(), "chosen")
    sample = named.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")
    loaded = load_pieces(vocabulary)
    shared = spark.sparkContext.broadcast(loaded)

    def learn(rows: pa.Table) -> pa.Table:
        order = rows["doc_id"].to_numpy().argsort(kind="stable")
        texts = rows["text"].take(pa.array(order)).combine_chunks()
        prob, seen = fit(texts, shared.value)[0], held_out(texts, shared.value)
        return pa.table({"lang": rows["lang"].slice(0, 1), "prob": pa.array([prob], pa.list_(pa.float64())), "floor": pa.array([floor_of(seen)], pa.float64())})

    fitted = sorted(sample.groupBy("lang").applyInArrow(learn, "lang string, prob array<double>, floor double").collect(), key=lambda r: r.lang)
    if not fitted:
        return None
    prob = scaled(np.array([r.prob for r in fitted]).T, loaded.size)
    floors = [r.floor for r in fitted if r.floor is not None]
    other = min(floors) if floors else -np.inf  # for a language of short documents alone
    return Model([r.lang for r in fitted], loaded, prob, np.array([other if r.floor is None else r.floor for r in fitted]))


def score(buf: np.ndarray, offs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-probability of each row under each language, the bytes that were scored (MARK included), and which rows are accepted."""
    words = distinct_words(buf, offs)
    n = len(offs) - 1
    total, nbytes, ok = np.zeros((n, len(model.languages))), np.zeros(n, np.int64), np.zeros(n, bool)
    if words.own:
        word = word_log_probs(words, model.pieces, model.prob)
        some = np.diff(words.rows) > 0
        size = words.length[words.which]
        first = words.rows[:-1][some]
        for k in range(total.shape[1]):
            total[some, k] = np.add.reduceat(word[words.which, k], first)
        nbytes[some] = np.add.reduceat(size, first)
        best = total.argmax(1)
        each = word[words.which, np.repeat(best, np.diff(words.rows))]
        letters = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(_LETTER[buf], out=letters[1:])
        floor = model.floor[best] - ALLOWED / np.maximum(nbytes / 2, 1)
        ok = (letters[offs[1:]] > letters[offs[:-1]]) & (likeness(each, size, words.rows) >= floor)
    return total, nbytes, ok


def identify(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, language, log_prob, margin, accepted) for every row of df, repeated rows and null ids included.

    log_prob is the best language's, per byte of the whole text (a run of white space counts as one byte), summed over
    all segmentations into pieces of the vocabulary; margin is its lead over the second, in all. A row is not accepted,
    and has no language, where its text is null or without letters, or where likeness() is below that language's floor. Ties go to the language first by name. With one language the margin is null; with
    no model nothing is accepted. An empty table gives no rows. No other column is read.
    """
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = "doc_id bigint, language string, log_prob double, margin double, accepted boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch, buf, offs in pieces(batches):
            n = batch.num_rows
            if own is None:
                columns = [pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(np.zeros(n, bool))]
            else:
                total, nbytes, ok = score(buf, offs, own)
                best = total.argmax(1)
                top = total[np.arange(n), best]
                per = top / np.maximum(nbytes, 1)
                some = nbytes > 0
                lead = np.sort(total, axis=1)[:, -2] if total.shape[1] > 1 else top
                columns = [
                    pa.array(np.array(own.languages, object)[best], pa.string(), mask=~ok),
                    pa.array(per, mask=~some),
                    pa.array(top - lead, mask=~some | (total.shape[1] < 2)),
                    pa.array(ok),
                ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "language", "log_prob", "margin", "accepted"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


def keep_identified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """df without the rows that identify() does not accept: those of null texts, of texts without letters, and of foreign ones.

    Rows with a null id are judged by their text too, repeated rows each. Where no row has a language and a text,
    nothing can be judged and all rows stay. An empty table gives no rows. Other columns pass through.
    """
    model = train(df, id_col, text_col, lang_col)
    spark = prepare(df.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if own is None:
            yield from batches
            return
        for batch, buf, offs in pieces(batches, text_col):
            yield batch.filter(pa.array(score(buf, offs, own)[2]))

    return df.mapInArrow(run, df.schema)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
