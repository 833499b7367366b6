"""Repeated passages by compressed FM-indexes over shards of candidate windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quillon.llm.common import U, clean, find_words, flat, matching, mix, pieces, run_hashes, small, unused, word_hashes
from quillon.session import prepare, table, written

LENGTH = 50  # words
GRAM = 10
SHARD = 1 << 19  # words in one index
HOT = 4096  # documents of one hash whose windows go to one index
ASK = 16  # stretches of a window that are asked for as one


# ------------------------------------------------------------------------------------------------------ wavelet tree


class Wavelet:
    """Wavelet matrix over integers: per bit, packed words with counts before each; rank by population count."""

    def __init__(self, data: np.ndarray, largest: int):
        self.bits = max(1, int(largest).bit_length())
        self.n = len(data)
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        data = data.astype(np.int64)
        for b in range(self.bits - 1, -1, -1):
            one = (data >> b & 1).astype(bool)
            packed = np.packbits(one, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            self.words.append(packed)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1].astype(np.int32))
            self.zeros.append(int(len(one) - one.sum()))
            data = np.concatenate([data[~one], data[one]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the position of the same index."""
        lo = np.zeros(len(at), np.int64)
        hi = at.astype(np.int64)
        for level in range(self.bits):
            one = (symbol >> (self.bits - 1 - level) & 1).astype(bool)
            both = np.concatenate([lo, hi])
            word = both >> 6
            ones = self.before[level][word] + np.bitwise_count(self.words[level][word] & ((U(1) << (both & 63).astype(U)) - U(1))).astype(np.int64)
            pair = np.where(np.concatenate([one, one]), self.zeros[level] + ones, both - ones)
            lo, hi = pair[: len(at)], pair[len(at) :]
        return hi - lo


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols or more, by prefix doubling."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    h = 1
    while True:
        key = rank << 32
        key[: n - h] |= rank[h:] + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        step = np.ones(n, np.int64)
        step[0] = 0
        step[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(step)
        h *= 2
        if h >= depth or rank[order[-1]] == n - 1 or h >= n:
            return order


class Minima:
    """Smallest value of any range of an array: minima from each place to either end of its block of BLOCK, and a table of
    doubling ranges over whole blocks. It takes about four numbers a place, whatever the length."""

    BLOCK = 8

    def __init__(self, data: np.ndarray):
        n = -(-len(data) // self.BLOCK) * self.BLOCK
        self.data = np.full(n, np.iinfo(data.dtype).max, data.dtype)
        self.data[: len(data)] = data
        blocks = self.data.reshape(-1, self.BLOCK)
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel().copy()
        self.table = [blocks.min(1)]
        while 2 << len(self.table) - 1 <= len(blocks):
            step = 1 << len(self.table) - 1
            self.table.append(np.minimum(self.table[-1][:-step], self.table[-1][step:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest of data[lo : hi] for ranges that are not empty."""
        first, last = lo // self.BLOCK, (hi - 1) // self.BLOCK
        out = np.minimum(self.behind[lo], self.ahead[hi - 1])
        same = np.flatnonzero(first == last)
        if len(same):
            a, b = lo[same], hi[same]
            least = self.data[a]
            for k in range(1, self.BLOCK):
                least = np.minimum(least, self.data[np.minimum(a + k, b - 1)])
            out[same] = least
        wide = np.flatnonzero(last - first > 1)
        if len(wide):
            a, b = first[wide] + 1, last[wide]
            level = np.frexp((b - a).astype(np.float64))[1] - 1
            for k in np.unique(level).tolist():
                own = level == k
                x = np.minimum(self.table[k][a[own]], self.table[k][b[own] - (1 << k)])
                out[wide[own]] = np.minimum(out[wide[own]], x)
        return out


class FMIndex:
    """Backward search over a text of words, with the smallest and largest document of any range of suffixes."""

    def __init__(self, text: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int):
        """text: symbols below 2**31; low, high: smallest and largest document at each position, as 32-bit numbers."""
        order = suffix_array(text, depth)
        self.sigma = int(text.max()) + 1
        self.first = np.zeros(self.sigma + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=self.sigma), out=self.first[1:])
        self.bwt = Wavelet(text[order - 1], self.sigma - 1)
        self.low, self.high = Minima(low[order]), Minima(-high[order])

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes after one more symbol to the left."""
        got = self.bwt.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.first[symbol]
        return base + got[: len(lo)], base + got[len(lo) :]

    def documents(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest document of each non-empty range."""
        return self.low.of(lo, hi), -self.high.of(lo, hi)


def matched(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray, later: bool) -> np.ndarray:
    """Start of the longest text[start : end] that ends at each `end`, does not begin before `begin`, and stands in
    another document than `own` (with `later`: in a smaller one): matching statistics by backward search."""
    start = end.copy()
    live = np.arange(len(end))
    lo, hi = np.zeros(len(end), np.int64), np.full(len(end), len(text), np.int64)
    while len(live):
        live_on = start[live] > begin[live]
        live, lo, hi = live[live_on], lo[live_on], hi[live_on]
        if not len(live):
            break
        lo, hi = index.step(text[start[live] - 1], lo, hi)
        some = hi > lo
        live, lo, hi = live[some], lo[some], hi[some]
        low, high = index.documents(lo, hi)
        elsewhere = low < own[live] if later else (low != own[live]) | (high != own[live])
        live, lo, hi = live[elsewhere], lo[elsewhere], hi[elsewhere]
        start[live] -= 1
    return start


def repeats(index: FMIndex, text: np.ndarray, begin: np.ndarray, end: np.ndarray, own: np.ndarray, length: int, later: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, start, end) of the matches of `length` words or more in each window text[begin : end].

    A window is asked for in parts of ASK stretches of `length` words, side by side, so that a long window is no
    longer chain of steps than a short one. From a part's end a match is followed to the left. The word that stops
    it is then the first of the next try, whose end is the furthest to which the passage that begins there still
    matches (found by halving, since a part of a match is a match). Each try moves to the left, and none that could
    reach `length` is left out. What overlaps or touches in a window is one match in the result.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    parts = np.maximum(-(-(end - begin - length + 1) // ASK), 0)
    owner = np.repeat(np.arange(len(begin)), parts)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin, end, own = begin[owner] + turn * ASK, np.minimum(begin[owner] + (turn + 1) * ASK + length - 1, end[owner]).astype(np.int64), own[owner]
    window, at = np.arange(len(begin)), end.copy()
    while len(window):
        go = at[window] - begin[window] >= length
        window = window[go]
        if not len(window):
            break
        start = matched(index, text, begin[window], at[window], own[window], later)
        good = at[window] - start >= length
        found.append((owner[window[good]], start[good], at[window][good]))
        more = start > begin[window]
        window, start = window[more], start[more]
        # text[start - 1 : at] does not match; the largest end below at for which text[start - 1 : end] does, where
        # ends that leave no stretch of the part need not be told apart
        lo = np.maximum(start - 1, begin[window] + length - 1)
        hi = np.maximum(np.minimum(at[window] - 1, start - 1 + length), lo)
        while (lo < hi).any():
            open_ = np.flatnonzero(lo < hi)
            middle = (lo[open_] + hi[open_] + 1) // 2
            ok = matched(index, text, start[open_] - 1, middle, own[window[open_]], later) == start[open_] - 1
            lo[open_[ok]] = middle[ok]
            hi[open_[~ok]] = middle[~ok] - 1
        at[window] = lo
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    which, start, stop = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, which))
    which, start, stop = which[order], start[order], stop[order]
    shift = which * (int(stop.max(initial=0)) + 1)  # windows do not reach into each other
    reach = np.maximum.accumulate(stop + shift)
    fresh = np.ones(len(which), bool)
    fresh[1:] = start[1:] + shift[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return which[first], start[first], (reach - shift)[np.append(first[1:], len(which))[: len(first)] - 1]


# ------------------------------------------------------------------------------------------------------- candidates


def anchors(codes: np.ndarray, of: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, first, last): for each row's runs of neighbouring stretches of `length` words that have the same
    smallest GRAM (the leftmost of equals), its hash and the first and last stretch. Equal stretches have equal hashes."""
    gram = min(GRAM, length)
    span = length - gram + 1
    n = len(codes)
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    h = np.zeros(n - gram + 1, np.uint64)
    for j in range(gram):
        h = h * U(0x9E3779B97F4A7C15) + codes[j : n - gram + 1 + j]
    h = mix(h)
    least = h.copy()
    width = 1
    while width < span:  # smallest of `width` grams from each place
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    place = np.arange(len(least))
    row = np.searchsorted(of, place, side="right") - 1
    inside = place + length <= of[row + 1]
    first = inside.copy()
    first[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]) & (row[1:] == row[:-1]))
    last = inside.copy()
    last[:-1] &= ~(inside[1:] & (least[1:] == least[:-1]) & (row[1:] == row[:-1]))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return row[a], least[a], a, b


def anchor_hashes(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in pieces(batches):
            words = find_words(buf, offs)
            row, code, _, _ = anchors(word_hashes(buf, words), words.of, length)
            if len(row):
                _, once = np.unique(mix(code) + row.astype(np.uint64), return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(code[once].view(np.int64)), batch.column(0).take(pa.array(row[once]))], names=["h", "doc_id"])

    return run


def windows(length: int):
    """Rows of (doc_id, text, few, many) to windows and stretches.

    Of each anchor in `few`, the window from its first to its last stretch: (h, w, doc_id, word, char, words, chars), w being a
    hash of its bytes. The first of the equal windows of a batch has the body too, with the smallest and largest
    document of those. Of each anchor in `many`, its stretches on their own: h and w are then two hashes of a stretch's words,
    and words is 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, buf, offs in pieces(batches):
            words = find_words(buf, offs)
            codes = word_hashes(buf, words)
            row, code, a, b = anchors(codes, words.of, length)
            salt = lambda c, r: mix(c) + r.astype(np.uint64) * U(0xD6E8FEB86659FD93)
            ids = batch.column(0)
            chars = np.zeros(len(buf) + 1, np.int64)
            np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])

            def among(name: str) -> np.ndarray:
                own = batch.column(batch.schema.get_field_index(name))  # noqa: B023
                known = salt(own.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(batch.num_rows), own.value_lengths().to_numpy()))  # noqa: B023
                return np.flatnonzero(np.isin(salt(code, row), known))  # noqa: B023

            use = among("few")
            if len(use):
                yield from placed(use, row, code, a, b, words, codes, chars, buf, offs, ids, length)
            use = among("many")
            if len(use):
                yield from stretched(use, row, a, b, words, codes, chars, offs, ids, length)

    return run


WINDOWS = "h bigint, w bigint, doc_id bigint, word bigint, char bigint, words int, chars int, lo bigint, hi bigint, body string"
NAMES = [c.split()[0] for c in WINDOWS.split(", ")]


def placed(use, row, code, a, b, words, codes, chars, buf, offs, ids, length) -> Iterator[pa.RecordBatch]:
    row, code, a, b = row[use], code[use], a[use], b[use]
    count = b + length - a
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    whole = np.add.reduceat(mix(codes[at + np.repeat(a, count)] + at.astype(np.uint64) * U(0x9E3779B97F4A7C15)), np.cumsum(count) - count)
    lo, hi = words.start[a], words.end[b + length - 1]
    whole = mix(whole + run_hashes(buf, lo, hi))  # of white space too, as offsets in characters depend on it
    doc = ids.take(pa.array(row)).to_numpy()
    order = np.lexsort((doc, whole, code))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (whole[order][1:] != whole[order][:-1]) | (code[order][1:] != code[order][:-1])
    begins = np.flatnonzero(fresh)
    chosen = order[begins]
    least, most = doc[chosen], doc[order[np.append(begins[1:], len(order)) - 1]]
    rest = order[~fresh]

    def rows(at: np.ndarray) -> list[pa.Array]:
        return [pa.array(x) for x in (code[at].view(np.int64), whole[at].view(np.int64), doc[at], a[at] - words.of[row[at]], chars[lo[at]] - chars[offs[row[at]]], count[at].astype(np.int32), (chars[hi[at]] - chars[lo[at]]).astype(np.int32))]

    size = hi - lo
    for i in range(0, len(chosen), 4096):
        own = chosen[i : i + 4096]
        ends = np.cumsum(size[own])
        take = np.arange(int(ends[-1])) - np.repeat(ends - size[own], size[own]) + np.repeat(lo[own], size[own])
        body = pa.Array.from_buffers(pa.string(), len(own), [None, pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(buf[take])])
        yield pa.RecordBatch.from_arrays([*rows(own), pa.array(least[i : i + 4096]), pa.array(most[i : i + 4096]), body], names=NAMES)
    if len(rest):
        none = pa.nulls(len(rest), pa.int64())
        yield pa.RecordBatch.from_arrays([*rows(rest), none, none, pa.nulls(len(rest), pa.string())], names=NAMES)


def stretched(use, row, a, b, words, codes, chars, offs, ids, length) -> Iterator[pa.RecordBatch]:
    row, a, count = row[use], a[use], b[use] - a[use] + 1
    row = np.repeat(row, count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(a, count)
    two = []
    for odd in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):  # rolling hashes of `length` words from each place
        up = np.full(len(codes) + 1, U(odd))
        up[0] = 1
        up = np.cumprod(up)
        down = np.full(len(codes) + 1, U(pow(odd, -1, 1 << 64)))
        down[0] = 1
        down = np.cumprod(down)
        run = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mix(codes ^ U(odd)) * up[:-1], out=run[1:])
        two.append(mix((run[at + length] - run[at]) * down[at]).view(np.int64))
    lo, hi = words.start[at], words.end[at + length - 1]
    zero, none = pa.array(np.zeros(len(at), np.int32)), pa.nulls(len(at), pa.int64())
    columns = [*two, ids.take(pa.array(row)), at - words.of[row], chars[lo] - chars[offs[row]]]
    yield pa.RecordBatch.from_arrays([*(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), zero, pa.array((chars[hi] - chars[lo]).astype(np.int32)), none, none, pa.nulls(len(at), pa.string())], names=NAMES)


MATCHES = "h bigint, w bigint, doc_id bigint, a bigint, b bigint, x bigint, y bigint"


def shard_matches(parts: list[pa.RecordBatch], length: int, later: bool) -> pa.RecordBatch:
    """Repeated stretches of one shard's distinct windows (all windows of its hashes), each asked for in the name of its
    smallest document: as words [a, b) and characters [x, y) of the window."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    buf, offs = flat(rows["body"])
    code, whole = rows["h"].to_numpy(), rows["w"].to_numpy()
    ids, doc = np.unique(np.concatenate([rows["lo"].to_numpy(), rows["hi"].to_numpy()]), return_inverse=True)
    doc = doc.astype(np.int32)  # in the order of the ids; the tables of the index are of these
    order = np.lexsort((whole, code))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (whole[order][1:] != whole[order][:-1]) | (code[order][1:] != code[order][:-1])
    begins = np.flatnonzero(fresh)
    chosen = order[begins]
    low, high = np.minimum.reduceat(doc[: len(order)][order], begins), np.maximum.reduceat(doc[len(order) :][order], begins)
    words = find_words(buf, offs)
    hashes = word_hashes(buf, words)
    count = words.count[chosen]
    # text: the distinct windows, each followed by a sign of its own kind 0
    begin = np.cumsum(count + 1) - (count + 1)
    source = np.repeat(words.of[:-1][chosen] - begin, count) + np.arange(count.sum()) + np.repeat(np.arange(len(chosen)), count)
    text = np.zeros(int((count + 1).sum()), np.int64)
    body = np.ones(len(text), bool)
    body[begin + count] = False
    text[body] = np.unique(hashes[source], return_inverse=True)[1] + 1
    spread = np.repeat(np.arange(len(chosen)), count + 1)
    # windows of several documents are repeated as a whole; so, with `later`, are all but their smallest document's
    ask = np.flatnonzero(np.ones(len(chosen), bool) if later else low == high)
    w = a = b = np.zeros(0, np.int64)
    if len(ask) and len(chosen) > 1:
        index = FMIndex(text, low[spread], high[spread], length + 1)
        w, a, b = repeats(index, text, begin[ask], begin[ask] + count[ask], low[ask], length, later)
        w = ask[w]
        a, b = a - begin[w], b - begin[w]
    which = chosen[w]
    chars = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
    lo, hi = words.start[words.of[which] + a], words.end[words.of[which] + b - 1]
    base = chars[offs[which]]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (code[which], whole[which], ids[low[w]], a, b, chars[lo] - base, chars[hi] - base)], names=["h", "w", "doc_id", "a", "b", "x", "y"])


def merged(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows sorted by (h, w) with equal windows as one."""
    h, w = batch.column(0).to_numpy(), batch.column(1).to_numpy()
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    if fresh.all():
        return batch
    begins = np.flatnonzero(fresh)
    lo, hi = np.minimum.reduceat(batch.column(2).to_numpy(), begins), np.maximum.reduceat(batch.column(3).to_numpy(), begins)
    at = pa.array(begins)
    return pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lo), pa.array(hi), batch.column(4).take(at)], names=batch.schema.names)


def shards(length: int, later: bool):
    """Windows (h, w, lo, hi, body) sorted by (h, w), in indexes of about SHARD words; the windows of one hash are never
    parted. There are at most HOT of them but for equal ones, which are merged as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in map(merged, batches):
            at = 0
            code = batch.column(0).to_numpy()
            heavy = np.cumsum(batch.column(4).nbytes / max(1, batch.num_rows) / 6 * np.ones(batch.num_rows))
            while at < batch.num_rows:
                if size >= SHARD and code[at] != held[-1].column(0)[-1].as_py():
                    yield shard_matches(held, length, later)
                    held, size = [], 0
                room = int(np.searchsorted(heavy, SHARD - size + (heavy[at - 1] if at else 0))) if size < SHARD else at
                end = min(max(room, at + 1), batch.num_rows)
                while end < batch.num_rows and code[end] == code[end - 1]:
                    end += 1
                held.append(batch.slice(at, end - at))
                size += int(heavy[end - 1] - (heavy[at - 1] if at else 0)) + 1
                at = end
        if held:
            yield shard_matches(held, length, later)

    return run


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, later: bool = False) -> DataFrame:
    """(doc_id, start_word, end_word, start_char, end_char): the longest stretches of each document all of whose words
    lie in passages of `length` words or more that stand in another document too.

    With `later` only in a document of a smaller identifier: cutting those leaves one copy of every passage.
    Words are parted by ASCII white space and compared byte for byte; the white space between is not. Ends are
    exclusive. The result is exact: every passage of `length` words holds its smallest GRAM, so two equal ones
    meet in the shard of that gram's hash, and only hashes of two documents or more are moved there. Equal windows are
    moved once a batch, whoever has them. The stretches of a hash of more than HOT documents are not indexed in one
    task but compared one by one, by 128-bit hashes of their words, with the same result.

    Null ids and null texts take no part; shorter and empty texts have no passages. Rows that repeat an identifier
    are one document, whose copies do not count as repeats of each other. Repeats within one document do not count.
    An empty table gives no rows. Other columns are not read.
    """
    prepare(df.sparkSession)
    texts = clean(df, id_col, text_col)
    seen = written(texts.mapInArrow(anchor_hashes(length), "h bigint, doc_id bigint"), "anchors")
    shared = seen.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", (F.col("n") > HOT).alias("hot"))
    shared = written(shared, "shared")
    listed = matching(seen, shared, ["h"], "inner").groupBy("doc_id").agg(F.collect_set(F.when(~F.col("hot"), F.col("h"))).alias("few"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("many"))
    listed = written(listed, "hot")
    found = written(matching(texts, listed, ["doc_id"], "inner").select("doc_id", "text", "few", "many").mapInArrow(windows(length), WINDOWS), "windows")
    place = found.where("words > 0").select("h", "w", "doc_id", "word", "char", "words", "chars")
    bodies = found.where("body is not null").select("h", "w", "lo", "hi", "body")
    part = bodies.repartition("h").sortWithinPartitions("h", "w").mapInArrow(shards(length, later), MATCHES).join(place, ["h", "w", "doc_id"])
    other = (lambda df: df.where("lo < hi" + " and doc_id > lo" * later)) if later else (lambda df: df)
    several = lambda df: written(df.groupBy("h", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi"), "several")
    whole = other(matching(place, several(place), ["h", "w"], "inner"))
    lone = found.where("words = 0").select("h", "w", "doc_id", "word", "char", "chars")
    hot = other(matching(lone, several(lone), ["h", "w"], "inner"))
    reach = lambda a, b, x, y: ["doc_id", (F.col("word") + a).alias("start_word"), (F.col("word") + b).alias("end_word"), (F.col("char") + x).alias("start_char"), (F.col("char") + y).alias("end_char")]
    each = part.select(*reach(F.col("a"), F.col("b"), F.col("x"), F.col("y"))).unionByName(whole.select(*reach(F.lit(0), F.col("words"), F.lit(0), F.col("chars")))).unionByName(hot.select(*reach(F.lit(0), F.lit(length), F.lit(0), F.col("chars"))))
    # unions of overlapping or touching stretches
    by = Window.partitionBy("doc_id").orderBy("start_word", "end_word")
    before = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = each.withColumn("new", F.when(before >= F.col("start_word"), 0).otherwise(1)).withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("doc_id", "run").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.min("start_char").alias("start_char"), F.max("end_char").alias("end_char")).drop("run")


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", length: int = LENGTH) -> DataFrame:
    """df with every passage of `length` words or more kept in its smallest document only.

    The stretches that repeated_passages(later=True) reports are cut out of the texts, what is left on either side
    is joined, and length_col, where df has it, becomes the new length. A document of which no word is left goes;
    one that had none stays, as do rows without id or text. Rows that repeat an identifier keep their text. An empty
    table gives no rows. Other columns pass through, whatever their names.
    """
    key, many, cuts_col = unused(df, "id", "many", "cuts")
    cut = repeated_passages(df, id_col, text_col, length, later=True)
    cuts = cut.groupBy(F.col("doc_id").alias(key)).agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char"))).alias(cuts_col))
    twice = written(df.groupBy(F.col(id_col).alias(many)).agg(F.count("*").alias("n")).where("n > 1").select(many), "many")
    cuts = written(cuts.join(twice, F.col(key) == F.col(many), "left_anti"), "cuts")
    joined = df.join(F.broadcast(cuts) if small(cuts) else cuts, F.col(id_col) == F.col(key), "left")
    text, size = F.col(text_col), F.size(cuts_col)
    at = lambda i, name: F.try_element_at(cuts_col, i)[name].cast("int")
    # kept parts lie between the end of one cut and the start of the next
    part = lambda i: text.substr(
        F.when(i == 0, F.lit(1)).otherwise(at(i, "end_char") + 1),
        F.when(i == size, F.char_length(text)).otherwise(at(i + 1, "start_char")) - F.when(i == 0, F.lit(0)).otherwise(at(i, "end_char")),
    )
    hit = F.col(cuts_col).isNotNull()
    out = joined.withColumn(text_col, F.when(hit, F.concat_ws("", F.transform(F.sequence(F.lit(0), size), part))).otherwise(text))
    if length_col and length_col in df.columns:
        # in a projection of its own: a second copy of the lambda above beside the first reads wrong values
        out = out.withColumn(length_col, F.when(hit, F.char_length(text_col)).otherwise(F.col(length_col)).cast(df.schema[length_col].dataType))
    return out.where(~hit | F.col(text_col).rlike(r"[^ \t\n\x0B\f\r]")).select(*df.columns)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+[ \\t\\n\\r\\f\\v]*') AS parts, length(text) - length(ltrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS lead FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT doc_id, lead, i, parts[i + 1] AS part, rtrim(parts[i + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS word FROM (SELECT *, unnest(range(len(parts))) AS i FROM t)),
p AS (SELECT doc_id, i, length(word) AS n, lead + coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c,
  md5(string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING)) AS g, count(*) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {LENGTH - 1} FOLLOWING) AS m FROM w),
s AS (SELECT g FROM p WHERE m = {LENGTH} GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT doc_id, i AS a, i + {LENGTH} AS b FROM p WHERE m = {LENGTH} AND g IN (SELECT g FROM s)),
y AS (SELECT *, CASE WHEN max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= a THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM y),
r AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM z GROUP BY doc_id, run)
SELECT r.doc_id, CAST(r.a AS BIGINT) AS start_word, CAST(r.b AS BIGINT) AS end_word, CAST(f.c AS BIGINT) AS start_char, CAST(l.c + l.n AS BIGINT) AS end_char
FROM r JOIN p f ON f.doc_id = r.doc_id AND f.i = r.a JOIN p l ON l.doc_id = r.doc_id AND l.i = r.b - 1
"""
