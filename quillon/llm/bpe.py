"""Byte-level BPE by a tree reduction over pieces of each text."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import prepare, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
AHEAD = 2  # characters after a part of PATTERN that can decide on it, but for white space, which looks for its end
LEAF = 192  # characters whose parts are found without a join
PART = 24  # bytes of a part that are merged without a join
WINDOW = 4  # tokens on either side of a seam that are encoded again at first
KEPT = 1 << 18  # parts and pairs that a worker remembers


class Codec:
    """Encoder over a vocabulary of byte strings with ranks.

    Two monoids. Over texts: a text's parts (the matches of PATTERN, each with its tokens); a join scans again from the last
    part on the left that the right could change to the first boundary that the right's own parts have too. Over the
    bytes of one part: its tokens; a join merges a window of tokens around the seam again and widens it until its
    outermost tokens are stable beside their outer neighbours, that is, until each such pair is how its own bytes are
    encoded. Tokens are those of the whole where every pair of neighbours is so.
    """

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.bytes = {rank: piece for piece, rank in self.ranks.items()}
        self.find, self.find_all = regex.compile(pattern).match, regex.compile(pattern).findall
        self.longest: dict[bytes, int] = {}  # of the pieces that begin with these four bytes
        for piece in self.ranks:
            if len(piece) > 3:
                self.longest[piece[:4]] = max(self.longest.get(piece[:4], 0), len(piece))
        self.parts: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[int, bool] = {}  # by the first << 17 | the second

    # ------------------------------------------------------------------------------------------------ bytes of a part

    def merged(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a few bytes: of all neighbours whose union is a piece the lowest-ranked, leftmost, are merged, and so on."""
        rank = self.ranks.get
        whole = rank(data)
        if whole is not None:
            return (whole,)
        if len(data) > 8 * PART:
            return self.merged_by_heap(data)
        cut = list(range(len(data) + 1))
        none = 1 << 60
        score = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while score:
            least = min(score)
            if least == none:
                break
            i = score.index(least)
            del cut[i + 1], score[i]
            if i < len(score):
                score[i] = rank(data[cut[i] : cut[i + 2]], none)
            if i:
                score[i - 1] = rank(data[cut[i - 1] : cut[i + 1]], none)
        return tuple([self.ranks[data[a:b]] for a, b in zip(cut, cut[1:])])

    def merged_by_heap(self, data: bytes) -> tuple[int, ...]:
        """merged() of a long window, with the neighbours in a heap."""
        rank, n = self.ranks.get, len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # begins of the next and the last run; a dead run has none before
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1") * n
        while heap:
            _, i, end = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or after[j] != end:
                continue
            alive[j] = 0
            after[i] = end
            if end < n:
                before[end] = i
                if (r := rank(data[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            h = before[i]
            if h >= 0 and (r := rank(data[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[data[i : after[i]]])
            i = after[i]
        return tuple(out)

    def stable(self, a: int, b: int) -> bool:
        """Whether tokens a and b may stand side by side: the encoding of their bytes is a, b."""
        key = a << 17 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= KEPT:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.bytes[a] + self.bytes[b]) == (a, b)
        return known

    def join_tokens(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Tokens of two neighbouring byte strings from the tokens of each."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = max(0, len(left) - WINDOW), min(len(right), WINDOW)
        while True:
            middle = self.merged(b"".join([self.bytes[t] for t in (*left[i:], *right[:j])]))
            far = i == 0 or self.stable(left[i - 1], middle[0])
            near = j == len(right) or self.stable(middle[-1], right[j])
            if far and near:
                return left[:i] + middle + right[j:]
            if not far:
                i = max(0, len(left) - 4 * (len(left) - i))
            if not near:
                j = min(len(right), 4 * j)

    def spelled(self, data: bytes) -> tuple[int, ...]:
        """Tokens of a few bytes: those pieces that spell them of which each two neighbours are stable. A prefix has one
        such spelling alone, so a place from which none goes on is never tried again."""
        n, rank, longest, known = len(data), self.ranks.get, self.longest.get, self.pairs.get
        if (whole := rank(data)) is not None:
            return (whole,)
        out: list[int] = []
        begins: list[int] = []
        at, last, dead = 0, -1, set()
        end = min(n - 1, longest(data[:4], 3))
        while at < n:
            while end > at:
                token = rank(data[at:end])
                if token is not None and end not in dead:
                    if last < 0:
                        break
                    ok = known(last << 17 | token)
                    if self.stable(last, token) if ok is None else ok:
                        break
                end -= 1
            if end > at:
                out.append(token)
                begins.append(at)
                at, last = end, token
                end = min(n, at + longest(data[at : at + 4], 3))
            else:
                dead.add(at)
                end = at - 1
                at = begins.pop()
                out.pop()
                last = out[-1] if out else -1
        return tuple(out)

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of the bytes of one part, its halves encoded recursively."""
        if len(data) <= PART:
            return self.spelled(data)
        middle = len(data) // 2
        return self.join_tokens(self.encode_bytes(data[:middle]), self.encode_bytes(data[middle:]))

    def part(self, text: str) -> tuple[int, ...]:
        known = self.parts.get(text)
        if known is None:
            known = self.encode_bytes(text.encode())
            if len(text) <= PART:
                if len(self.parts) >= KEPT:
                    self.parts.clear()
                self.parts[text] = known
        return known

    # ------------------------------------------------------------------------------------------------ parts of a text

    def leaf(self, text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, ...]]]:
        """(ends, tokens) of the parts of text[lo : hi] as a text of its own."""
        known, part = self.parts.get, self.part
        parts = self.find_all(text, lo, hi)
        ends = list(accumulate(map(len, parts), initial=lo))
        return ends[1:], [known(own) or part(own) for own in parts]

    def tree(self, text: str, lo: int, hi: int, leaf: int) -> tuple[list[int], list[tuple[int, ...]]]:
        if hi - lo <= leaf:
            return self.leaf(text, lo, hi)
        middle = (lo + hi) // 2
        return self.join(text, lo, middle, hi, self.tree(text, lo, middle, leaf), self.tree(text, middle, hi, leaf))

    def join(self, text: str, lo: int, middle: int, hi: int, left: tuple[list, list], right: tuple[list, list]) -> tuple[list, list]:
        """Parts of text[lo : hi] from those of text[lo : middle] and text[middle : hi]; the lists of left are reused."""
        ends, tokens = left
        if not ends:
            return right
        if middle == hi:
            return left
        # a part is final where what follows it on the left decides on it and is not white space up to the seam
        last = middle
        while last > lo and text[last - 1].isspace():
            last -= 1
        last = min(last, middle - AHEAD)
        keep = len(ends)
        while keep and ends[keep - 1] > last:
            keep -= 1
        at = ends[keep - 1] if keep else lo
        old = {}  # parts that reach the seam, by their begin: their tokens may be joined instead of made anew
        if keep < len(ends):
            old[ends[-2] if len(ends) > 1 else lo] = tokens[-1]
        del ends[keep:], tokens[keep:]
        k, (right_ends, right_tokens) = 0, right
        find, part = self.find, self.part
        while at < hi:
            end = find(text, at, hi).end()
            if at in old and end > middle and right_ends[0] == end:
                tokens.append(self.join_tokens(old[at], right_tokens[0]))
            else:
                tokens.append(part(text[at:end]))
            ends.append(end)
            at = end
            while k < len(right_ends) and right_ends[k] < at:
                k += 1
            if k < len(right_ends) and right_ends[k] == at:  # from a common boundary on, what follows alone decides
                ends += right_ends[k + 1 :]
                tokens += right_tokens[k + 1 :]
                break
        return ends, tokens

    def encode(self, text: str, leaf: int = LEAF) -> list[int]:
        """Token ids of text: its halves are encoded on their own, recursively, and joined."""
        return list(chain.from_iterable(self.tree(text, 0, len(text), leaf)[1]))

    def decode(self, ids: list[int], leaf: int = LEAF) -> bytes:
        """Bytes of the ids: those of the halves, joined up the tree."""
        if len(ids) <= leaf:
            return b"".join([self.bytes[t] for t in ids])
        middle = len(ids) // 2
        return self.decode(ids[:middle], leaf) + self.decode(ids[middle:], leaf)


_codecs: dict[bytes, Codec] = {}


def codec(vocabulary: bytes | None = None) -> Codec:
    """The codec of a vocabulary file's content; a worker keeps the one it used last."""
    if vocabulary is None:
        vocabulary = content(VOCABULARY)
    key = hashlib.md5(vocabulary).digest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, tokens, decoded_md5) of every row of df, in one pass without a shuffle.

    decoded_md5 is that of the bytes that decoding gives back. A null text gives nulls, an empty one no tokens.
    Strings of special tokens are ordinary text. Null ids and repeated rows are kept as they are. Of pairs of equal rank
    the leftmost is merged first. A text of any length goes up the tree. An empty table gives no rows. Other columns
    are not read. The vocabulary is read by the driver and sent to the tasks.
    """
    shared = prepare(df.sparkSession).sparkContext.broadcast(content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                ids, sums = [], []
                for text in batch.column(1).to_pylist():
                    made = None if text is None else own.encode(text)
                    ids.append(made)
                    sums.append(None if made is None else hashlib.md5(own.decode(made)).hexdigest())
                void = np.array([x is None for x in ids])
                sizes = np.array([0 if x is None else len(x) for x in ids], np.int64)
                offsets = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(void, False))
                flat = np.fromiter(chain.from_iterable(x for x in ids if x is not None), np.int32, int(sizes.sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, mask=void), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(sums, pa.string())], names=["doc_id", "n_tokens", "tokens", "decoded_md5"])

    base = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id bigint, n_tokens bigint, tokens array<int>, decoded_md5 string")


def decode_documents(df: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of rows of token ids; null tokens give a null text, and bytes that are no UTF-8 the replacement sign.
    Null ids and repeated rows are kept; no tokens give an empty text, an empty table no rows."""
    shared = prepare(df.sparkSession).sparkContext.broadcast(content(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value)
        for batch in batches:
            texts = [None if t is None else own.decode(t).decode("utf-8", "replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    base = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(tokens_col).cast("array<int>").alias("tokens"))
    return base.mapInArrow(run, "doc_id bigint, text string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
