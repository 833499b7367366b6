"""Vectorised text primitives over Arrow string buffers.

Words are maximal runs of bytes other than ASCII white space (9-13 and 32). Every function works on a
flat byte buffer plus offsets, so that cost is a few numpy passes per byte and no Python object per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 1 << 20
SPAN = 1 << 15
MOST = 64 << 20  # bytes that may be broadcast
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240607)
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_KEEP = np.ones(256, dtype=bool)  # of the folded form: ASCII letters, digits and all non-ASCII bytes
for _b in range(128):
    _KEEP[_b] = chr(_b).isalnum()
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _power_table(base: int, size: int) -> np.ndarray:
    out = np.ones(size, dtype=np.uint64)
    have, step = 1, base
    while have < size:
        out[have : 2 * have] = out[:have] * U(step)
        step = step * step & 0xFFFFFFFFFFFFFFFF
        have *= 2
    return out


_UP, _DOWN = _power_table(_P, 2 * SPAN), _power_table(pow(_P, -1, 1 << 64), SPAN)
_JUMP = pow(_P, SPAN, 1 << 64)


def run_hashes(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each run data[lo : hi], independent of where it stands and of its neighbours. Neither lo nor hi may fall.

    Prefix sums of SPAN bytes at a time, so that no table grows with a text.
    """
    out = np.zeros(len(lo), np.uint64)
    long = hi - lo > SPAN
    edges = np.searchsorted(lo, np.arange(0, len(data) + SPAN, SPAN))
    for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
        if a == b:
            continue
        x, y = lo[a:b] - k * SPAN, np.where(long[a:b], lo[a:b], hi[a:b]) - k * SPAN
        value = _VALUE[data[k * SPAN : k * SPAN + int(y.max())]]
        run = np.zeros(len(value) + 1, np.uint64)
        np.cumsum(value * _UP[: len(value)], out=run[1:])
        out[a:b] = (run[y] - run[x]) * _DOWN[x]
    for i in np.flatnonzero(long).tolist():
        total = 0
        for k, at in enumerate(range(int(lo[i]), int(hi[i]), SPAN)):
            part = data[at : min(at + SPAN, int(hi[i]))]
            total += int((_VALUE[part] * _UP[: len(part)]).sum(dtype=np.uint64)) * pow(_JUMP, k, 1 << 64)
        out[i] = U(total & 0xFFFFFFFFFFFFFFFF)
    return mix(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer of 64-bit values (splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def flat(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = array.buffers()
    if len(array) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches cut by rows so that each holds about `limit` bytes of text (one longer row stays whole)."""
    for batch in batches:
        buf, offs = flat(batch.column(batch.schema.get_field_index(text)))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offs, offs[row] + limit, side="right")) - 1
            end = min(max(end, row + 1), batch.num_rows)
            yield batch.slice(row, end - row), buf[offs[row] : offs[end]], offs[row : end + 1] - offs[row]
            row = end


@dataclass
class Words:
    start: np.ndarray  # byte positions in the buffer
    end: np.ndarray
    of: np.ndarray  # row r has words of[r] : of[r + 1]

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.of)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.count)


def told(buf: np.ndarray, by: np.ndarray) -> np.ndarray:
    """by[buf] of a table of 256 single bytes, without an index of eight bytes to each."""
    return np.frombuffer(bytearray(buf).translate(by.tobytes()), by.dtype)


def find_words(buf: np.ndarray, offs: np.ndarray) -> Words:
    if not len(buf):
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64))
    ink = ~told(buf, _SPACE)
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    begins = offs[:-1][offs[:-1] < len(buf)]
    first[begins] = ink[begins]
    last = ink.copy()
    last[:-1] &= ~ink[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = ink[ends]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, offs))


def word_hashes(buf: np.ndarray, words: Words) -> np.ndarray:
    """64-bit hash of each word's bytes, independent of where the word stands."""
    return run_hashes(buf, words.start, words.end)


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the two-byte Latin-1 capitals, in place of the same length."""
    out = told(buf, _FOLD)
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    of = buf[at]
    out[at[(of >= 0x80) & (of <= 0x9E) & (of != 0x97)]] += 32
    return out


def folded_hashes(buf: np.ndarray, words: Words, front: int | None = None) -> np.ndarray:
    """Hash of each word in lower case without ASCII punctuation, or of its first `front` bytes; 0 where nothing is left."""
    if not len(words.start):
        return np.zeros(0, np.uint64)
    low = fold(buf)
    keep = told(low, _KEEP)
    at = np.zeros(len(buf) + 1, np.int32 if len(buf) < 1 << 31 else np.int64)
    np.cumsum(keep, out=at[1:])
    lo, hi = at[words.start].astype(np.int64), at[words.end].astype(np.int64)
    return run_hashes(low.compress(keep), lo, hi if front is None else np.minimum(hi, lo + front))


def clean(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), whatever else df has; rows without id or text are out."""
    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these that df has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, most: int = MOST) -> bool:
    """Whether all of df (a written table) takes at most about `most` bytes in memory. Rows and the bytes of their
    strings and arrays are summed up, so the bound holds whatever the rows hold."""
    wide = F.lit(0)
    for f in df.schema:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            wide = wide + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif isinstance(f.dataType, T.ArrayType):
            inner = f.dataType.elementType
            wide = wide + F.greatest(F.size(f.name), F.lit(0)) * (8 * (len(inner) + 1) if isinstance(inner, T.StructType) else 8)
    rows, body = df.agg(F.count("*"), F.sum(wide)).first()
    return rows * (24 + 8 * len(df.columns)) + (body or 0) <= most


def matching(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Join that broadcasts keys (a written table) while it is small, and shuffles beyond that."""
    return df.join(F.broadcast(keys) if small(keys) else keys, on, how)


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """df without the rows whose id_col is in ids (a written table of one column); rows with a null id stay."""
    (name,) = unused(df, "gone")
    ids = ids.toDF(name)
    return df.join(F.broadcast(ids) if small(ids) else ids, F.col(id_col) == F.col(name), "left_anti")
