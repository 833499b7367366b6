"""Matroska media columns: EBML elements to packet tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import prepare, table

EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1941A469, 0x1043A770}
UNKNOWN = -1


def vint(data: bytes, at: int, end: int) -> tuple[int, int]:
    """(value without its marker, next position) of a variable-length integer; UNKNOWN where all its bits are set."""
    if at >= end or not data[at]:
        raise ValueError(f"bad variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (UNKNOWN if value == (1 << 7 * n) - 1 else value), at + n


def element(data: bytes, at: int, end: int) -> tuple[int, int, int, int]:
    """(id with its marker, first byte of the body, its end, size); an unknown size reaches to `end`."""
    if at >= end or not data[at]:
        raise ValueError(f"bad element id at {at}")
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > end:
        raise ValueError(f"bad element id at {at}")
    ident = int.from_bytes(data[at : at + n], "big")
    size, body = vint(data, at + n, end)
    return ident, body, (end if size == UNKNOWN else min(body + size, end)), size


def child(data: bytes, at: int, end: int) -> tuple[int, int, int]:
    """(id, first byte of the body, its end) of an element that must end within its parent."""
    ident, lo, hi, size = element(data, at, end)
    if size != UNKNOWN and lo + size > end:
        raise ValueError(f"cut off at {at}")
    return ident, lo, hi


def laces(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose flags say lacing `kind` (0 none, 1 Xiph, 2 fixed size, 3 EBML)."""
    if kind == 0:
        return [(at, end)]
    if at >= end:
        raise ValueError(f"cut off at {at}")
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError(f"cut off at {at}")
                size += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif kind == 3 and count > 1:
        size, at = vint(data, at, end)
        sizes.append(size)
        for _ in range(count - 2):
            before = at
            raw, at = vint(data, at, end)
            bits = 7 * (at - before)
            raw = (1 << bits) - 1 if raw == UNKNOWN else raw
            sizes.append(sizes[-1] + raw - ((1 << bits - 1) - 1))
    elif kind == 2:
        if (end - at) % count:
            raise ValueError(f"frames of a fixed size do not fill the block at {at}")
        sizes = [(end - at) // count] * (count - 1)
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError(f"frames exceed the block at {at}")
        out.append((at, at + size))
        at += size
    return [*out, (at, end)]


@dataclass
class Track:
    number: int = 0
    kind: int = 0
    codec: str = ""
    duration: int = 0  # ns a frame; 0 if not said


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    start: int
    end: int
    keyframe: bool
    lace: int
    cluster: int
    block: int
    cued: bool = False


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, Track] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # (time, track, cluster position in the segment)
    error: str | None = None


def parse(data: bytes) -> Media:
    """Packets of a Matroska file in file order. What comes before a fault is kept, and the fault is in `error`."""
    media, origin = Media(), 0
    whole = 0  # where the segments say they end

    def number(a: int, b: int) -> int:
        if b - a > 8:
            raise ValueError(f"integer of over 8 bytes at {a}")
        return int.from_bytes(data[a:b], "big")

    def block(at: int, end: int, time: int, cluster: int, key: bool | None) -> None:
        begin = at
        track, at = vint(data, at, end)
        if at + 3 > end:
            raise ValueError(f"cut off at {at}")
        relative = int.from_bytes(data[at : at + 2], "big", signed=True)
        flags = data[at + 2]
        step = media.tracks[track].duration if track in media.tracks else 0
        base = (time + relative) * media.scale
        for k, (lo, hi) in enumerate(laces(data, at + 3, end, flags >> 1 & 3)):
            if not -(1 << 63) <= base + k * step < 1 << 63:
                raise ValueError(f"timestamp beyond 64 bits at {begin}")
            media.packets.append(Packet(track, base + k * step, lo, hi, bool(flags & 0x80) if key is None else key, k, cluster, begin))

    def cluster_body(at: int, end: int, open_ended: bool, start: int) -> int:
        time = 0
        while at < end:
            ident, lo, hi, size = element(data, at, end)
            if open_ended and ident in TOP:
                return at
            if size != UNKNOWN and lo + size > end:
                raise ValueError(f"cut off at {at}")
            if ident == 0xE7:
                time = number(lo, hi)
            elif ident == 0xA3:
                block(lo, hi, time, start, None)
            elif ident == 0xA0:
                inner, key = [], True
                p = lo
                try:
                    while p < hi:
                        i, a, b = child(data, p, hi)
                        if i == 0xA1:
                            inner.append((a, b))
                        elif i == 0xFB:
                            key = False
                        p = b
                finally:  # blocks before a faulty element are kept
                    for a, b in inner:
                        block(a, b, time, start, key)
            at = hi
        return at

    def track_entry(at: int, end: int) -> None:
        track = Track()
        while at < end:
            ident, lo, hi = child(data, at, end)
            if ident == 0xD7:
                track.number = number(lo, hi)
            elif ident == 0x83:
                track.kind = number(lo, hi)
            elif ident == 0x86:
                track.codec = data[lo:hi].rstrip(b"\0").decode("ascii", "replace")
            elif ident == 0x23E383:
                track.duration = number(lo, hi)
            at = hi
        media.tracks[track.number] = track

    def cue_point(at: int, end: int) -> None:
        time, places = 0, []
        while at < end:
            ident, lo, hi = child(data, at, end)
            if ident == 0xB3:
                time = number(lo, hi)
            elif ident == 0xB7:
                track = place = 0
                p = lo
                while p < hi:
                    i, a, b = child(data, p, hi)
                    track, place = (number(a, b), place) if i == 0xF7 else (track, number(a, b)) if i == 0xF1 else (track, place)
                    p = b
                places.append((track, place))
            at = hi
        media.cues += [(time, track, place) for track, place in places]

    try:
        at, end = 0, len(data)
        ident, lo, hi, _ = element(data, at, end)
        if ident != EBML:
            raise ValueError("no EBML header")
        at = hi
        while at < end:
            ident, lo, hi, size = element(data, at, end)
            if ident == SEGMENT:
                origin, at = lo, lo
                whole = max(whole, lo + size)
                continue  # its children are read in the same loop
            if size != UNKNOWN and lo + size > end and ident != CLUSTER:
                raise ValueError(f"cut off at {at}")
            if ident == INFO or ident == TRACKS or ident == CUES:
                p = lo
                while p < hi:
                    i, a, b = child(data, p, hi)
                    if i == 0x2AD7B1:
                        media.scale = number(a, b)
                    elif i == 0xAE:
                        track_entry(a, b)
                    elif i == 0xBB:
                        cue_point(a, b)
                    p = b
            elif ident == CLUSTER:
                hi = cluster_body(lo, hi, size == UNKNOWN, at - origin)
                if size != UNKNOWN and lo + size > end:
                    raise ValueError(f"cut off at {at}")
            at = hi
        if whole > end:
            raise ValueError(f"cut off at {end}")
    except ValueError as fault:
        media.error = str(fault)
    cued = {(place, track, time * media.scale) for time, track, place in media.cues}
    for p in media.packets:
        p.cued = p.lace == 0 and (p.cluster, p.track, p.timestamp_ns) in cued
    return media


# ---------------------------------------------------------------------------------------------------------- writing


def size_of(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def put(ident: int, body: bytes, width: int = 0) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_of(len(body), width) + body


def uint(ident: int, value: int, width: int = 8) -> bytes:
    return put(ident, value.to_bytes(width, "big"))


def lace(frames: list[bytes], kind: int) -> bytes:
    """Lacing header and frames; kind as in laces()."""
    if kind == 0:
        return frames[0]
    head = bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif kind == 3 and len(frames) > 1:
        head += size_of(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            gap = len(b) - len(a)
            width = next(w for w in range(1, 9) if -(1 << 7 * w - 1) < gap < (1 << 7 * w - 1) - 1)
            head += size_of(gap + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


FRAME, STEP_MS = 400, 40
PLAN = (0, 1, 1, 1, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 3, 3, 3, 3)  # the block of each frame of a cluster
KINDS = (0, 1, 3, 2)


def head() -> tuple[bytes, bytes]:
    tracks = b"".join(put(0xAE, uint(0xD7, n, 1) + uint(0x83, 17, 1) + put(0x86, b"S_TEXT/UTF8") + uint(0x23E383, STEP_MS * 1_000_000, 4)) for n in (1, 2))
    return put(EBML, put(0x4282, b"matroska")), put(INFO, uint(0x2AD7B1, 1_000_000, 4)) + put(TRACKS, tracks)


def mux(data: bytes) -> bytes:
    """data as frames of FRAME bytes (the last may be shorter), 19 to a cluster: one alone on track 1, and six each
    with Xiph, EBML and fixed-size lacing on track 2 (Xiph where the last frame is short). One frame every STEP_MS."""
    frames = [data[i : i + FRAME] for i in range(0, len(data), FRAME)]
    top, front = head()
    parts, cues, at = [front], [], len(front)
    for c in range(0, len(frames), len(PLAN)):
        own = frames[c : c + len(PLAN)]
        body = uint(0xE7, c * STEP_MS)
        j = 0
        while j < len(own):
            b = PLAN[j]
            some = own[j : j + (1 if b == 0 else 6)]
            kind = 1 if KINDS[b] == 2 and len(some[-1]) != len(some[0]) else KINDS[b]
            body += put(0xA3, bytes([0x81 if b == 0 else 0x82]) + (j * STEP_MS).to_bytes(2, "big") + bytes([(0x80 if b == 0 else 0) | kind << 1]) + lace(some, kind), 8)
            j += len(some)
        cues.append(put(0xBB, uint(0xB3, c * STEP_MS) + put(0xB7, uint(0xF7, 1, 1) + uint(0xF1, at))))
        parts.append(put(CLUSTER, body, 8))
        at += len(parts[-1])
    if cues:
        parts.append(put(CUES, b"".join(cues), 8))
    return top + put(SEGMENT, b"".join(parts), 8)


# ------------------------------------------------------------------------------------------------------- DataFrames

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("packet", pa.int64()), ("track", pa.int64()), ("codec", pa.string()), ("timestamp_ns", pa.int64()), ("byte_start", pa.int64()), ("byte_end", pa.int64()),
    ("keyframe", pa.bool_()), ("cued", pa.bool_()), ("payload_md5", pa.string()), ("error", pa.string()),
])
KIND = "doc_id bigint, packet bigint, track bigint, codec string, timestamp_ns bigint, byte_start bigint, byte_end bigint, keyframe boolean, cued boolean, payload_md5 string, error string"


def with_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text as a Matroska file of text packets.

    A null text has null media, an empty one a file without packets; a long one is one file of many clusters. Null ids
    and repeated rows are kept, each with its file; an empty table gives none; other columns are not read.
    """
    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else mux(x) for x in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "doc_id bigint, media binary")


def packets(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet of each file in the binary column media_col, without a shuffle.

    byte_start and byte_end are the payload's range in the file, payload_md5 is that of the range. Timestamps are
    in ns; the frames of a lace follow each other by the track's default duration. cued says that a cue
    point names the packet. A faulty or cut-off file gives the packets before the fault and then one row
    whose error is set and whose packet is their number; an element that ends beyond its parent, an integer of over
    8 bytes and a timestamp beyond 64 bits are faults. A null file gives no rows, an empty one an error row.
    Null ids and repeated rows are kept; an empty table gives no rows; other columns are not read.
    """
    import hashlib

    prepare(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for ident, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = data.as_py()
                if data is None:
                    continue
                media = parse(data)
                codecs = {n: t.codec for n, t in media.tracks.items()}
                rows += [(ident, i, p.track, codecs.get(p.track), p.timestamp_ns, p.start, p.end, p.keyframe, p.cued, hashlib.md5(data[p.start : p.end]).hexdigest(), None) for i, p in enumerate(media.packets)]
                if media.error:
                    rows.append((ident, len(media.packets), None, None, None, None, None, None, None, None, media.error))
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), SCHEMA)], schema=SCHEMA)

    return df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(media_col).alias("media")).mapInArrow(run, KIND)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets(with_media(table(spark, sf_dir, "documents")))


_FRONT = len(head()[0]) + 4 + 8 + len(head()[1])
#: The packets that mux() lays down, from the texts alone.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, encode(text) AS body, strlen(text) AS n FROM documents WHERE text IS NOT NULL),
f AS (SELECT rid, doc_id, body, n, unnest(range(0, (n + {FRAME - 1}) // {FRAME})) AS i, (n + {FRAME - 1}) // {FRAME} AS frames FROM d),
g AS (SELECT *, i // 19 AS c, i % 19 AS j, CASE WHEN i % 19 = 0 THEN 0 ELSE (i % 19 - 1) // 6 + 1 END AS b, least({FRAME}, n - i * {FRAME}) AS size FROM f),
h AS (SELECT *, CASE WHEN b = 0 THEN 0 ELSE (j - 1) % 6 END AS k, count(*) OVER w AS m, min(size) OVER w AS least FROM g WINDOW w AS (PARTITION BY rid, c, b)),
o AS (SELECT *, CASE
    WHEN b = 0 THEN 0
    WHEN b = 1 OR (b = 3 AND least < {FRAME} AND m > 1) THEN 1 + 2 * (m - 1)
    WHEN b = 3 THEN 1
    ELSE 1 + CASE WHEN m > 1 THEN 2 + (m - 2) ELSE 0 END END AS lacing FROM h),
s AS (SELECT *, sum(size + CASE WHEN k = 0 THEN 13 + lacing ELSE 0 END + CASE WHEN j = 0 THEN 22 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS upto FROM o)
SELECT doc_id, CAST(i AS BIGINT) AS packet, CAST(CASE WHEN b = 0 THEN 1 ELSE 2 END AS BIGINT) AS track, 'S_TEXT/UTF8' AS codec, CAST(i * {STEP_MS * 1_000_000} AS BIGINT) AS timestamp_ns,
  CAST({_FRONT} + upto - size AS BIGINT) AS byte_start, CAST({_FRONT} + upto AS BIGINT) AS byte_end, b = 0 AS keyframe, j = 0 AS cued,
  md5(body[CAST(i * {FRAME} + 1 AS BIGINT):CAST(i * {FRAME} + size AS BIGINT)]) AS payload_md5, CAST(NULL AS VARCHAR) AS error
FROM s
"""
