"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import find_words, pieces
from quillon.session import prepare, table, written

CAPACITY = 2048
GROUP = 512
BLOCK = 4096  # copies of one (id, length) that are numbered as one
PACKED = ["window_id", "position", "doc_id", "piece", "start_token", "end_token", "n_tokens"]


def difference(sizes: np.ndarray, windows: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (window of each item, sums of the windows).

    A partial partition is a vector of `windows` sums in falling order. The two with the widest spread are
    merged, the largest sums of one with the smallest of the other, until one is left.
    """
    n = len(sizes)
    if windows == 1:
        return np.zeros(n, np.int64), np.array([sizes.sum()])
    sums: list[np.ndarray] = []
    made: list[tuple[int, int, np.ndarray, np.ndarray] | None] = []
    heap: list[tuple[int, int]] = []
    for i, size in enumerate(sizes.tolist()):
        v = np.zeros(windows, np.int64)
        v[0] = size
        sums.append(v)
        made.append(None)
        heap.append((-size, i))
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        made.append((a, b, order, windows - 1 - order))
        sums[a] = sums[b] = total[:0]
        sums.append(total)
        heapq.heappush(heap, (int(total[-1] - total[0]), len(sums) - 1))
    where = np.zeros(n, np.int64)
    names: dict[int, np.ndarray] = {len(sums) - 1: np.arange(windows)}
    for node in range(len(sums) - 1, -1, -1):
        label = names.pop(node)
        if made[node] is None:
            where[node] = label[0]
            continue
        a, b, left, right = made[node]
        for child, order in ((a, left), (b, right)):
            own = np.empty(windows, np.int64)
            own[order] = label
            names[child] = own
    return where, sums[-1]


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item, none above capacity. The count starts at the least possible and rises while
    differencing leaves a window over capacity; one item per window always fits."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return np.zeros(0, np.int64)
    full = sizes >= capacity  # fill a window each
    rest = np.flatnonzero(~full)
    out = np.zeros(len(sizes), np.int64)
    out[full] = np.arange(full.sum())
    if len(rest):
        count = max(1, -(-int(sizes[rest].sum()) // capacity))
        while True:
            where, sums = difference(sizes[rest], min(count, len(rest)))
            if sums.max() <= capacity or count >= len(rest):
                break
            count += max(1, count // 100)
        out[rest] = where + full.sum()
    return out


def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in pieces(batches):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(find_words(buf, offs).count)], names=["doc_id", "n"])


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """(window_id, position, doc_id, piece, start_token, end_token, n_tokens): every word of every document
    in exactly one window of at most `capacity` words.

    A document longer than a window is cut into full windows and a rest. Rows are first counted by (id, length), and
    the copies of one such pair numbered; pieces are then spread by a hash of (id, piece, end, copy) over buckets of about
    `group`, each packed on its own. So work is linear, only ids, lengths and counts are shuffled, a pair that is a
    large share of all rows is spread evenly, and results do not depend on the partitioning of the input.

    Null and empty texts have no words and give no rows; rows with a null id are packed too and keep the null.
    Repeated rows are packed each. Pieces of equal length go in the order of (id, piece), null ids last; equal sums in the order
    in which their windows were made. Texts may be of any length. An empty table gives no rows. Other columns are not
    read.
    """
    prepare(df.sparkSession)
    base = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sized = written(base.mapInArrow(lengths, "doc_id bigint, n bigint").where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("copies")), "lengths")
    parts = F.floor((F.col("n") - 1) / capacity) + 1
    count, most = sized.agg(F.sum(parts * F.col("copies")), F.max("copies")).first()
    buckets = max(1, -(-int(count or 0) // group))
    rows = lambda of, name: F.explode(F.sequence(F.lit(0).cast("bigint"), of - 1)).alias(name)
    if (most or 0) > BLOCK:  # copies are numbered in blocks, which tasks share
        blocks = sized.select("doc_id", "n", "copies", rows(F.ceil(F.col("copies") / BLOCK), "block")).repartition("doc_id", "n", "block")
        here = F.least(F.lit(BLOCK).cast("bigint"), F.col("copies") - F.col("block") * BLOCK)
        each = blocks.select("doc_id", "n", "block", rows(here, "k")).select("doc_id", "n", (F.col("block") * BLOCK + F.col("k")).alias("copy"))
    else:
        each = sized.select("doc_id", "n", rows(F.col("copies"), "copy"))
    cut = each.select("doc_id", "n", "copy", rows(parts, "piece")).select(
        "doc_id", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.col("n"), (F.col("piece") + 1) * capacity).alias("end_token"), "copy"
    )

    def packed(rows: pa.Table) -> pa.Table:
        ids = rows["doc_id"].combine_chunks()
        start, end, piece = (rows[c].to_numpy() for c in ("start_token", "end_token", "piece"))
        size = end - start
        order = np.lexsort((end, piece, ids.fill_null(np.iinfo(np.int64).max).to_numpy(), -size))
        where, parts = np.empty(len(order), np.int64), max(1, len(order) // (2 * group))
        for k in range(parts):  # a bucket that chance has filled is packed in parts, as differencing holds items times windows
            own = order[k::parts]
            where[k::parts] = pack(size[own], capacity) * parts + k
        by = np.argsort(where, kind="stable")
        window = np.unique(where[by], return_inverse=True)[1]
        position = np.arange(len(by)) - np.searchsorted(window, window)
        take = order[by]
        columns = [rows["bucket"].to_numpy()[take] * np.int64(1 << 24) + window, position, ids.take(pa.array(take)), piece[take], start[take], end[take], size[take]]
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=PACKED)

    keyed = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "end_token", "copy"), F.lit(buckets)))
    return keyed.groupBy("bucket").applyInArrow(packed, ", ".join(f"{c} bigint" for c in PACKED))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
