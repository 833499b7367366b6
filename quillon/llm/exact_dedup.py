"""Exact duplicates by Patricia tries over length-and-content-hash partitions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import clean, matching, without
from quillon.session import prepare, table, written

FLUSH = 32 << 20  # bytes that the tries of a task may hold
PART = 4 << 20  # bytes of distinct texts to a partition, each of which is one trie
FAN = 256  # tasks whose copies of one text are merged at once
CLASSES = 64


def shared_prefix(a: bytes, i: int, b: bytes, j: int, most: int) -> int:
    """Length of the common prefix of a[i:] and b[j:], at most `most`, by halving on slice equality."""
    lo, step = 0, 64
    while lo < most:
        n = min(step, most - lo)
        if a[i + lo : i + lo + n] == b[j + lo : j + lo + n]:
            lo += n
            step *= 2
        elif n == 1:
            break
        else:
            most, step = lo + n, max(1, n // 2)
            if a[i + lo : i + lo + step] != b[j + lo : j + lo + step]:
                most = lo + step
    return lo


class PatriciaTrie:
    """Compressed radix trie over byte strings. A node is [source, from, to, children, owner, members]; the subtrees below
    the root are weighed, so that the heaviest can be spilled."""

    def __init__(self) -> None:
        self.root: list = [b"", 0, 0, {}, None, None]
        self.weight: dict[int, int] = {}

    @property
    def bytes(self) -> int:
        return sum(self.weight.values())

    def insert(self, key: bytes, ident: int) -> list:
        """The terminal node of key, whose owner is the smallest identifier inserted so far."""
        node, at, size, branch = self.root, 0, len(key), key[0] if key else -1
        grown = 48
        while at < size:
            child = node[3].get(key[at])
            if child is None:
                child = node[3][key[at]] = [key, at, size, {}, None, None]
                grown += size + 400  # the edge refers to the whole key
                node, at = child, size
                break
            source, lo, hi = child[0], child[1], child[2]
            same = shared_prefix(source, lo, key, at, min(hi - lo, size - at))
            if same < hi - lo:  # split the edge
                middle = [source, lo, lo + same, {source[lo + same]: child}, None, None]
                child[1] = lo + same
                node[3][key[at]] = middle
                child = middle
                grown += 400
            node, at = child, at + same
        if node[4] is None:
            node[0], node[1], node[2], node[4], node[5] = key, size - (node[2] - node[1]), size, ident, [ident]
        else:
            node[4] = min(node[4], ident)
            node[5].append(ident)
        self.weight[branch] = self.weight.get(branch, 0) + grown
        return node

    def spill(self) -> Iterator[tuple[bytes, int, list[int]]]:
        """(key, owner, members) of the heaviest subtree, which leaves the trie."""
        branch = max(self.weight, key=self.weight.get)
        del self.weight[branch]
        if branch < 0:
            top = self.root
            yield b"", top[4], top[5]
            top[4] = top[5] = None
            return
        todo = [self.root[3].pop(branch)]
        while todo:
            node = todo.pop()
            if node[4] is not None:
                yield node[0][: node[2]], node[4], node[5]
            todo += node[3].values()


def part_of(parts: int) -> Column:
    """Partition of a text by its length's class and a part of its hash."""
    length = F.length(F.bin(F.col("len").cast("bigint"))).cast("bigint")
    return F.pmod(F.col("hash"), F.lit(parts)) * CLASSES + length


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Map side: (doc_id, owner, part, len, hash, body) of each document, owner being the smallest of its copies that the trie
    holds; body is given for the owner alone. Where the tries outgrow FLUSH, the heaviest subtree is sent on."""
    schema = pa.schema([("doc_id", pa.int64()), ("owner", pa.int64()), ("part", pa.int64()), ("len", pa.int32()), ("hash", pa.int64()), ("body", pa.binary())])
    tries: dict[int, PatriciaTrie] = {}
    hashes: dict[int, int] = {}  # of the terminals, by their owners' list
    held = 0

    def out(part: int) -> pa.RecordBatch:
        rows = []
        for key, owner, members in tries[part].spill():
            code = hashes.pop(id(members))
            rows += [(m, owner, None, None, None, None) for m in set(members) if m != owner]
            rows.append((owner, owner, part, len(key), code, key))
        if not tries[part].weight:
            del tries[part]
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for ident, part, code, body in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "hash", "body"))):
            trie = tries.setdefault(part, PatriciaTrie())
            branch = body[0] if body else -1
            before = trie.weight.get(branch, 0)
            hashes[id(trie.insert(body, ident)[5])] = code
            held += trie.weight[branch] - before
            while held > FLUSH:
                heavy = max(tries, key=lambda p: max(tries[p].weight.values()))
                held -= max(tries[heavy].weight.values())
                yield out(heavy)
    while tries:
        yield out(next(iter(tries)))


def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, kept): of texts of one partition sorted by (len, hash, owner), each owner that is not the smallest of its
    text with the one that is. A partition is one trie. Where it outgrows FLUSH, the heaviest subtree is dropped: its
    texts are done, as equal ones come together, but for the one at hand, which is then put back."""
    key, trie = None, PatriciaTrie()
    for batch in batches:
        ids: list[int] = []
        kept: list[int] = []
        for part, owner, body in zip(*(batch.column(c).to_pylist() for c in ("part", "owner", "body"))):
            if part != key:
                key, trie = part, PatriciaTrie()
            first = trie.insert(body, owner)[4]
            if first != owner:
                ids.append(owner)
                kept.append(first)
            if trie.bytes > FLUSH:
                for _ in trie.spill():
                    pass
                if trie.insert(body, first)[4] != first:
                    raise AssertionError("owners are not in order")
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kept, pa.int64())], names=["doc_id", "kept"])


def agreed(texts: DataFrame, *keys: str) -> DataFrame:
    rows = texts.repartition(*keys).sortWithinPartitions(*keys, "len", "hash", "owner")
    return rows.select("part", "owner", "body").mapInArrow(owners, "doc_id bigint, kept bigint").distinct()


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id): every document whose text equals, byte for byte, that of a smaller identifier,
    with the smallest one of its group.

    Only texts whose (length, hash) is shared are looked at, and tries within each task collapse them first, so that a
    text with millions of copies is moved once per task; beyond FAN tasks those are merged in two steps. Identifiers
    go beside the texts, a row each, so no row grows with the number of copies.

    Null ids and null texts take no part. Empty texts are equal to each other; texts may be of any length. Rows that
    repeat an identifier are one document and never appear as copies of themselves; a document with several different
    texts is a copy where any of them is, of the smallest owner. An empty table gives no rows. Other columns are not
    read.
    """
    prepare(df.sparkSession)
    keyed = clean(df, id_col, text_col).select("doc_id", F.octet_length("text").alias("len"), F.xxhash64("text").alias("hash"), F.col("text").cast("binary").alias("body"))
    shared = written(keyed.groupBy("len", "hash").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("len", "hash"), "shared")
    parts = max(1, -(-int(shared.agg(F.sum("len")).first()[0] or 0) // PART))
    local = matching(keyed, shared, ["len", "hash"]).withColumn("part", part_of(parts)).mapInArrow(collapse, "doc_id bigint, owner bigint, part bigint, len int, hash bigint, body binary")
    local = written(local, "local")
    texts, members = local.where("body is not null"), local.where("body is null").select("doc_id", "owner")
    if local.rdd.getNumPartitions() > FAN:
        near = written(agreed(texts.withColumn("salt", F.pmod(F.xxhash64("owner"), F.lit(FAN))), "part", "salt"), "near")
        far = written(agreed(matching(texts, near.select(F.col("doc_id").alias("owner")).distinct(), ["owner"], "left_anti"), "part"), "far")
        steps = far.select(F.col("doc_id").alias("kept"), F.col("kept").alias("top"))
        links = written(near.join(steps, "kept", "left").select("doc_id", F.coalesce("top", "kept").alias("kept")).unionByName(far), "links")
    else:
        links = written(agreed(texts, "part"), "links")
    through = members.join(links.select(F.col("doc_id").alias("owner"), "kept"), "owner", "left").select("doc_id", F.coalesce("kept", "owner").alias("kept"))
    return through.unionByName(links).where("doc_id <> kept").groupBy("doc_id").agg(F.min("kept").alias("kept_doc_id"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df without the documents of exact_duplicates().

    Rows without id or text stay; empty texts are equal to each other, so one identifier of them stays. Of rows that
    repeat an identifier all stay or all go. An empty table gives no rows. Other columns pass through, whatever
    their names.
    """
    return without(df, written(exact_duplicates(df, id_col, text_col).select("doc_id"), "gone"), id_col)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id, min(kept) AS kept_doc_id
FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id > kept GROUP BY doc_id
"""
