"""Near duplicates by Order MinHash, verified by banded alignment of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import U, clean, find_words, folded_hashes, matching, mix, pieces, without
from quillon.llm.components import components
from quillon.session import prepare, table, written

SIMILARITY = 0.8
SKETCHES = 48
#: (k, least words, most words): short texts need short k-mers. A text is sketched for each class that a
#: partner of its could be in.
CLASSES = ((2, 1, 16), (3, 16, 64), (4, 64, 1 << 60))
FAN = 256  # members of a bucket, or partners of a text, that meet in one task at once
BAG = 128
SLOTS = 1 << 16  # of the counts that words are ranked by


def normal_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the folded words that are more than punctuation, and each row's offsets in them."""
    words = find_words(buf, offs)
    codes = folded_hashes(buf, words)
    real = codes != 0
    of = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(real, out=of[1:])
    return codes[real], of[words.of]


def occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key has come before in the array."""
    order = np.argsort(keys, kind="stable")
    there = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = there[1:] != there[:-1]
    at = np.arange(len(keys))
    out = np.empty(len(keys), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


def sketch(codes: np.ndarray, of: np.ndarray, k: int, rows: np.ndarray, sketches: int = SKETCHES) -> np.ndarray:
    """Order MinHash of the given rows (each of one word or more): [rows, sketches].

    A k-mer carries the number of its earlier occurrences in the text. Per sketch the two labelled k-mers of
    smallest hash are taken and hashed together in the order in which they stand in the text. A text shorter
    than k is one k-mer.
    """
    n = (of[1:] - of[:-1])[rows]
    width = np.maximum(n - k + 1, 1)
    begin = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(width, out=begin[1:])
    row = np.repeat(np.arange(len(rows)), width)
    at = np.arange(begin[-1]) - begin[row]
    source = of[rows][row] + at
    padded = np.append(codes, np.zeros(k, np.uint64))
    kmer = np.zeros(begin[-1], np.uint64)
    for j in range(k):
        kmer = (kmer + np.where(at + j < n[row], padded[source + j], U(0x5BD1E995))) * U(0x9FB21C651E98DF25)
    kmer = mix(kmer)
    label = mix(kmer + occurrences(kmer ^ mix(row.astype(np.uint64) + U(1))).astype(np.uint64) * U(0xD6E8FEB86659FD93))
    out = np.empty((len(rows), sketches), np.uint64)
    starts = begin[:-1]
    rng = np.random.default_rng(71)
    for t, (odd, add) in enumerate(zip(rng.integers(0, 1 << 63, sketches, dtype=np.uint64) * U(2) + U(1), rng.integers(0, 1 << 63, sketches, dtype=np.uint64))):
        v = label * odd
        v ^= v >> U(29)
        v *= U(0xBF58476D1CE4E5B9)
        v += add
        least = np.minimum.reduceat(v, starts)
        first = np.flatnonzero(v == np.repeat(least, width))
        first = first[np.searchsorted(first, starts)]
        one = label[first]
        v[first] = np.iinfo(np.uint64).max
        least = np.minimum.reduceat(v, starts)
        second = np.flatnonzero(v == np.repeat(least, width))
        second = second[np.searchsorted(second, starts)]
        two = label[second]
        lone = width == 1
        ahead = np.where(first <= second, one, two)
        behind = np.where(lone, U(7), np.where(first <= second, two, one))
        out[:, t] = mix(mix(ahead + U(t + 1)) + behind * U(3))
    return out


def bags(codes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Counts of each row's words in BAG classes by hash, as bytes that stop at 255."""
    row = np.repeat(np.arange(len(of) - 1), np.diff(of))
    counts = np.bincount(row * BAG + (codes % U(BAG)).astype(np.int64), minlength=(len(of) - 1) * BAG)
    return np.minimum(counts, 255).astype(np.uint8).reshape(-1, BAG)


def least_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A bound that no edit distance is below, from the bags of pairs of texts: an edit takes at most one word from
    one side and one from the other."""
    more = a.astype(np.int16) - b
    up = np.maximum(more, 0).sum(1)
    return np.maximum(up, up - more.sum(1))


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, buf, offs in pieces(batches):
        codes, of = normal_words(buf, offs)
        n = of[1:] - of[:-1]
        some = np.flatnonzero(n)
        if not len(some):
            continue
        at = np.arange(len(codes)) - np.repeat(of[:-1], n)
        p1 = np.add.reduceat(mix(codes + at.astype(np.uint64) * U(0x9E3779B97F4A7C15)), of[some])
        p2 = np.add.reduceat(mix((codes ^ U(0xA5A5A5A5A5A5A5A5)) * U(0xC2B2AE3D27D4EB4F) + at.astype(np.uint64) * U(0xFF51AFD7ED558CCD)), of[some])
        bag = bags(codes, of)[some]
        for c, (k, lo, hi) in enumerate(CLASSES):
            own = np.flatnonzero((n[some] >= lo * SIMILARITY) & (n[some] <= hi / SIMILARITY))
            if not len(own):
                continue
            keys = mix(sketch(codes, of, k, some[own]) + U(c * 1000))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, SKETCHES, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
            ids = batch.column(0).take(pa.array(some[own]))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n[some[own]].astype(np.int32)), pa.array(p1[own].view(np.int64)), pa.array(p2[own].view(np.int64)), pa.array([x.tobytes() for x in bag[own]], pa.binary()), flat], names=["doc_id", "n", "p1", "p2", "bag", "keys"])


def banded_distance(a: list[int], b: list[int], limit: int) -> int:
    """Levenshtein distance of two sequences where it is at most `limit`, else limit + 1.

    Bit-parallel columns over the band of 2 * limit + 1 diagonals, in one integer of that width.
    """
    if len(a) < len(b):
        a, b = b, a
    m, n = len(a), len(b)
    if m - n > limit:
        return limit + 1
    limit = min(limit, m)
    width = 2 * limit + 2
    full = (1 << width) - 1
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | (1 << i)
    top = 1 << (width - 1)
    vp, vn = (full << (width - limit - 1)) & full, 0
    dist, start = limit, limit + 1 - width
    slack = limit + n - m + limit
    horizontal = 1 << (width - 2)
    for i in range(n):
        x = where.get(b[i], 0)
        x = (x >> start if start >= 0 else x << -start) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = vn | (full & ~(d0 | vp))
        hn = d0 & vp
        if i < m - limit:
            if not d0 & top:
                dist += 1
                if dist > slack:
                    return limit + 1
        else:
            if hp & horizontal:
                dist += 1
            if hn & horizontal:
                dist -= 1
            horizontal >>= 1
        vp = hn | (full & ~((d0 >> 1) | hp))
        vn = (d0 >> 1) & hp
        start += 1
    return min(dist, limit + 1)


def alike(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches `similarity` for two arrays of word hashes."""
    most = max(len(a), len(b))
    limit = int((1 - similarity) * most + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    head = int(differs[0]) if len(differs) else n
    a, b, n = a[head:], b[head:], n - head
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if max(len(a), len(b)) <= limit:
        return True
    codes = np.unique(np.concatenate([a, b]), return_inverse=True)[1].tolist()
    return banded_distance(codes[: len(a)], codes[len(a) :], limit) <= limit


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest identifier of each row's members with every other of a possible length."""
    for batch in batches:
        members = batch.column(0)
        flat = members.flatten()
        ids, n = flat.field("doc_id").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False)
        size = members.value_lengths().to_numpy()
        begin = np.cumsum(size) - size
        centre = np.minimum.reduceat(ids, begin)
        low = np.repeat(centre, size)
        middle = np.repeat(n[np.flatnonzero(ids == low)[np.searchsorted(np.flatnonzero(ids == low), begin)]], size)
        ok = (ids != low) & (np.minimum(n, middle) >= SIMILARITY * np.maximum(n, middle))
        yield pa.RecordBatch.from_arrays([pa.array(low[ok]), pa.array(ids[ok])], names=["a", "b"])


def crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) of a row's two lists of members (or of the one, where the other is null) that are in different groups
    and that neither lengths nor bags of words rule out. Lists are of about FAN members."""

    def columns(list_: pa.ListScalar) -> tuple[np.ndarray, ...]:
        flat = list_.values
        bag = np.frombuffer(b"".join(flat.field("bag").to_pylist()), np.uint8).reshape(-1, BAG)
        return *(flat.field(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "n", "g")), bag

    for batch in batches:
        for one, two in zip(batch.column(0), batch.column(1)):
            ids, n, group, bag = columns(one)
            if two.is_valid:
                ids2, n2, group2, bag2 = columns(two)
                left, right = (x.ravel() for x in np.meshgrid(np.arange(len(ids)), np.arange(len(ids2)), indexing="ij"))
            else:
                ids2, n2, group2, bag2 = ids, n, group, bag
                left, right = np.triu_indices(len(ids), 1)
            small_, large = np.minimum(n[left], n2[right]), np.maximum(n[left], n2[right])
            apart = (group[left] != group2[right]) & (small_ >= SIMILARITY * large - 1e-9)
            left, right, large = left[apart], right[apart], large[apart]
            for i in range(0, len(left), 1 << 14):
                x, y = left[i : i + (1 << 14)], right[i : i + (1 << 14)]
                near = least_distance(bag[x], bag2[y]) <= (1 - SIMILARITY) * large[i : i + (1 << 14)] + 1e-9
                x, y = ids[x[near]], ids2[y[near]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each text's words with the numbers of their earlier occurrences as hashes: sets that overlap as the bags of words do."""
    for batch, buf, offs in pieces(batches):
        codes, of = normal_words(buf, offs)
        row = np.repeat(np.arange(len(of) - 1), np.diff(of)).astype(np.uint64)
        yield batch, mix(codes + occurrences(codes ^ mix(row + U(1))).astype(np.uint64) * U(0xD6E8FEB86659FD93)), of


def word_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SLOTS, np.int64)
    for _, items, _ in labelled(batches):
        total += np.bincount((items % U(SLOTS)).astype(np.int64), minlength=SLOTS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["slot", "n"])


def rare_words(texts: DataFrame) -> DataFrame:
    """(doc_id, item): of each text the rarest of its labelled words, so many that two texts of the least SIMILARITY have
    one in common: they share SIMILARITY of the longer one's words, so not all of the first 1 - SIMILARITY can be missing,
    in an order that is the same for all. The order is by counts of hashed words, rarest first: SLOTS numbers."""
    counts = np.zeros(SLOTS, np.int64)
    for r in texts.mapInArrow(word_slots, "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # at most SLOTS rows
        counts[r.slot] = r.n
    shared = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, items, of in labelled(batches):
            n = np.diff(of)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((items, shared.value[(items % U(SLOTS)).astype(np.int64)], row))
            inside = np.arange(len(items)) - np.repeat(of[:-1], n)
            first = order[inside < (n - np.ceil(SIMILARITY * n - 1e-9).astype(np.int64) + 1)[row]]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), pa.array(items[first].view(np.int64))], names=["doc_id", "item"])

    return texts.mapInArrow(run, "doc_id bigint, item bigint").distinct()


def salted(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with `salt`, which parts the rows of one key by a hash of doc_id where they are more than FAN, and `salts`, how many there are."""
    large = written(rows.groupBy(*keys).agg(F.ceil(F.count("*") / FAN).alias("salts")).where("salts > 1"), "large")
    out = matching(rows, large, list(keys), "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("bigint")))
    return out.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")))


def crossed(rows: DataFrame, *keys: str) -> DataFrame:
    """Candidate pairs of rows (keys, doc_id, n, g, bag) that share the keys, block by block."""
    blocks = salted(rows, *keys).groupBy(*keys, "salt", "salts").agg(F.collect_list(F.struct("doc_id", "n", "g", "bag")).alias("one"))
    blocks = written(blocks, "blocks")
    own = blocks.where("size(one) > 1").select("one", F.lit(None).cast(blocks.schema["one"].dataType).alias("two"))
    many = blocks.where("salts > 1")
    other = many.select(*keys, F.col("salt").alias("more"), F.col("one").alias("two"))
    both = many.join(other, list(keys)).where("salt < more").select("one", "two")
    return own.unionByName(both).mapInArrow(crossings, "a bigint, b bigint").distinct()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose texts are alike. Only texts of candidates are moved; a text with many
    partners is copied to one task per FAN of them."""
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "ids")
    mine = matching(texts, ids, ["doc_id"])
    many = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).alias("salts")).where("salts > 1"), "many")
    spread = written(matching(pairs, many, ["a"], "left").select("a", "b", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(1).cast("bigint"))).alias("salt")), "spread")
    right = spread.join(mine.withColumnRenamed("doc_id", "b"), "b").select("a", "salt", "b", "text")
    left = spread.select("a", "salt").distinct().join(mine.withColumnRenamed("doc_id", "a"), "a").select("a", "salt", F.lit(None).cast("bigint").alias("b"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for batch, buf, offs in pieces(batches):
            codes, of = normal_words(buf, offs)
            good: list[tuple[int, int]] = []
            for r, (a, salt, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b")))):
                mine = codes[of[r] : of[r + 1]]
                if b is None:
                    key, own = (a, salt), mine.copy()
                elif key == (a, salt) and alike(own, mine):
                    good.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in good], pa.int64()), pa.array([y for _, y in good], pa.int64())], names=["a", "b"])

    rows = right.unionByName(left).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(check, "a bigint, b bigint").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kept_doc_id): every document of a group of near duplicates but its smallest identifier, which stays.

    Texts are sequences of lower-case words without punctuation. Two are near duplicates where their edit
    distance is at most 1 - SIMILARITY of the longer one; groups are connected components. Candidates share an
    Order MinHash sketch: of SKETCHES orders of the labelled k-mers, the two least in the order of the text. Equal word
    sequences are grouped first. Then each bucket's smallest member is aligned with the others, in parts of
    about FAN members and then among the parts' smallest, and after grouping, every pair of a bucket that is still in
    different groups and that a lower bound on the distance, from counts of words, does not rule out. In buckets of
    more than FAN such pairs must have one of their rarest words in common too, which similar texts have. So no bucket is
    cut or held in one row, a bucket of thousands of copies costs thousands of alignments, and a line that thousands
    share costs none.

    Null ids, null texts and texts without words take no part. Rows that repeat an identifier are one document,
    never copies of themselves. An empty table gives no rows. Other columns are not read.
    """
    prepare(df.sparkSession)
    texts = clean(df, id_col, text_col)
    # an identifier in several classes or rows has several rows here
    made = written(texts.mapInArrow(sketches, "doc_id bigint, n int, p1 bigint, p2 bigint, bag binary, keys array<bigint>"), "sketches")
    low = written(made.groupBy("p1", "p2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("p1", "p2", "low"), "low")
    same = written(matching(made.select("doc_id", "p1", "p2"), low, ["p1", "p2"], "inner").where("doc_id <> low").select("doc_id", "low").distinct(), "same")
    singles = matching(made, written(same.select("doc_id").distinct(), "copies"), ["doc_id"], "left_anti").select("doc_id", "n", F.explode("keys").alias("key"))
    rows = written(matching(singles, written(singles.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key"), "keys"), ["key"]).distinct(), "rows")
    buckets = written(salted(rows, "key").groupBy("key", "salt", "salts").agg(F.collect_list(F.struct("doc_id", "n")).alias("members")), "buckets")
    # each part of a bucket around its smallest member, and those around the smallest of all
    centres = buckets.where("salts > 1").select("key", F.array_min("members").alias("m")).groupBy("key", F.pmod(F.xxhash64("m.doc_id"), F.lit(FAN))).agg(F.collect_list("m").alias("members"))
    centres = written(centres.select("key", "members"), "centres")
    tops = centres.select("key", F.array_min("members").alias("m")).groupBy("key").agg(F.collect_list("m").alias("members"))
    hubs = buckets.select("members").unionByName(centres.select("members")).unionByName(tops.select("members"))
    first = written(hubs.where("size(members) > 1").mapInArrow(stars, "a bigint, b bigint").distinct(), "pairs")
    edges = written(verified(first, texts), "edges")
    groups = components(edges)
    member = matching(rows, written(groups, "groups"), ["doc_id"], "left").select("key", "doc_id", "n", F.coalesce("group_id", "doc_id").alias("g"))
    split = written(member.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), (F.count("*") > FAN).alias("large")).where("lo < hi").select("key", "large"), "split")
    bag = made.groupBy("doc_id").agg(F.min(F.struct("n", "bag")).alias("x")).select("doc_id", "x.n", "x.bag")
    full = written(matching(member, split, ["key"], "inner").join(bag, ["doc_id", "n"]), "full")
    few = crossed(full.where("not large").drop("large"), "key")
    hot = full.where("large").drop("large")
    if hot.limit(1).count():  # of large buckets, only members that have a rare word in common
        own = written(hot.select("doc_id").distinct(), "hot")
        few = few.unionByName(crossed(hot.join(written(rare_words(matching(texts, own, ["doc_id"])), "rare"), "doc_id"), "key", "item")).distinct()
    second = written(few.join(first, ["a", "b"], "left_anti"), "pairs")
    more = verified(second, texts)
    every = edges.unionByName(more).unionByName(same.select(F.col("doc_id").alias("a"), F.col("low").alias("b")))
    return components(every).select("doc_id", F.col("group_id").alias("kept_doc_id"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one document of each group of near_duplicates(), the smallest identifier.

    Rows without id or text stay, as do texts without words. Of rows that repeat an identifier all stay or all go. An
    empty table gives no rows. Other columns pass through, whatever their names.
    """
    return without(df, written(near_duplicates(df, id_col, text_col).select("doc_id"), "gone"), id_col)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
