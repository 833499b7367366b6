"""Incremental index: hash-partitioned sectors, fingerprints, and a stream that rebuilds only what has changed.

State below one folder: `postings/bucket=N`, `sectors/bucket=N` (artifact rows), a `journal` of the sectors that a
refresh has set out to write, and `fingerprints`, which is written last and so marks it as done. A refresh that was
interrupted leaves its journal: those of its sectors that are found written as they should be are resumed, the others
written again; overwriting a sector is idempotent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import index as ix
from quillon.session import prepare, written

BUCKETS = 32


def bucket_of(key: F.Column, buckets: int = BUCKETS) -> F.Column:
    """Sector of a member: stable, and the same on any engine that has md5."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("bigint")


def members(artifacts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, artifact_id, proof): proof changes with the content."""
    return artifacts.select(bucket_of(F.col("artifact_id"), buckets).alias("bucket"), F.col("artifact_id").cast("string").alias("artifact_id"), F.sha2(F.col("text").cast("binary"), 256).alias("proof"))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(bucket, members, fingerprint) of the sectors that have members; the order of the rows does not count.

    A fingerprint is two sums of 60-bit hashes of the members, so no sector is gathered in one place."""
    code = F.md5(F.concat_ws(":", "artifact_id", F.coalesce("proof", F.lit(""))).cast("binary"))
    part = lambda at: F.sum(F.conv(F.substring(code, at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    return rows.groupBy("bucket").agg(F.count("*").alias("members"), F.concat_ws(":", part(1), part(16)).alias("fingerprint"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(bucket, state) of sectors that are new, changed or gone."""
    a, b = now.select("bucket", F.col("fingerprint").alias("a")), before.select("bucket", F.col("fingerprint").alias("b"))
    both = a.join(b, "bucket", "full_outer")
    state = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.select("bucket", state.alias("state")).where("state is not null")


@dataclass(frozen=True)
class Coverage:
    total: int
    clean: int
    dirty: int
    rebuilding: int = 0
    completed: int = 0
    resumed: int = 0

    @property
    def mode(self) -> str:
        """sealed: nothing is open; converging: some work has been done; frontier: none yet."""
        if not self.dirty and not self.rebuilding:
            return "sealed"
        return "converging" if self.completed or self.rebuilding or self.resumed else "frontier"


def coverage_mode(dirty: F.Column, rebuilding: F.Column, completed: F.Column, resumed: F.Column) -> F.Column:
    open_ = (dirty > 0) | (rebuilding > 0)
    return F.when(~open_, "sealed").when((completed > 0) | (rebuilding > 0) | (resumed > 0), "converging").otherwise("frontier")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stored_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    if _exists(spark, f"{path}/fingerprints"):
        return written(spark.read.parquet(f"{path}/fingerprints"), "before")
    return spark.createDataFrame([], "bucket bigint, members bigint, fingerprint string")


def refresh(artifacts: DataFrame, path: str, buckets: int = BUCKETS, only: list[int] | None = None) -> Coverage:
    """Bring the stored sectors to the state of artifacts (artifact_id, kind, path, source_kind, text).

    With `only`, artifacts are all members of those sectors, and the others are left as they are and not read. Only
    dirty sectors are split into postings and written. Rows of a null id or text are skipped. `buckets` must stay the
    same for a folder; choose it so that a sector is what one task writes.
    """
    spark = prepare(artifacts.sparkSession)
    rows = artifacts.where("artifact_id is not null and text is not null").select("artifact_id", "kind", "path", "source_kind", "text").withColumn("bucket", bucket_of(F.col("artifact_id"), buckets))
    now = written(fingerprints(members(rows, buckets)), "now")
    stored = stored_fingerprints(spark, path)
    before = stored if only is None else stored.where(F.col("bucket").isin(*only))
    dirty = {r.bucket: r.state for r in changed(now, before).collect()}  # at most one row per bucket
    total = now.count() + (0 if only is None else stored.where(~F.col("bucket").isin(*only)).count())
    done = _resumed(spark, path, now, dirty)
    live = [b for b, state in dirty.items() if state != "gone" and b not in done]
    if dirty:
        spark.createDataFrame([(int(b), state) for b, state in dirty.items()], "bucket bigint, state string").coalesce(1).write.mode("overwrite").parquet(f"{path}/journal")
        if live:
            own = rows.where(F.col("bucket").isin(*live))
            for name, df in (("postings", ix.postings(own).withColumn("bucket", bucket_of(F.col("artifact_id"), buckets))), ("sectors", own)):
                df.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/{name}")
        _drop(spark, path, [f"{name}/bucket={b}" for b, state in dirty.items() if state == "gone" for name in ("sectors", "postings")])
        every = now if only is None else now.unionByName(stored.where(~F.col("bucket").isin(*only)))
        every.coalesce(1).write.mode("overwrite").parquet(f"{path}/fingerprints")
        _drop(spark, path, ["journal"])
    return Coverage(total, total - sum(s != "gone" for s in dirty.values()), 0, 0, len(dirty) - len(done), len(done))


def _resumed(spark: SparkSession, path: str, now: DataFrame, dirty: dict[int, str]) -> set[int]:
    """Dirty sectors that an interrupted refresh has written as they are to be now; only the journal's sectors are read."""
    if not dirty or not _exists(spark, f"{path}/journal") or not _exists(spark, f"{path}/sectors"):
        return set()
    begun = [r.bucket for r in spark.read.parquet(f"{path}/journal").where("state <> 'gone'").collect() if dirty.get(r.bucket, "gone") != "gone"]
    if not begun:
        return set()
    there = spark.read.parquet(f"{path}/sectors").where(F.col("bucket").isin(*begun))
    proof = F.sha2(F.col("text").cast("binary"), 256)
    found = fingerprints(there.select(F.col("bucket").cast("bigint").alias("bucket"), F.col("artifact_id").cast("string").alias("artifact_id"), proof.alias("proof")))
    return {r.bucket for r in found.join(now, ["bucket", "members", "fingerprint"], "left_semi").select("bucket").collect()}


def _drop(spark: SparkSession, path: str, names: list[str]) -> None:
    for name in names:
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def load_index(spark: SparkSession, path: str) -> ix.Index:
    """Index of all stored sectors; frequencies and totals are summed from the sectors' own."""
    rows = spark.read.parquet(f"{path}/postings")
    return ix.Index(rows, ix.document_frequency(rows), ix.totals(spark.read.parquet(f"{path}/sectors")))


def sharded_index(artifacts: DataFrame, buckets: int, terms: DataFrame | None = None) -> ix.Index:
    """One index merged from an index per bucket, of all terms or of `terms` (term) alone, which are singled out before
    the shuffle. All shards are built by one plan, grouped by bucket."""
    rows = written(ix.postings(artifacts, terms).withColumn("bucket", bucket_of(F.col("artifact_id"), buckets)), "postings")
    df = rows.groupBy("bucket", "term").agg(F.count("*").alias("df")).groupBy("term").agg(F.sum("df").alias("df"))
    per = artifacts.groupBy(bucket_of(F.col("artifact_id"), buckets).alias("bucket")).agg(F.count("*").alias("num_docs"), F.avg(F.octet_length("text").cast("double")).alias("avg_len"))
    n = F.sum("num_docs")
    return ix.Index(rows.drop("bucket"), df, per.agg(n.alias("num_docs"), F.when(n > 0, F.sum(F.col("num_docs") * F.col("avg_len")) / n).otherwise(0.0).alias("avg_len")))


def summed(rows: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """As index.summed, merged from the counts of each sector."""
    own = rows.withColumn("bucket", bucket_of(F.col("artifact_id"), buckets))
    df = own.select("bucket", F.explode("ids").alias("id")).groupBy("bucket", "id").agg(F.count("*").alias("df")).groupBy("id").agg(F.sum("df").alias("df"))
    per = own.groupBy("bucket").agg(F.count("*").alias("num_docs"), F.coalesce(F.avg(F.col("length").cast("double")), F.lit(0.0)).alias("avg_len"))
    n = F.sum("num_docs")
    return df, per.agg(n.alias("num_docs"), (F.sum(F.col("num_docs") * F.col("avg_len")) / n).alias("avg_len"))


# ------------------------------------------------------------------------------------------------------------- stream


def newest(batch: DataFrame, order: str | None = None) -> DataFrame:
    """One row of each artifact_id: the greatest in `order`, and of equals (or without it) the one of the greatest text."""
    rest = [c for c in batch.columns if c != "artifact_id"]
    key = F.struct(*([F.col(order)] if order else []), "text", *(c for c in rest if c not in ("text", order) and not isinstance(batch.schema[c].dataType, T.MapType)))
    return batch.groupBy("artifact_id").agg(F.max_by(F.struct(*rest), key).alias("m")).select("artifact_id", *(F.col(f"m.{c}").alias(c) for c in rest))


def upsert(batch: DataFrame, path: str, buckets: int = BUCKETS, order: str | None = None) -> Coverage:
    """Merge a batch of artifacts (of an id the newest row by `order`) into the stored sectors that it touches. Other
    sectors are not read."""
    spark = prepare(batch.sparkSession)
    batch = written(newest(batch.where("artifact_id is not null"), order), "batch")
    touched = [r.b for r in batch.select(bucket_of(F.col("artifact_id"), buckets).alias("b")).distinct().collect()]  # at most one row per bucket
    if not touched:
        return refresh(batch, path, buckets, [-1])
    if _exists(spark, f"{path}/sectors"):
        kept = spark.read.parquet(f"{path}/sectors").where(F.col("bucket").isin(*touched)).drop("bucket").join(batch.select("artifact_id"), "artifact_id", "left_anti")
        batch = written(kept.unionByName(batch.select(*kept.columns)), "merged")
    return refresh(batch, path, buckets, touched)


def refresh_stream(source: DataFrame, path: str, checkpoint: str, buckets: int = BUCKETS, order: str | None = None):
    """Start a stream of artifacts into the stored sectors; it takes what is there and stops. After an interruption the
    checkpoint says which batch to repeat, and repeating one changes nothing."""

    def each(batch: DataFrame, _: int) -> None:
        upsert(batch, path, buckets, order)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, events, total) of a stream or a table of events; rows later than `late` are dropped by a stream."""
    return events.where("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")

