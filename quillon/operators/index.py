"""Term statistics: postings, document frequencies and corpus totals, computed on the fly or stored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import WORD_BREAK
from quillon.session import prepare

BUCKETS = 32


def term_rows(artifacts: DataFrame) -> DataFrame:
    """(artifact_id, length, term): one row per token occurrence; length is in bytes."""
    words = F.explode(F.split(F.lower("text"), WORD_BREAK)).alias("term")  # empty ones go after this, as a filter of the array would be interpreted
    return artifacts.select("artifact_id", F.octet_length("text").cast("bigint").alias("length"), words).where("term <> ''")


def postings(artifacts: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, artifact_id, length, tf) of all terms, or of those in `terms` (term), which are singled out before the shuffle."""
    rows = term_rows(artifacts)
    if terms is not None:
        rows = rows.join(terms, "term", "left_semi")
    return rows.groupBy("artifact_id", "length", "term").agg(F.count("*").alias("tf"))


def counted(artifacts: DataFrame, terms: pa.Array) -> DataFrame:
    """(artifact_id, length, ids, tfs): how often each artifact has which of `terms` (by number); every artifact is a row, and nothing is shuffled."""
    shared = prepare(artifacts.sparkSession).sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(shared.value)
        for batch in batches:
            words = batch.column(2)
            at = pc.index_in(words.flatten(), value_set=shared.value)
            known = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
            sizes = pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(words), dtype=np.int64), sizes)[known]
            cells, tf = np.unique(row * n + at.fill_null(0).to_numpy(zero_copy_only=False)[known], return_counts=True)
            ends = pa.array(np.searchsorted(cells // max(n, 1), np.arange(len(words) + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (cells % max(n, 1), tf)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], names=["artifact_id", "length", "ids", "tfs"])

    own = artifacts.select("artifact_id", F.octet_length("text").cast("bigint").alias("length"), F.split(F.lower("text"), WORD_BREAK).alias("words"))
    return own.mapInArrow(run, f"artifact_id {dict(artifacts.dtypes)['artifact_id']}, length bigint, ids array<int>, tfs array<int>")


def tallied(artifacts: DataFrame) -> DataFrame:
    """postings() of artifacts whose identifiers do not repeat: each text is counted where it is read, and nothing is shuffled."""
    prepare(artifacts.sparkSession)
    kind = artifacts.schema["artifact_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                words = batch.column(2)
                coded = pc.dictionary_encode(words.flatten())
                names, n = coded.dictionary, max(len(coded.dictionary), 1)
                row = np.repeat(np.arange(len(words), dtype=np.int64), pc.fill_null(words.value_lengths(), 0).to_numpy(zero_copy_only=False))
                cells, tf = np.unique(row * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                at, term = pa.array(cells // n), names.take(pa.array(cells % n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), term, pa.array(tf, pa.int64())], names=["artifact_id", "length", "term", "tf"])

    own = artifacts.select("artifact_id", F.octet_length("text").cast("bigint").alias("length"), F.split(F.lower("text"), WORD_BREAK).alias("words"))
    return own.mapInArrow(run, f"artifact_id {kind}, length bigint, term string, tf bigint").where("term <> ''")


def repeated(rows: DataFrame, *key: str) -> bool:
    return bool(rows.groupBy(*key).count().where("count > 1").head(1))


def summed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, df) and (num_docs, avg_len) of counted rows."""
    return rows.select(F.explode("ids").alias("id")).groupBy("id").agg(F.count("*").alias("df")), rows.agg(F.count("*").alias("num_docs"), F.avg(F.col("length").cast("double")).alias("avg_len"))


def totals(artifacts: DataFrame) -> DataFrame:
    """One row (num_docs, avg_len); without artifacts 0 and 0."""
    return artifacts.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg(F.octet_length("text").cast("double")), F.lit(0.0)).alias("avg_len"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(term, df) of postings."""
    return rows.groupBy("term").agg(F.count("*").alias("df"))


@dataclass
class Index:
    """Postings with their length, terms with their df, and totals."""

    postings: DataFrame
    frequency: DataFrame
    totals: DataFrame


def build(artifacts: DataFrame, terms: DataFrame | None = None) -> Index:
    rows = postings(artifacts, terms)
    return Index(rows, document_frequency(rows), totals(artifacts))


def merge(shards: list[Index]) -> Index:
    """One index of several over disjoint artifacts: frequencies and counts are summed, the mean length is recomputed."""
    first, *rest = shards
    rows, df, tot = first.postings, first.frequency, first.totals
    for s in rest:
        rows, df, tot = rows.unionByName(s.postings), df.unionByName(s.frequency), tot.unionByName(s.totals)
    df = df.groupBy("term").agg(F.sum("df").alias("df"))
    n = F.sum("num_docs")
    tot = tot.agg(n.alias("num_docs"), F.when(n > 0, F.sum(F.col("num_docs") * F.col("avg_len")) / n).otherwise(0.0).alias("avg_len"))
    return Index(rows, df, tot)


def save(index: Index, path: str) -> None:
    """Write an index. Postings are clustered by term, so that a read by terms skips row groups."""
    _save_postings(index.postings, path)
    index.frequency.write.mode("overwrite").parquet(f"{path}/frequency")
    index.totals.write.mode("overwrite").parquet(f"{path}/totals")


def _save_postings(rows: DataFrame, path: str) -> None:
    """A folder's terms are parted over several tasks, each of which has all rows of a term."""
    own = rows.withColumn("bucket", _folder(F.col("term"))).repartition("bucket", F.pmod(F.hash("term"), F.lit(32)))
    own.sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def of_terms(rows: DataFrame, terms: DataFrame, most: int = 2000) -> DataFrame:
    """postings of the terms, where those are few and the postings are stored: only their folders and row groups are read."""
    if "bucket" not in rows.columns or dict(rows.dtypes)["bucket"] != "int":
        return rows
    names = [r.term for r in terms.select("term").distinct().limit(most + 1).collect()]
    if len(names) > most:
        return rows
    folders = [r.b for r in terms.select(_folder(F.col("term")).alias("b")).distinct().collect()]
    return rows.where(F.col("bucket").isin(*folders) & F.col("term").isin(*names))


def _folder(term: F.Column) -> F.Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def stored(artifacts: DataFrame, path: str) -> Index:
    """The index below path, made or made anew if the artifacts are not those that it was made of."""
    spark = artifacts.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/signature")
    now = signature(artifacts)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) and spark.read.parquet(f"{path}/signature").first() == now.first():
        return load(spark, path)
    _save_postings(postings(artifacts) if repeated(artifacts, "artifact_id") else tallied(artifacts), path)
    document_frequency(spark.read.parquet(f"{path}/postings")).write.mode("overwrite").parquet(f"{path}/frequency")
    totals(artifacts).write.mode("overwrite").parquet(f"{path}/totals")
    now.write.mode("overwrite").parquet(f"{path}/signature")  # last, so that it marks a whole index
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "frequency", "totals")))


def signature(artifacts: DataFrame) -> DataFrame:
    """One row (signature, artifacts): the same for the same ids and lengths in any order. A stored index is good while it holds."""
    each = F.xxhash64(F.col("artifact_id"), F.octet_length("text")).cast("decimal(38,0)")
    return artifacts.agg(F.coalesce(F.sum(each), F.lit(0).cast("decimal(38,0)")).cast("string").alias("signature"), F.count("*").alias("artifacts"))
