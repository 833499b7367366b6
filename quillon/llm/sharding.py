"""Jump consistent hashing: keys to shards without a ring table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import unused
from quillon.session import prepare, table

SHARDS, MORE = 1024, 1152


def stable_key(col: Column) -> Column:
    """60-bit key from md5 of the column's text, the same on every engine; null stays null."""
    return F.conv(F.substring(F.md5(col.cast("string").cast("binary")), 1, 15), 16, 10).cast("bigint")


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard in [0, shards) of each unsigned 64-bit key."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    out = np.zeros(len(state), np.int64)
    live, at = np.arange(len(state)), np.zeros(len(state), np.int64)
    while len(live):
        out[live] = at
        state = state * np.uint64(2862933555777941757) + np.uint64(1)
        jumped = np.floor((at + 1) * (float(1 << 31) / ((state >> np.uint64(33)) + np.uint64(1)).astype(np.float64))).astype(np.int64)
        on = jumped < shards
        live, state, at = live[on], state[on], jumped[on]
    return out


def jump_shard(key: Column, shards: int) -> Column:
    """Column form of jump(); a null key gives null."""

    @F.pandas_udf("bigint")
    def shard(k: pd.Series) -> pd.Series:
        ok = k.notna().to_numpy()
        out = np.zeros(len(k), np.int64)
        out[ok] = jump(k[ok].to_numpy().astype(np.int64).astype(np.uint64), shards)
        return pd.Series(out, dtype="Int64").where(ok)

    return shard(key)


def assign_shards(df: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, more: int | None = None) -> DataFrame:
    """(doc_id, shard[, shard_after, moved]) for every row of df, repeated rows included.

    No shuffle: a key's shard depends on the key alone. A null id has null shards and moved is null. An
    empty table gives no rows. With `more` shards a key either stays or moves to one of the new shards.
    Only the id column is read, so other columns and their names do not matter; text may be null or empty.
    """
    prepare(df.sparkSession)
    key = stable_key(F.col(id_col))
    out = df.select(F.col(id_col).alias("doc_id"), jump_shard(key, shards).alias("shard"), *([jump_shard(key, more).alias("shard_after")] if more else []))
    return out.withColumn("moved", F.col("shard") != F.col("shard_after")) if more else out


def write_sharded(df: DataFrame, path: str, id_col: str = "doc_id", shards: int = SHARDS, spread: int = 1) -> str:
    """Write df's columns below path/NAME=N, one folder for each shard; returns NAME, which is `shard` unless df has it.

    Rows of a shard go to `spread` tasks by a hash of their other columns, so that a key with a large share of all
    rows can be parted. Rows of a null id go to the folder of the null partition and keep the null. Repeated rows are
    written each. An empty table writes no shard. Texts may be null, empty or long; only the id is looked at.
    """
    prepare(df.sparkSession)
    name, part = unused(df, "shard", "part")
    rows = df.withColumn(name, jump_shard(stable_key(F.col(id_col)), shards))
    keys = [name]
    if spread > 1:
        rows, keys = rows.withColumn(part, F.pmod(F.xxhash64(*df.columns), F.lit(spread))), [name, part]
    rows.repartition(*keys).drop(part).write.partitionBy(name).parquet(path)
    return name


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"), "doc_id", SHARDS, MORE)


ORACLE = f"""
WITH RECURSIVE k AS (SELECT row_number() OVER () AS rid, doc_id, ('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT::HUGEINT AS key0 FROM documents),
j(rid, n, state, b, nxt) AS (
  SELECT rid, n, key0, CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM k, (VALUES ({SHARDS}), ({MORE})) t(n)
  UNION ALL
  SELECT rid, n, s2, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / ((s2 // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT rid, n, nxt, CAST((((state % 4294967296) * 2862933555777941757::HUGEINT) + (((state // 4294967296) * 2862933555777941757::HUGEINT) % 4294967296) * 4294967296 + 1) % 18446744073709551616 AS HUGEINT) AS s2 FROM j WHERE nxt < n)
), f AS (SELECT rid, n, max(b) AS s FROM j GROUP BY rid, n)
SELECT k.doc_id, a.s AS shard, c.s AS shard_after, a.s <> c.s AS moved
FROM k JOIN f a ON a.rid = k.rid AND a.n = {SHARDS} JOIN f c ON c.rid = k.rid AND c.n = {MORE}
"""
