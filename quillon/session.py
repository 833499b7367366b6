"""Session helpers shared by every query."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent.parent)


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package even where PYTHONPATH was not set for them."""
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in known:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *known])
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: spark.checkpoint.dir, or, in local mode alone, a temporary one where it is unset."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if not said:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        said = tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", said)
    return said.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """Folder of what this application has written; nothing else uses it, so it may go when the application has ended."""
    return f"{shared_dir(spark)}/quillon-{spark.sparkContext.applicationId}"


def clean_up(spark: SparkSession) -> None:
    """Delete what written() has left, once no result is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """Cut lineage: write df as a table in the shared folder and read it back.

    The files outlive any executor, so a later failure re-reads them instead of recomputing.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lookup(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows (which are counted), else as it is for a shuffled join.

    For the query side of a search and for per-term statistics, whose rows are narrow.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def held(df: DataFrame, name: str, rows: int = 1_000_000) -> DataFrame:
    """df written once, for plans that read it more than once, and then as lookup() has it."""
    return lookup(written(df, name), rows)
