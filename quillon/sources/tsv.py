"""Readers of queries, judgements, JSON lines and evaluation tasks, and the sinks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, text) of lines `id<TAB>text`, where the text may hold tabs. Blank lines and a header are skipped."""
    lines = spark.read.text(path).where((F.trim("value") != "") & ~F.col("value").startswith("query-id\t"))
    parts = F.split("value", "\t", 2)
    return lines.where(F.size(parts) == 2).select(F.trim(parts[0]).alias("query_id"), F.trim(parts[1]).alias("text"))


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, doc_id, relevance) of lines of three columns; the last of several lines for a pair holds."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where((F.trim("value") != "") & ~F.col("value").startswith("query-id\t"))
    parts = F.split("value", "\t")
    rows = lines.where(F.size(parts) == 3).select(F.trim(parts[0]).alias("query_id"), F.trim(parts[1]).alias("doc_id"), F.try_to_number(F.trim(parts[2]), F.lit("999999999")).cast("bigint").alias("relevance"), "line")
    return rows.where("relevance >= 0").groupBy("query_id", "doc_id").agg(F.max_by("relevance", "line").alias("relevance"))


def read_corpus_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of JSON lines with _id, title and text, gzip or not; title and text are parted by an empty line."""
    raw = spark.read.schema("_id string, title string, text string").json(path)
    title = F.coalesce(F.trim("title"), F.lit(""))
    return raw.where("_id is not null").select(F.col("_id").alias("doc_id"), F.when(title == "", F.coalesce("text", F.lit(""))).otherwise(F.concat(title, F.lit("\n\n"), F.coalesce("text", F.lit("")))).alias("text"))


def read_tasks(path: str) -> list[dict]:
    """Agentic evaluation tasks; a task without a root task has its turns' queries as one."""
    with open(path, encoding="utf-8") as file:
        raw = json.load(file)
    out = []
    for task in raw["tasks"] if isinstance(raw, dict) else raw:
        turns = [{"query": t["query"], "expected_documents": list(t.get("expected_documents", []))} for t in task["turns"]]
        out.append({"id": task["id"], "root_task": task.get("root_task") or " ".join(t["query"] for t in turns), "turns": turns, "expected_final_documents": list(task.get("expected_final_documents", []))})
    return out


def without_helpers(artifacts: DataFrame, helpers: list[str]) -> DataFrame:
    """artifacts whose path is none of the files with queries and judgements."""
    spark = artifacts.sparkSession
    gone = spark.createDataFrame([(str(Path(h)),) for h in helpers], "path string")
    return artifacts.join(F.broadcast(gone), "path", "left_anti")


def write_dataset(corpus: DataFrame, queries: DataFrame, qrels: DataFrame, path: str) -> None:
    """corpus, the queries that are judged, and qrels as Parquet folders below path."""
    corpus.write.mode("overwrite").parquet(f"{path}/corpus")
    queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi").write.mode("overwrite").parquet(f"{path}/queries")
    qrels.write.mode("overwrite").parquet(f"{path}/qrels")


def write_json(hits: DataFrame, path: str) -> None:
    hits.write.mode("overwrite").json(path)


def response_json(hits: DataFrame, strategy: str) -> DataFrame:
    """(query_id, response): one JSON document per query with its hits in order."""
    each = F.struct(*[c for c in ("rank", "artifact_id", "path", "score", "confidence", "location", "snippet") if c in hits.columns])
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(each)).alias("hits")).select("query_id", F.to_json(F.struct(F.lit(strategy).alias("strategy"), "query_id", "hits")).alias("response"))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).where("__r = 1").drop("__r")
