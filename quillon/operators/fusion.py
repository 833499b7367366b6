"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.retrieve import PLACES, top

RRF_K = 60


def reciprocal(rank) -> F.Column:
    return F.lit(1.0) / (F.lit(float(RRF_K)) + rank)


def rrf(lanes: list[tuple[str, DataFrame]], shortlist: int, payload: str = "first") -> DataFrame:
    """(query_id, artifact_id, score, rank, snippet, location, contributors) of lanes in the order of the plan.

    score is the sum of 1 / (RRF_K + rank). Snippet and location are those of the first lane that has the
    artifact, even if it has none; with payload="best" those of the first lane that has a snippet.
    """
    if payload not in ("first", "best"):
        raise ValueError(f"unknown payload rule: {payload}")
    each = reduce(DataFrame.unionByName, [df.select("query_id", "artifact_id", "score", "rank", "snippet", "location", F.lit(i).alias("lane_ord"), F.lit(name).alias("lane")) for i, (name, df) in enumerate(lanes)])
    turn = F.struct(F.when(F.col("snippet").isNull() & F.lit(payload == "best"), 1).otherwise(0), F.col("lane_ord"))
    fused = each.groupBy("query_id", "artifact_id").agg(
        F.round(F.sum(reciprocal(F.col("rank"))), PLACES).alias("score"),
        F.min_by(F.struct("snippet", "location"), turn).alias("p"),
        F.transform(F.array_sort(F.collect_list(F.struct("lane_ord", "lane", F.col("score").alias("lane_score")))), lambda x: F.struct(x["lane"].alias("retriever"), x["lane_score"].alias("score"))).alias("contributors"),
    )
    return top(fused.select("query_id", "artifact_id", "score", "p.snippet", "p.location", "contributors"), shortlist)


def fuse_two(lexical: DataFrame, semantic: DataFrame, limit: int) -> DataFrame:
    """(query_id, artifact_id, score, rank, bm25_score, semantic_score, snippet): a full outer join of two ranked lists."""
    a = lexical.select("query_id", "artifact_id", F.col("rank").alias("ar"), F.col("score").alias("bm25_score"))
    b = semantic.select("query_id", "artifact_id", F.col("rank").alias("br"), F.col("score").alias("semantic_score"), "snippet")
    zero = F.lit(0.0)
    both = a.join(b, ["query_id", "artifact_id"], "full_outer").withColumn("score", F.round(F.coalesce(reciprocal(F.col("ar")), zero) + F.coalesce(reciprocal(F.col("br")), zero), PLACES))
    return top(both, max(limit, 1)).select("query_id", "artifact_id", "score", "rank", "bm25_score", "semantic_score", "snippet")
