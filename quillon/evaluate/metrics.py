"""Ranking metrics over tables of hits and judgements."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IDEAL = 10


def _gain(rank: F.Column, relevance: F.Column) -> F.Column:
    """(2^relevance - 1) / log2(rank + 1) for ranks from 1."""
    return (F.pow(F.lit(2.0), relevance) - 1) / F.log2(rank.cast("double") + 1)


def per_query(hits: DataFrame, qrels: DataFrame, k: int | None = None) -> DataFrame:
    """(query_id, ndcg, mrr, recall) of every judged query. hits: (query_id, doc_id, rank).

    All hits count unless k cuts them; the ideal is over the ten best judgements. A query without relevant
    documents, or without hits, has zeros. Judgements of 0 are not relevant.
    """
    judged = qrels.where("query_id is not null and doc_id is not null").groupBy("query_id", "doc_id").agg(F.max("relevance").alias("relevance"))
    order = Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "doc_id")
    ideal = judged.withColumn("i", F.row_number().over(order)).groupBy("query_id").agg(
        F.sum(F.when(F.col("i") <= IDEAL, _gain(F.col("i"), F.col("relevance"))).otherwise(0.0)).alias("idcg"), F.count(F.when(F.col("relevance") > 0, 1)).alias("relevant")
    )
    seen = (hits if k is None else hits.where(F.col("rank") <= k)).select("query_id", "doc_id", "rank").join(judged.where("relevance > 0"), ["query_id", "doc_id"])
    got = seen.groupBy("query_id").agg(F.sum(_gain(F.col("rank"), F.col("relevance"))).alias("dcg"), F.min("rank").alias("first"), F.count("*").alias("found"))
    zero = F.lit(0.0)
    return ideal.join(got, "query_id", "left").select(
        "query_id",
        F.when(F.col("idcg") > 0, F.coalesce(F.col("dcg"), zero) / F.col("idcg")).otherwise(zero).alias("ndcg"),
        F.coalesce(F.lit(1.0) / F.col("first"), zero).alias("mrr"),
        F.when(F.col("relevant") > 0, F.coalesce(F.col("found"), F.lit(0)) / F.col("relevant")).otherwise(zero).alias("recall"),
    )


def mean_quality(per: DataFrame) -> DataFrame:
    """One row (queries, ndcg, mrr, recall) of means, rounded to 9 places."""
    return per.agg(F.count("*").alias("queries"), *(F.round(F.avg(c), 9).alias(c) for c in ("ndcg", "mrr", "recall")))


def percentiles(df: DataFrame, col: str, quantiles: tuple[float, ...] = (0.5, 0.9), by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles p50, p90 .. and max of a column, exactly; no rows give nulls."""
    names = [F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {col})").alias(f"p{round(q * 100)}") for q in quantiles]
    return (df.groupBy(*by) if by else df).agg(*names, F.max(col).alias("max"))


def nearest_rank(values: list[float], quantile: float) -> float:
    ordered = sorted(values)
    return ordered[min(max(math.ceil(len(ordered) * quantile) - 1, 0), len(ordered) - 1)] if ordered else 0.0


def recall_of(actual: list[str], expected: list[str]) -> float:
    return sum(a in set(expected) for a in actual) / len(set(expected)) if expected else 1.0


def satisfied(actual: list[str], expected: list[str]) -> bool:
    return set(expected) <= set(actual)


def evidence_efficiency(final: list[str], expected: list[str]) -> float:
    """Share of the final documents that were expected; without any, 1 if nothing was expected."""
    if not final:
        return float(not expected)
    return sum(d in set(expected) for d in final) / len(final)


def branch_efficiency(final: list[str], expected: list[str], turns: int) -> float:
    """Expected documents among the final ones per executed turn."""
    if not turns:
        return float(not expected)
    return sum(d in set(expected) for d in final) / turns
