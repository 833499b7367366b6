"""Candidates to hits, and hits to what a caller or a later turn receives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import arrow
from quillon.functions.text import confidence, shown_path, tokenize
from quillon.session import held, lookup, prepare


def best_segments(candidates: DataFrame, queries: DataFrame, segments: DataFrame) -> DataFrame:
    """(query_id, artifact_id, best): of each candidate without a snippet, the text of the segment that holds most of the
    query's tokens (a token that the query repeats counts each time); earlier segments win ties, and no match gives the first."""
    bare = candidates.where("snippet is null").select("query_id", "artifact_id")
    asked = queries.select("query_id", tokenize(F.col("text")).alias("tokens"))
    rows = segments.select("artifact_id", "ordinal", F.col("text").alias("body")).join(lookup(bare), "artifact_id").join(lookup(asked), "query_id")
    low = rows.withColumn("low", F.lower("body"))
    n = F.size(F.filter("tokens", lambda t: F.contains(F.col("low"), t)))
    return low.groupBy("query_id", "artifact_id").agg(F.max_by("body", F.struct(n, -F.col("ordinal"))).alias("best"))


def project(candidates: DataFrame, queries: DataFrame, artifacts: DataFrame, segments: DataFrame | None = None, highlight: bool = False) -> DataFrame:
    """(query_id, rank, artifact_id, kind, path, score, confidence, location, snippet) of candidates that the corpus has.

    Ranks are dense in the order of the candidates; one leading ./ of a path is dropped. Without segments, snippets
    of lanes are shown and the others are null.
    """
    prepare(candidates.sparkSession)
    candidates = held(candidates.drop("path"), "candidates")
    here = artifacts.select("artifact_id", "kind", F.col("path").alias("p"))
    found = here.join(candidates, "artifact_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    hits = found.withColumn("rank", F.row_number().over(order).cast("bigint"))
    text = F.col("snippet")
    if segments is not None:
        hits = hits.join(best_segments(candidates, queries, segments), ["query_id", "artifact_id"], "left")
        text = F.coalesce("snippet", "best")
    hits = hits.join(lookup(queries.select("query_id", F.col("text").alias("__q"))), "query_id")
    return hits.select("query_id", "rank", "artifact_id", "kind", shown_path(F.col("p")).alias("path"), "score", confidence(F.col("score")).alias("confidence"), "location", arrow.snippet(text, F.col("__q"), highlight).alias("snippet"))


def view_emission(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "path", "location", "score", "confidence", "snippet")


def protocol_emission(hits: DataFrame, turn_id: str = "turn-1") -> DataFrame:
    """One row per query: the turn and its hits as JSON in order."""
    each = F.struct("rank", F.struct("artifact_id", "path", "score", "confidence").alias("hit"))
    return hits.groupBy("query_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["hit"])).alias("hits")).select("query_id", F.lit(turn_id).alias("turn_id"), "hits")


def latent_emission(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "artifact_id", F.lit("ranking-score").alias("feature_space"), F.col("score").alias("value"))


# ----------------------------------------------------------------------------------------------------------- evidence


def merge_evidence(fresh: DataFrame, prior: DataFrame, limit: int) -> DataFrame:
    """(query_id, position, path, location, snippet, origin) of evidence in order, fresh before prior, each
    (path, location, snippet) once and at most `limit` rows per query; `pruned` is how many the query lost.

    fresh and prior: (query_id, ord, path, location, snippet). Nulls of location and snippet equal empty ones."""
    both = fresh.withColumn("origin", F.lit(0)).unionByName(prior.withColumn("origin", F.lit(1)))
    key = ["query_id", "path", F.coalesce("location", F.lit("")), F.coalesce("snippet", F.lit(""))]
    first = both.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy("origin", "ord"))).where("n = 1")
    per = Window.partitionBy("query_id")
    placed = first.withColumn("position", F.row_number().over(per.orderBy("origin", "ord", "path")).cast("bigint")).withColumn("pruned", F.greatest(F.count("*").over(per) - limit, F.lit(0)).cast("bigint"))
    return placed.where(F.col("position") <= limit).select("query_id", "position", "path", "location", "snippet", "origin", "pruned")


def distinct_context(sources: DataFrame) -> DataFrame:
    """Rows of a context table that differ in any column, whatever the columns' types."""
    return sources.withColumn("__k", F.to_json(F.struct(*sources.columns))).dropDuplicates(["__k"]).drop("__k")
