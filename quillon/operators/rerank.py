"""Reranking of fused candidates."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import arrow
from quillon.operators.retrieve import PLACES, top
from quillon.session import lookup, prepare

KINDS = ("none", "position-aware", "mock-llm", "llm", "gemma", "jina")


class Scorer(Protocol):
    """A relevance model. It must be picklable: it runs inside the executors."""

    def score(self, query: str, texts: list[str]) -> list[float]: ...


def yes_probability(yes: float, no: float) -> float:
    """Share of the answer `yes` from the logits of both."""
    top_ = max(yes, no)
    a, b = math.exp(yes - top_), math.exp(no - top_)
    return a / (a + b + 1e-6 * math.exp(-top_) if top_ < 0 else a + b + 1e-6)


def rerank_query(text: F.Column, intent: F.Column | None = None) -> F.Column:
    return text if intent is None else F.when(intent.isNull(), text).otherwise(F.concat(text, F.lit(". Intent: "), intent))


def rerank(candidates: DataFrame, queries: DataFrame, kind: str, limit: int, model: Scorer | None = None, strict_limit: bool = False) -> DataFrame:
    """candidates (query_id, artifact_id, path, score, rank, snippet, location) in a new order.

    none, and a model that is not there, pass everything on and heed `limit` only with strict_limit.
    position-aware adds at most 0.12 for paths, headings, snippets and definitions that match. A model gives
    a new score to candidates with a snippet; the others keep theirs. queries: (query_id, rerank_text).
    """
    if kind not in KINDS:
        raise ValueError(f"unknown reranking: {kind}")
    if kind in ("none", "mock-llm") or (model is None and kind != "position-aware"):
        return candidates.where(F.col("rank") <= limit) if strict_limit else candidates
    prepare(candidates.sparkSession)
    asked = candidates.drop("rank").join(lookup(queries.select("query_id", "rerank_text")), "query_id")
    if kind == "position-aware":
        moved = asked.withColumn("score", F.round(F.col("score") + arrow.structural_bonus(F.col("rerank_text"), F.col("path"), F.col("location"), F.col("snippet")), PLACES))
        return top(moved, limit).drop("rerank_text")
    names = asked.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            has = frame["snippet"].notna() & (frame["snippet"] != "")
            for query, own in frame[has].groupby("rerank_text", sort=False):
                frame.loc[own.index, "score"] = model.score(query, own["snippet"].tolist())
            yield frame[names]

    scored = asked.mapInPandas(run, asked.schema).withColumn("score", F.round("score", PLACES))
    return top(scored, limit).drop("rerank_text")
