"""Query expansion: a query becomes one or more weighted variants."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.session import prepare

MAX_TOKENS = 128
#: Most words and weight of what a model adds, and its prompt, by kind of expansion.
KINDS = {
    "hyde": (96, 0.7, "Write a short passage that would answer this search: {query}"),
    "splade": (32, 0.5, "List search terms that are related to: {query}"),
    "classified": (32, 0.5, "Name the kind of this search, and terms for it: {query}"),
}
PLAIN = ("none", "synonym")
_ENDINGS = ("<|im_end|>", "<|endoftext|>")


class Generator(Protocol):
    """A text model. It must be picklable: it runs inside the executors."""

    def generate(self, prompt: str, max_tokens: int) -> str: ...


def cleaned(raw: str, query: str, words: int) -> str | None:
    """What a model said, without end signs and outer quotes, cut to `words`; None where nothing new is left."""
    for sign in _ENDINGS:
        raw = raw.replace(sign, "")
    out = " ".join(raw.split()[:words]).strip().strip("\"'").strip()
    return None if not out or out == query.strip() else out


def prompt_for(kind: str, query: str, template: str | None = None) -> str:
    """A template with {query} is filled in; one without is put before the query."""
    template = template or KINDS[kind][2]
    return template.replace("{query}", query) if "{query}" in template else f"{template}\n\n{query}"


def expand(queries: DataFrame, kind: str = "none", model: Generator | None = None, template: str | None = None) -> DataFrame:
    """(query_id, variant_ord, text, weight) of queries (query_id, text).

    none and synonym give the text as it is, weight 1. The kinds that ask a model add its answer at their own
    weight; without a model, or where it fails or says nothing new, the trimmed query stands alone. A null
    text gives a variant of null text, which no lane uses.
    """
    if kind not in PLAIN and kind not in KINDS:
        raise ValueError(f"unknown query expansion: {kind}")
    text = F.col("text")
    first = queries.select("query_id", F.lit(0).alias("variant_ord"), (text if kind in PLAIN else F.trim(text)).alias("text"), F.lit(1.0).alias("weight"))
    if kind in PLAIN or model is None:
        return first
    words, weight, _ = KINDS[kind]
    prepare(queries.sparkSession)

    @F.pandas_udf("string")
    def ask(asked: pd.Series) -> pd.Series:
        def one(q: str | None) -> str | None:
            if q is None:
                return None
            try:
                return cleaned(model.generate(prompt_for(kind, q, template), MAX_TOKENS), q, words)
            except Exception:  # a model that fails leaves the query alone
                return None

        return pd.Series([one(q) for q in asked], dtype="object")

    more = queries.select("query_id", F.lit(1).alias("variant_ord"), ask("text").alias("text"), F.lit(weight).alias("weight")).where("text is not null")
    return first.unionByName(more)
