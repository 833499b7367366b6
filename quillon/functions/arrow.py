"""Arrow UDFs over the plain scorers, for what built-in expressions cannot say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import plain

SEGMENT = "array<struct<ordinal: int, label: string, text: string>>"


def _scorer(score, kind: str = "double"):
    @F.pandas_udf(kind)
    def run(query: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([None if q is None or t is None else score(q, t) for q, t in zip(query, text)], dtype="object" if kind == "string" else "float64")

    return run


def path_score(query: Column, path: Column) -> Column:
    return _scorer(lambda q, t: plain.path_score(plain.wanted(q), t))(query, path)


def text_score(query: Column, text: Column) -> Column:
    return _scorer(lambda q, t: plain.text_score(plain.wanted(q), t))(query, text)


def component_score(query: Column, text: Column) -> Column:
    return _scorer(lambda q, t: plain.component_score(plain.wanted(q), t))(query, text)


def subsequence_score(query: Column, text: Column) -> Column:
    return _scorer(plain.subsequence)(query, text)


def jaro_winkler(a: Column, b: Column) -> Column:
    return _scorer(plain.jaro_winkler)(a, b)


def snippet(text: Column, query: Column, highlight: bool = False) -> Column:
    return _scorer(lambda q, t: plain.snippet(t, q, highlight), "string")(query, text)


def segment_match(query: Column, label: Column, text: Column) -> Column:
    """struct<score, snippet> of the best line; null where nothing matches."""

    @F.pandas_udf("score double, snippet string")
    def run(q: pd.Series, on: pd.Series, body: pd.Series) -> pd.DataFrame:
        found = [(None, None) if None in x else plain.segment_score(plain.wanted(x[0]), x[1], x[2]) or (None, None) for x in zip(q, on, body)]
        return pd.DataFrame(found, columns=["score", "snippet"])

    return run(query, label, text)


def structural_bonus(query: Column, path: Column, location: Column, snippet_: Column) -> Column:
    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series, at: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([plain.structural_bonus(*x) for x in zip(q, p, at, s)], dtype="float64")

    return run(query, path, location, snippet_)


def segments(text: Column, kind: Column) -> Column:
    """Segments of each text; null text gives null."""

    @F.pandas_udf(SEGMENT)
    def run(body: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else [vars(p) for p in plain.segments(b, k or "text")] for b, k in zip(body, kinds)], dtype="object")

    return run(text, kind)
