"""The planners' rules over whole tables of tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import significant, tokenize


def stop_reason(limit: Column, queries: Column, retained: Column) -> Column:
    """Why a linear plan of so many possible queries ends, given how much evidence it started from."""
    return F.when((limit == 0) | (queries > limit), "step-limit-reached").when(retained == 0, "no-further-queries").otherwise("no-additional-evidence")


def first_queries(tasks: DataFrame, id_col: str, text_col: str, most: int = 6) -> DataFrame:
    """(id, query): the first distinct significant terms of each text; all its tokens where none is significant."""
    words = tokenize(F.col(text_col))
    keen = significant(words)
    return tasks.select(id_col, F.array_join(F.slice(F.array_distinct(F.when(F.size(keen) > 0, keen).otherwise(words)), 1, most), " ").alias("query"))


def follow_ups(evidence: DataFrame, keys: list[str], text_col: str, used_col: str, most: int = 6) -> DataFrame:
    """(keys, query): significant terms of each text that used_col (an array) does not have; no new one gives ''."""
    fresh = F.array_except(significant(tokenize(F.col(text_col))), F.col(used_col))
    return evidence.select(*keys, F.array_join(F.slice(fresh, 1, most), " ").alias("query"))
