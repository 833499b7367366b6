"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, exact_dedup, language, matroska, maxent, near_dedup, packing, sharding, substring, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_media": matroska.op2_media,
    "op3_packing": packing.op3_packing,
    "op4_lm_score": maxent.op4_lm_score,
    "op5_bpe": bpe.op5_bpe,
    "op6_language_id": language.op6_language_id,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_substring": substring.op9_substring,
    "op10_sharding": sharding.op10_sharding,
}

ORACLES: dict[str, str] = {
    "op2_media": matroska.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    "op9_substring": substring.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
