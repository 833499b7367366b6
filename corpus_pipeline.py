"""Cleaning of a document corpus: stages that each read what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.exact_dedup import drop_exact_duplicates
from quillon.llm.language import keep_identified
from quillon.llm.near_dedup import drop_near_duplicates
from quillon.llm.packing import pack_documents
from quillon.llm.substring import cut_repeats
from quillon.session import prepare, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language of the corpus.

    Null and empty texts, those without letters and foreign ones go. Rows with a null id are judged by their text,
    repeated rows each; ties go to the language first by name. Without a single labelled text all rows stay. An empty
    table gives none. Other columns pass through, whatever their names; a text's length does not matter.
    """
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest identifier of each text.

    Rows with a null id or text stay; empty texts are equal to each other. Of rows that repeat an identifier all stay or all
    go. Texts of any length are compared byte for byte. An empty table gives none. Other columns pass through.
    """
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest identifier.

    Rows with a null id or text and texts without words stay. Of rows that repeat an identifier all stay or all go.
    Whole texts are aligned. An empty table gives none. Other columns pass through.
    """
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which each passage of 50 words or more is left in its smallest document alone, n_chars following.

    Rows with a null id or text, empty texts and rows that repeat an identifier stay as they are. A document of which no
    word is left goes. Texts may be of any length. An empty table gives none. Other columns pass through.
    """
    return cut_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of the words of all that is left.

    Null and empty texts have no words and no rows. Rows with a null id keep the null; repeated rows are packed each;
    pieces of equal length go by (id, piece). Long texts are cut into windows. An empty table gives no rows; other
    columns are not read.
    """
    return pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: Language models, alignment and differencing are not expressible in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
