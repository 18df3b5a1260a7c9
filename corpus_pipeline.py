"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before kept, and returns the
columns of ``documents`` (the last one the pieces of the packed sequences).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import exact_dedup, jaccard_join, mixing, packing, quality
from quillon.llm.common import materialize, table


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of learnable documents.

    Null text counts as empty and is judged like any other; rows with a null or repeated id are judged each by its own
    text; an empty table stays empty. Columns may have any names.
    """
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")), spark)


def stage_exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id.

    Null and empty texts are one text; a null id goes if a copy has an id; rows that repeat id and text stay or go together;
    an empty table stays empty. Columns may have any names.
    """
    return exact_dedup.keep_first(docs)


def stage_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id.

    Null ids and texts without words always stay; rows that repeat an id stay or go together; an empty table stays empty.
    Columns may have any names.
    """
    return jaccard_join.one_of_each(docs, spark)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it.

    A null source is a source, the last; null ids draw by their text, rows that repeat id, source and size are taken or left
    together; empty texts take a source's whole copies; an empty table stays empty. Columns may have any names.
    """
    return mixing.mixed_rows(docs, spark)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences.

    A null text is one end id; null ids stay null; rows that repeat an id are packed each on its own; an empty table
    gives no pieces. Other columns aren't read.
    """
    return packing.pack(docs)


STAGES = [
    ("quality", stage_quality),
    ("exact_dedup", stage_exact_dedup),
    ("jaccard_join", stage_jaccard_join),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

#: A learned classifier and a tokenizer are beyond SQL; tests/llm/test_pipeline.py works out each stage's rows in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), spark)
    return STAGES[-1][1](spark, docs, sf_dir)
