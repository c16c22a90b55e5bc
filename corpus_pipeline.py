"""The corpus pipeline: quality rules, toxicity, near duplicates, packing, in that order.

Every stage works on all rows that the one before kept; all but the last return the columns of documents.
Nulls, empty tables, repeated rows and extra columns have the results that the operators state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passages.llm import op2_quality_rules, op4_toxicity, op8_jaccard_join, op10_packing
from passages.llm.common import removed, settled, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of quality rules keeps."""
    return op2_quality_rules.keep(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold; the model learns from the stage's own labelled rows."""
    return op4_toxicity.keep(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return op8_jaccard_join.keep(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    import public_tokenizers

    return op10_packing.pack(docs, public_tokenizers.path(op10_packing.VOCABULARY), added=public_tokenizers.path(op10_packing.TOKENIZER))


STAGES = [("quality", quality), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("packing", packing)]

#: Stages 2 and 4 can't be expressed in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, settled(spark, lambda: stage(spark, docs, sf_dir), f"pipeline-{name}")  # noqa: B023  called at once
        if i:
            removed(before)
    return STAGES[-1][1](spark, docs, sf_dir)
