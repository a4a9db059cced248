"""Corpus preparation as a chain of stages over the documents table.

Each stage reads what the stage before it has kept; all but the last return the
columns of documents, the last returns the pieces of packed token sequences.

For every stage: a null text counts as empty, extra columns may have any name and
come through unchanged, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curveframe.llm import decontaminate, grace_dedup, minhash_forest, packing, quality
from curveframe.llm.common import stage, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows the classifier takes for good and civil; without labels only the labellers' votes train it."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per distinct text, the one with the largest id."""
    return grace_dedup.survivors(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per class of near duplicates, the one with the smallest id; texts without words are in no class and stay."""
    return minhash_forest.survivors(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which less than a twentieth of the words is hit by benchmark windows; without items all of them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, an empty text being its final id alone: doc_id, start, length, ids (unsigned little-endian 32-bit), doc_tokens, sequence_id, offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

# The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
