"""The corpus pipeline: five stages, each a whole pass over what its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, rows that repeat, tables without rows and columns of any
name, as the operator it calls states; what a stage keeps it keeps with all columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import compression, nearcopies, packing, positional, secretscan
from tessera.llm.common import prepare, read_table, shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches the cut go."""
    prepare(spark)
    return compression.without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by their SimHash fingerprints over five-word shingles the one with the smallest
    id stays, and of those left a document goes that is a near copy (five-word Jaccard of 0.8 or more) of one before it."""
    prepare(spark)
    return nearcopies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item's window occurs go."""
    prepare(spark)
    return positional.decontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    prepare(spark)
    return secretscan.masked(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents and their places in sequences."""
    prepare(spark)
    return packing.packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", pack),
]

#: SQL has neither the fitted dictionaries nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again."""
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
