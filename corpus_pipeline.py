"""The corpus pipeline: five stages over `documents`, each reading what the one before has written.

Decisions of the stages: quality rules remove failing lines and rejected documents; toxicity removes
documents that score 0.5 or more; line dedup removes later copies of repeated runs and documents left without
a line; near-dedup keeps one document of each group (five-word shingles: fingerprints at most 3 of 64 bits apart, or
a similarity of 0.8 or more); packing returns the pieces of all that stays.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import line_dedup, packing, quality, simhash, toxicity
from sparkloom.session import shared_folder, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail."""
    return quality.clean(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go; the model learns from the labelled documents that are not held out."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go."""
    return line_dedup.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids in sequences of 2048."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("line_dedup", repeated_lines),
    ("simhash_near_dedup", near_dedup),
    ("packing", pack),
]

#: Boosted trees, 64-bit hashes of shingles and a tokenizer are beyond SQL: tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
