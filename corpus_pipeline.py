"""A corpus pipeline: quality, near-duplicates, decontamination, secrets, mixing.

Each stage works on all rows that its predecessor kept; run() writes each
stage's result to the shared folder and reads it again. All stages take nulls in
any column, empty and very long texts (which are read whole), repeated rows,
empty tables and further columns of any names; what becomes of them is said
below.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontaminate, mixing, near_dedup, quality, secrets
from arbora.llm.shared import stash


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, and with them those with a null or empty text; copies stay or go alike, with or without an id."""
    return quality.keep_good(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest doc_id; of a group without ids any one; texts without words all stay."""
    return near_dedup.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, with or without an id; null and empty texts and items hold nothing, and an empty benchmark drops nothing."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, and n_chars follows; all documents stay, null texts as they are."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document (doc_id, size, source_size, target, taken); documents of which it takes nothing go, and so do those without words."""
    return mixing.mix(docs).where("taken > 0")


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: The classifier's expectation-maximisation and the alignments have no SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; an empty table gives no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs, f"stage{k}")
    return docs
