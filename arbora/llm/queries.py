"""The queries of this subpackage, by name: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import pair_report
from .decontaminate import contaminated
from .html_text import main_text
from .mixing import mix
from .near_dedup import near_duplicates
from .pii import pii_report
from .quality import quality
from .secrets import secret_report
from .topk import top_k
from .url_rules import judge


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": lambda s, d: near_duplicates(_read(s, d, "documents")),
    "op2_quality": lambda s, d: quality(_read(s, d, "documents")),
    "op3_topk": lambda s, d: top_k(_read(s, d, "embeddings"), k=5, every=50),
    "op4_decontaminate": lambda s, d: contaminated(_read(s, d, "documents"), _read(s, d, "benchmark")),
    "op5_secrets": lambda s, d: secret_report(_read(s, d, "documents")),
    "op6_mixing": lambda s, d: mix(_read(s, d, "documents")),
    "op7_pii": lambda s, d: pii_report(_read(s, d, "documents")),
    "op8_url_rules": lambda s, d: judge(_read(s, d, "pages")),
    "op9_preference": lambda s, d: pair_report(_read(s, d, "conversations")),
    "op10_main_text": lambda s, d: main_text(_read(s, d, "pages")),
    "pipeline": _pipeline,
}
