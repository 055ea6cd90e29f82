"""Tables written between the rounds of an iterative operator, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's part of ``spark.checkpoint.dir``, which goes when the driver ends; a folder of this machine only if all of Spark runs here."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", found)
    path = f"{found.rstrip('/')}/arbora-rounds-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def staged_at(df: DataFrame) -> str:
    """Write a table; its path."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def staged(df: DataFrame) -> DataFrame:
    """Write a table and read it again: its lineage ends there."""
    return df.sparkSession.read.schema(df.schema).parquet(staged_at(df))
