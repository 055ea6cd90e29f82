"""Tables kept between stages, in the folder that driver and executors share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where none is set, a folder of this machine if all of Spark runs here, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="arbora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A path in the shared folder that nothing else uses; this application's part of the folder goes when its driver ends."""
    folder = f"{shared_dir(spark)}/arbora-{spark.sparkContext.applicationId}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return f"{folder}/{tag}-{uuid.uuid4().hex}"


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, and any executor can read it."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of files that are too few for all cores, up to which their rows are dealt out: a row group's usual size.
SMALL = 128 << 20


def dealt(df: DataFrame) -> DataFrame:
    """df, its rows dealt out to all cores if they come from fewer files than these, of SMALL bytes at most: a small file can be one task else."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL:
        return df  # before the files are listed, which may be very many
    files, cores = df.inputFiles(), df.sparkSession.sparkContext.defaultParallelism
    if not files or len(files) >= cores:
        return df
    return df.repartition(cores)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever other columns the table has."""
    return df.select(*[df[f"`{n}`"].alias(n) for n in names])


#: Bits of a filter: 16 for each key, within these powers of two, so that it never exceeds 16 MB.
FILTER_LEAST, FILTER_MOST = 15, 27
_BITMAP = 32768


def may_hold(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with a column ``may``: false only where table, which is stored, surely lacks the row's key.

    A filter of one bit a key, sent to all executors. Its size is bounded; of a
    table with very many keys it only lets more rows through. The columns of
    rows are the caller's choice and none is named _place, _piece, _bits or _byte.
    """
    n = table.count()
    bits = 1 << min(FILTER_MOST, max(FILTER_LEAST, math.ceil(math.log2(16 * n + 1))))
    place = lambda k: F.pmod(F.xxhash64(F.lit("filter"), k), F.lit(bits))
    maps = table.select(place(F.col(key)).alias("p")).groupBy(F.floor(F.col("p") / _BITMAP).alias("_piece")).agg(F.bitmap_construct_agg(F.col("p") % _BITMAP).alias("_bits"))
    placed = rows.withColumn("_place", place(F.col(key))).withColumn("_piece", F.floor(F.col("_place") / _BITMAP))
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(_place % {_BITMAP} div 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    set_ = F.coalesce(F.expr("shiftright(_byte, CAST(_place % 8 AS INT))").bitwiseAND(F.lit(1)) == 1, F.lit(False))
    met = placed.join(F.broadcast(maps), "_piece", "left").withColumn("_byte", byte)
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], set_.alias("may"))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
