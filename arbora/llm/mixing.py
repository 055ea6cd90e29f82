"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are laid end to end in the order of a hash and cut
into blocks of equal numbers of words. Slot i of the mix takes the golden-ratio
point frac(i * phi), which is mapped through the cumulative weights to a source;
the r-th slot of a source takes its block r modulo their number, and thus a
source is read in full before any of it is read again. A source's share of any
run of slots is off its weight by a few slots only.

Ranks and offsets are summed over chunks first and then within them, so no
task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import only, stash

#: Words of a block; a small source has blocks of fewer, so that it has LEAST_BLOCKS or as many as it has words.
BLOCK_WORDS = 256
LEAST_BLOCKS = 64
#: Times that a source may be read at most.
REPEATS = 3
#: 2^32 divided by the golden ratio, and the slots that are ranked together.
GOLDEN = 2654435769
CHUNK = 65536
#: Tasks that rows of one source and size without an id are dealt to.
UNNAMED_PARTS = 64
SPAN = 1 << 32

WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def source_plan(sizes: DataFrame) -> DataFrame:
    """For rows (source, size): one row per source with no, source, source_size, target, blocks, slots, lo, hi.

    Weights 1, 2, 3 repeat along the sources in code point order, null last.
    Targets share all words by weight; none exceeds REPEATS times its source,
    and what it leaves is shared among the others by weight. The windows here
    order one row per source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("no", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))))
    s = s.select("no", "source", "source_size", ((F.col("no") - 1) % 3 + 1).cast("long").alias("w"), (F.col("source_size") * REPEATS).alias("cap"))
    # fill up: in the order of cap / weight, a source stops at its cap if its share of what is left exceeds it
    fill = W.orderBy((F.col("cap") / F.col("w")), "no")
    everything = W.partitionBy()
    s = s.withColumn("c", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).withColumn("left", F.sum("w").over(fill.rowsBetween(W.currentRow, W.unboundedFollowing)))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("capped", _big(F.col("cap")) * _big(F.col("left")) <= _big(F.col("w")) * _big(F.col("total") - F.col("c")))
    s = s.withColumn("rest", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(everything)).withColumn("weights", F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(everything))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("rest").cast("double") / F.col("weights").cast("double")))
    s = s.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / BLOCK_WORDS), F.least("source_size", F.lit(LEAST_BLOCKS))).cast("long"))
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("blocks") / F.col("source_size") + 0.5)).otherwise(0).cast("long"))
    s = s.withColumn("before", F.coalesce(F.sum("slots").over(W.orderBy("no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("long")).withColumn("all", F.sum("slots").over(everything))
    at = lambda n: F.when(F.col("all") > 0, F.expr(f"CAST(CAST({n} AS DECIMAL(38,0)) * {SPAN} div `all` AS BIGINT)")).otherwise(0)
    return s.select("no", "source", "source_size", "target", "blocks", "slots", at("before").alias("lo"), at("(before + slots)").alias("hi"))


def schedule(plan: DataFrame) -> DataFrame:
    """The slots of the mix: slot, no, block, epoch; plan as of source_plan, written to the shared folder."""
    spark = plan.sparkSession
    total = plan.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    i = F.col("id") % SPAN
    low, high = i % 65536, F.floor(i / 65536).cast("long")
    point = (((high * GOLDEN) % 65536) * 65536 + low * GOLDEN) % SPAN
    slots = spark.range(total).select(F.col("id").alias("slot"), point.alias("point"))
    bucket = 1 << 20
    span = plan.where("hi > lo").select("no", "blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / bucket), F.floor((F.col("hi") - 1) / bucket))).alias("bucket"))
    mapped = slots.withColumn("bucket", F.floor(F.col("point") / bucket)).join(span, "bucket").where("point >= lo AND point < hi").select("slot", "no", "blocks", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    mapped = stash(mapped, "slots")
    counts = mapped.groupBy("no", "chunk").agg(F.count("*").alias("n"))
    offsets = counts.select("no", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("no").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    ranked = mapped.withColumn("r", F.row_number().over(W.partitionBy("no", "chunk").orderBy("slot")) - 1).join(offsets, ["no", "chunk"])
    rank = F.col("r") + F.col("offset")
    return ranked.select("slot", "no", (rank % F.col("blocks")).alias("block"), F.expr("(r + `offset`) div blocks").alias("epoch"))


def layout(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """Each document's place in its source's run of words, for sizes as of measured: doc_id, size, no, source_size, target, blocks, bucket, rn, start."""
    rows = sizes.withColumnRenamed("source", "_source").join(plan, F.col("_source").eqNullSafe(F.col("source")))
    # rows without an id come last, by size; of one size they are alike, so that any of them may come first, and many share no task
    unnamed, code = F.col("doc_id").isNull(), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    rows = rows.select("doc_id", "size", "no", "source_size", "target", "blocks", code.alias("code"), F.when(unnamed, F.format_string("x%012d-%03d", "size", "spread")).otherwise(F.substring(code, 1, 3)).alias("bucket"))
    sums = rows.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
    offsets = sums.select("no", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("no").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = W.partitionBy("no", "bucket").orderBy("code", "size")
    placed = rows.withColumn("rn", F.row_number().over(within)).withColumn("local", F.coalesce(F.sum("size").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(offsets, ["no", "bucket"]).withColumn("start", F.col("local") + F.col("offset")).drop("code", "local", "offset")


def measured(docs: DataFrame) -> DataFrame:
    """Each document's doc_id, source and size, and the part that it belongs to if it has no id; stored, so that a part doesn't change."""
    spread = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(UNNAMED_PARTS))
    rows = only(docs, "doc_id", "source", "text").select("doc_id", F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), spread.alias("spread"))
    return stash(rows, "sizes")


def mix(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (of its source), taken (words that the mix takes of it, repeats counted).

    No document is taken more than three times. Null sources are one source,
    which comes last; null texts have size 0 and nothing is taken of them;
    repeated rows are documents of their own; an empty table gives no rows; very
    long texts are counted whole. Other columns are ignored. Reruns agree: the
    order is by a hash of doc_id, and rows without one come last, by size.
    """
    sizes = measured(docs)
    plan = stash(source_plan(sizes), "plan")
    times = schedule(plan).where(F.col("epoch") < REPEATS).groupBy("no", "block").agg(F.count("*").alias("times"))
    placed = stash(layout(sizes, plan), "layout")
    block_of = lambda p: f"CAST((CAST({p} + 1 AS DECIMAL(38,0)) * blocks - 1) div source_size AS BIGINT)"
    edge = lambda b: f"CAST(CAST({b} AS DECIMAL(38,0)) * source_size div blocks AS BIGINT)"
    pieces = placed.where("size > 0").select("doc_id", "no", "bucket", "rn", "size", "start", "source_size", "blocks", F.explode(F.sequence(F.expr(block_of("start")), F.expr(block_of("start + size - 1")))).alias("block"))
    overlap = F.expr(f"least(start + size, {edge('(block + 1)')}) - greatest(start, {edge('block')})")
    taken = pieces.select("no", "bucket", "rn", "block", overlap.alias("n")).join(times, ["no", "block"]).groupBy("no", "bucket", "rn").agg(F.sum(F.col("n") * F.col("times")).alias("taken"))
    out = placed.join(taken, ["no", "bucket", "rn"], "left")
    return out.select("doc_id", F.col("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
