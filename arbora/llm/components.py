"""Connected components of a link table, by rounds of large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, tag: str) -> DataFrame:
    """Hang each larger neighbour of a node on the least of the node and its neighbours."""
    near = _both_ways(edges)
    least = stash(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m")), tag)
    return near.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, tag: str) -> DataFrame:
    """Hang a node and its smaller neighbours on the least of them."""
    down = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), tag)
    least = stash(down.groupBy("a").agg(F.min("b").alias("m")), tag)
    hung = down.join(least.withColumnRenamed("a", "k"), F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.where("a <> b").unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Columns ``node`` and ``root`` for every node of the links ``a``-``b``; root is the least node of its component.

    Each round is written to the shared folder, so a lost executor costs a
    part of one round; its minima are written first, so that both sides of the
    join with them are shuffled for it alone and the links of one node can be
    split. The rounds grow with the logarithm of the longest path.
    Links with a null end and links of a node with itself are ignored; no links give no rows.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    mark = None
    while True:
        now = stash(_small_star(_large_star(now, tag), tag), tag)
        total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(total) == mark:
            break
        mark = tuple(total)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
