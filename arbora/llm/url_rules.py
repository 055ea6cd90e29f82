"""URL filters by a sort-merge range join on reversed-host keys, in DataFrame functions only.

A host's labels, reversed and each followed by a dot, make a key; a rule's
host is then an interval of keys that holds the host and all its subdomains,
and intervals are nested or disjoint. URLs are dealt out evenly by their place, the
few rules go to every part, and each part is sorted by key and swept once: the
last rule host that started at or before a URL's key brings the stack of rule
hosts that were open there, of which those that still hold the key are active.
Their paths are tested, and the longest rule that fits wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import only, partitions

#: Fixed values: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without it."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """The labels of a host in reverse, each followed by a dot."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\.", -1))), F.lit("."))


def rule_stacks(rules: DataFrame) -> DataFrame:
    """For every rule host its key and the rules of it and of all rule hosts around it; rules has host, path, verdict."""
    own = rules.select(key_of(F.col("host")).alias("key"), F.struct(F.concat("host", "path").alias("rule"), key_of(F.col("host")).alias("within"), "path", "verdict").alias("r")).distinct()
    keys = own.select("key").distinct()
    labels = F.split("key", r"\.")
    up = keys.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.concat_ws(".", F.slice(labels, F.lit(1), n)), F.lit(".")))).alias("above"))
    return up.join(own.withColumnRenamed("key", "above"), "above").groupBy("key").agg(F.array_sort(F.collect_set("r")).alias("stack"))


def rules_frame(spark, rules=RULES) -> DataFrame:
    """Rules as rows (host, path, verdict)."""
    each = [F.struct(*[F.lit(v).alias(n) for n, v in zip(("host", "path", "verdict"), r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*each)))


def judge(pages: DataFrame, rules: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """Per row of pages: page_id, host, path, rule (null if none fits), verdict.

    Of the rules that fit the longest wins, ties by code point. A null url or
    one without :// has an empty host and path, and no rule. Repeated rows and
    null ids come out as they come in; an empty table gives no rows; very long
    urls are read whole; other columns are ignored.
    """
    spark = pages.sparkSession
    stacks = rule_stacks(rules if rules is not None else rules_frame(spark))
    parts = max(32, 2 * partitions(spark))
    rows = only(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.xxhash64(F.monotonically_increasing_id()).alias("h"))
    urls = rows.select(F.pmod("h", F.lit(parts)).alias("part"), key_of(F.col("host")).alias("key"), F.lit(1).alias("kind"), "page_id", "host", "path", F.lit(None).cast(stacks.schema["stack"].dataType).alias("stack"))
    dealt = stacks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), "stack")
    sweep = W.partitionBy("part").orderBy("key", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = urls.unionByName(dealt).withColumn("open", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter("open", lambda r: F.startswith(F.col("key"), r["within"]) & F.startswith(F.col("path"), r["path"]))
    best = F.element_at(F.array_sort(F.transform(fits, lambda r: F.struct((-F.char_length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))), 1)
    won = swept.select("page_id", "host", "path", F.when(F.size(fits) > 0, best).alias("b"))
    return won.select("page_id", "host", "path", F.col("b.rule").alias("rule"), F.coalesce("b.verdict", F.lit(default)).alias("verdict"))
