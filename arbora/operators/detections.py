"""Detections: filters, non-maximum suppression, matching with stems, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staged import staged, staged_at


def confident(df: DataFrame, group: str, score: str, threshold: float, fallback: bool = True, order: str = "ord") -> DataFrame:
    """Rows of score >= threshold; with fallback, of a group without any the best row, the first of equals."""
    if not fallback:
        return df.where(F.col(score) >= threshold)
    best = df.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("s"), order)).alias("_b"), F.max(score).alias("_top"))
    rows = df.join(best, group)
    return rows.where((F.col(score) >= threshold) | ((F.col("_top") < threshold) & (F.col(order) == F.col(f"_b.{order}")))).drop("_b", "_top")


def argmax_by(df: DataFrame, group: str, score: str, order: str = "ord") -> DataFrame:
    """Each group's row of the greatest score, the first of equals."""
    others = [c for c in df.columns if c != group]
    top = df.groupBy(group).agg(F.min(F.struct((-F.col(score)).alias("_s"), F.col(order).alias("_o"), *[F.col(c) for c in others])).alias("_b"))
    return top.select(group, *[F.col(f"_b.{c}").alias(c) for c in others])


def label_matches(name: Column, query: str) -> Column:
    """Whether a class name holds the query, in any case."""
    return F.contains(F.lower(name), F.lit(query.strip().lower()))


def class_names(segments: DataFrame, names: DataFrame, key: str = "label") -> DataFrame:
    """Segments of a label of 0 or more with their class name; a label without one is its own name."""
    known = names.select(F.col("label").alias("_label"), F.col("name").alias("class_name"))
    rows = segments.where(F.col(key) >= 0).join(known, F.col(key) == F.col("_label"), "left").drop("_label")
    return rows.withColumn("class_name", F.coalesce("class_name", F.col(key).cast("string")))


def iou(a: str = "a", b: str = "b") -> Column:
    """Intersection over union of two boxes in struct columns with x1, y1, x2, y2."""
    c = lambda s, n: F.col(f"{s}.{n}")
    w = F.greatest(F.least(c(a, "x2"), c(b, "x2")) - F.greatest(c(a, "x1"), c(b, "x1")), F.lit(0.0))
    h = F.greatest(F.least(c(a, "y2"), c(b, "y2")) - F.greatest(c(a, "y1"), c(b, "y1")), F.lit(0.0))
    area = lambda s: (c(s, "x2") - c(s, "x1")) * (c(s, "y2") - c(s, "y1"))
    return F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))


def overlaps(boxes: DataFrame, threshold: float, cell: float) -> DataFrame:
    """(hi, lo, iou): pairs of boxes (rank, x1, y1, x2, y2) with an IoU over the threshold; hi is of smaller rank.

    Boxes meet in the cells of a grid that they cover; a pair is made only in
    the cell that holds the upper left corner of their intersection.
    """
    if threshold < 0:
        raise ValueError("the threshold must be at least 0")
    at = lambda c: F.floor(F.col(c) / cell)
    covered = boxes.select("rank", F.struct("x1", "y1", "x2", "y2").alias("box"), F.explode(F.sequence(at("x1"), at("x2"))).alias("cx"), at("y1").alias("ya"), at("y2").alias("yb"))
    covered = covered.select("rank", "box", "cx", F.explode(F.sequence("ya", "yb")).alias("cy"))
    a, b = covered.select(F.col("rank").alias("hi"), F.col("box").alias("a"), "cx", "cy"), covered.select(F.col("rank").alias("lo"), F.col("box").alias("b"), "cx", "cy")
    own = (F.col("cx") == F.floor(F.greatest("a.x1", "b.x1") / cell)) & (F.col("cy") == F.floor(F.greatest("a.y1", "b.y1") / cell))
    pairs = a.join(b, ["cx", "cy"]).where((F.col("hi") < F.col("lo")) & own)
    return pairs.select("hi", "lo", iou().alias("iou")).where(F.col("iou") > threshold)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank from 1 in a total order: ranges are sorted one by one and rows numbered where they lie, so there is one shuffle and no task orders the whole table."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = 1 << 33  # an id is the partition's number times this, plus the row's in it
    dealt = staged(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_p", F.expr(f"_id div {place}"))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(before), F.col("_p") == F.col("_q")).withColumn("rank", F.col("_id") % place + 1 + F.col("_before")).drop("_id", "_p", "_q", "_before")


def cell_size(boxes: DataFrame) -> float:
    """A side that most boxes fit in: the 0.9 quantile of their longer sides, at least 1."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return max(1.0, float(boxes.agg(F.percentile_approx(side, 0.9)).first()[0] or 1.0))


def suppress(boxes: DataFrame, threshold: float, cell: float | None = None, order: str = "ord") -> DataFrame:
    """The boxes that greedy non-maximum suppression keeps, with rank by score, then order.

    In each round a box without an undecided better neighbour is kept and its
    neighbours go, which gives what visiting the boxes one by one gives. The
    rounds are as many as the longest chain of overlaps decides one by one; what
    each one writes is read together at the end.
    """
    rows = staged(ranked(boxes, F.desc("score"), F.asc(order)))
    edges = staged(overlaps(rows, threshold, cell or cell_size(rows)).select("hi", "lo"))
    gone: list[str] = []
    while True:
        blocked = edges.select(F.col("lo").alias("r")).distinct()
        keep = edges.select(F.col("hi").alias("r")).distinct().join(blocked, "r", "left_anti")
        path = staged_at(edges.join(keep, edges["hi"] == keep["r"], "left_semi").select(F.col("lo").alias("r")).distinct())
        out = rows.sparkSession.read.schema("r long").parquet(path)
        if out.isEmpty():
            break
        gone.append(path)
        left = edges.join(out, edges["hi"] == out["r"], "left_anti")
        edges = staged(left.join(out, left["lo"] == out["r"], "left_anti"))
    if not gone:
        return rows
    return rows.join(rows.sparkSession.read.schema("r long").parquet(*gone).withColumnRenamed("r", "rank"), "rank", "left_anti")


def match(edges: DataFrame) -> DataFrame:
    """Greedy one-to-one matching of edges (tree_index, label_id, score, mask_area).

    Best first: greater score, smaller area, smaller label, smaller tree. In each
    round an edge that is the first of both its ends is taken, and the edges at
    its ends go; that gives what a walk over the sorted edges gives.
    """
    first = F.struct((-F.col("score")).alias("s"), "mask_area", "label_id", "tree_index")
    left = staged(edges.select("tree_index", "label_id", "score", "mask_area").distinct())
    taken: list[str] = []
    read = left.sparkSession.read
    while True:
        trees = left.groupBy("tree_index").agg(F.min(first).alias("e"))
        labels = left.groupBy("label_id").agg(F.min(first).alias("f"))
        both = trees.join(labels, F.col("e.label_id") == F.col("label_id")).where(F.col("e") == F.col("f"))
        now = both.select("tree_index", "label_id", (-F.col("e.s")).alias("score"), F.col("e.mask_area").alias("mask_area"))
        taken.append(staged_at(now))
        now = read.schema(now.schema).parquet(taken[-1])
        if now.isEmpty():
            return read.schema(now.schema).parquet(*taken)
        rest = left.join(now.select("tree_index"), "tree_index", "left_anti")
        left = staged(rest.join(now.select("label_id"), "label_id", "left_anti"))


def stems_in_masks(stems: DataFrame, runs: DataFrame) -> DataFrame:
    """Edges of stems (tree_index, x, y in whole pixels) and masks given as row runs (label_id, score, mask_area, y, x0, x1 with x1 exclusive).

    Runs and stems meet in buckets of 64 columns of a row.
    """
    side = 64
    cut = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor((F.col("x1") - 1) / side))))
    at = stems.withColumn("_b", F.floor(F.col("x") / side))
    return at.join(cut, ["y", "_b"]).where("x >= x0 AND x < x1").select("tree_index", "label_id", "score", "mask_area").distinct()


def match_summary(trees: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of totals; trees has covered and label_id (null if unmatched), labels a row for each label."""
    t = trees.agg(F.count("*").alias("total"), F.count_if("covered").alias("covered"), F.count("label_id").alias("matched"))
    both = t.crossJoin(labels.agg(F.count("*").alias("labels")))  # one row each
    spare = F.greatest(F.col("labels") - F.col("matched"), F.lit(0))
    rate = F.coalesce(F.try_divide(F.col("matched") * 100.0, F.col("total")), F.lit(0.0))
    return both.select("total", "covered", (F.col("total") - F.col("covered")).alias("uncovered"), "matched", (F.col("total") - F.col("matched")).alias("unmatched"), spare.alias("unmatched_labels"), rate.alias("match_rate"), F.col("matched").alias("tp"), spare.alias("fp"), (F.col("total") - F.col("matched")).alias("fn"))


def per_tile(tiles: DataFrame, found: DataFrame) -> DataFrame:
    """Every tile with the number of its detections, 0 where it has none."""
    counts = found.groupBy("tile_id").agg(F.count("*").alias("n"))
    return tiles.join(counts, "tile_id", "left").withColumn("count", F.coalesce("n", F.lit(0))).drop("n")


def confidence_summary(df: DataFrame, score: str = "score") -> DataFrame:
    """n, least, mean and greatest confidence."""
    return df.agg(F.count(score).alias("n"), F.min(score).alias("least"), F.avg(score).alias("mean"), F.max(score).alias("greatest"))


def narrowest(points: DataFrame, spans: DataFrame, bucket: int, at: str = "at", start: str = "start", end: str = "end") -> DataFrame:
    """Each point with the narrowest span that holds it (ends included), the first start of equals; null without one.

    Places (of points and ends) are numbered in order. A span is laid out as
    blocks of 2^k numbers, two of a size at most, each block keeps its best span,
    and a place looks up the blocks it lies in; so the rows follow the number of
    places and spans, however many spans lie over a point. points has a key
    column ord; bucket isn't needed for that and may be anything.
    """
    held = spans.where(F.col(start) <= F.col(end)).groupBy(F.col(start).alias("_a"), F.col(end).alias("_e")).agg(F.min("span_id").alias("_id"))
    asked = points.select(F.col(at).alias("_v")).where("_v IS NOT NULL").distinct()
    places = asked.unionAll(held.select("_a")).unionAll(held.select("_e")).distinct()
    placed = staged(ranked(places, F.col("_v")))
    most = placed.agg(F.max("rank")).first()[0] or 1
    levels = F.explode(F.sequence(F.lit(0), F.lit(most.bit_length()))).alias("_k")
    first, last = placed.select(F.col("_v").alias("_a"), F.col("rank").alias("_l")), placed.select(F.col("_v").alias("_e"), (F.col("rank") + 1).alias("_r"))
    best = F.min("_s").alias("_s")
    cut = held.join(first, "_a").join(last, "_e").select("_l", "_r", F.struct((F.col("_e") - F.col("_a")).alias("span"), F.col("_a").alias("start"), F.col("_id").alias("span_id")).alias("_s"), levels)
    cut = cut.select("_k", "_s", F.expr("shiftright(_l + shiftleft(1L, _k) - 1, _k)").alias("_l"), F.expr("shiftright(_r, _k)").alias("_r")).where("_l < _r")
    nodes = cut.select("_k", "_s", F.explode(F.expr("filter(array(IF(_l % 2 = 1, _l, NULL), IF(_r % 2 = 1, _r - 1, NULL)), n -> n IS NOT NULL)")).alias("_n")).groupBy("_k", "_n").agg(best)
    looked = asked.join(placed, "_v").select("_v", "rank", levels).select("_v", "_k", F.expr("shiftright(rank, _k)").alias("_n"))
    found = looked.join(nodes, ["_k", "_n"]).groupBy("_v").agg(best)
    return points.join(found, F.col(at) == F.col("_v"), "left").select(*[points[c] for c in points.columns], F.col("_s.span_id").alias("span_id"), F.col("_s.span").alias("span"))
