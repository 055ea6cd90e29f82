"""Tile grids and the joins of points, circles and boxes with them.

Tiles are regular, so the tiles that a shape can meet follow from its
coordinates: they are generated for each shape, and an exact test follows. No
pair of a shape and a distant tile is ever made, and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import Crown, circle_meets_rect, clip_box, crown_box, round_even, tile_id


@dataclass(frozen=True)
class Grid:
    """Tiles of size with overlap over a width by height image, in scan order; slivers at the end are tiles too."""

    width: int
    height: int
    size: int
    overlap: int = 0
    size_y: int = 0

    def __post_init__(self) -> None:
        if self.size <= 0 or self.size_y < 0:
            raise ValueError("a tile's size must be positive")
        if not 0 <= self.overlap < min(self.size, self.size_y or self.size):
            raise ValueError("the overlap must be at least 0 and less than the tile's size")

    @property
    def tall(self) -> int:
        return self.size_y or self.size

    def frame(self, spark: SparkSession, start: tuple[int, int] = (0, 0), most: int | None = None) -> DataFrame:
        """tile_id, x0, y0, x1, y1 of all tiles, ends cut to the image; from a place in whole tiles on, and the first so many in scan order."""
        step, tall = self.size - self.overlap, self.tall - self.overlap
        left, top = start[0] * self.size, start[1] * self.tall
        cols, rows = max(0, -(-(self.width - left) // step)), max(0, -(-(self.height - top) // tall))
        i = spark.range(cols * rows if most is None else min(cols * rows, max(0, most)))
        x0, y0 = (F.col("id") % max(cols, 1)) * step + left, F.floor(F.col("id") / max(cols, 1)) * tall + top
        return self._ends(i.select(x0.cast("int").alias("x0"), y0.cast("int").alias("y0")))

    def _ends(self, df: DataFrame) -> DataFrame:
        x1, y1 = F.least(F.col("x0") + self.size, F.lit(self.width)), F.least(F.col("y0") + self.tall, F.lit(self.height))
        return df.withColumn("tile_id", tile_id(F.col("x0"), F.col("y0"))).withColumn("x1", x1.cast("int")).withColumn("y1", y1.cast("int")).select("tile_id", *[c for c in df.columns if c not in ("x0", "y0")], "x0", "y0", "x1", "y1")

    def _span(self, low: Column, high: Column, size: int, full: int) -> tuple[Column, Column]:
        step = size - self.overlap
        last = -(-full // step) - 1
        return F.greatest(F.ceil((low - size) / step), F.lit(0)), F.least(F.floor(high / step), F.lit(last))

    def candidates(self, shapes: DataFrame, left: Column, top: Column, right: Column, bottom: Column) -> DataFrame:
        """Each shape with every tile that its closed bounding box can meet."""
        (a, b), (c, d) = self._span(left, right, self.size, self.width), self._span(top, bottom, self.tall, self.height)
        rows = shapes.withColumns({"_a": a.cast("int"), "_b": b.cast("int"), "_c": c.cast("int"), "_d": d.cast("int")}).where("_a <= _b AND _c <= _d")
        rows = rows.withColumn("_i", F.explode(F.sequence("_a", "_b"))).withColumn("_j", F.explode(F.sequence("_c", "_d")))
        rows = rows.withColumn("x0", (F.col("_i") * (self.size - self.overlap)).cast("int")).withColumn("y0", (F.col("_j") * (self.tall - self.overlap)).cast("int"))
        return self._ends(rows.drop("_a", "_b", "_c", "_d", "_i", "_j"))


def points_in_tiles(points: DataFrame, grid: Grid, x: str = "x", y: str = "y") -> DataFrame:
    """Each point with every tile that holds it (half-open), and its place there: x_local, y_local."""
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    rows = grid.candidates(points, px, py, px, py).where((px >= F.col("x0")) & (px < F.col("x1")) & (py >= F.col("y0")) & (py < F.col("y1")))
    return rows.withColumn("x_local", px - F.col("x0")).withColumn("y_local", py - F.col("y0"))


def boxes_in_tiles(boxes: DataFrame, grid: Grid) -> DataFrame:
    """Each box (bx1, by1, bx2, by2) with every tile that it overlaps, cut to the tile: lx1, ly1, lx2, ly2."""
    b = [F.col(c).cast("double") for c in ("bx1", "by1", "bx2", "by2")]
    rows = grid.candidates(boxes, b[0], b[1], b[2], b[3])
    cut = clip_box(*b, *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")])
    return rows.withColumns(dict(zip(("lx1", "ly1", "lx2", "ly2"), cut, strict=True))).where("lx2 > lx1 AND ly2 > ly1")


def weak_labels(trees: DataFrame, grid: Grid, crown: Crown, metres_per_pixel: float, padding: float = 4.0) -> DataFrame:
    """One row for each tree and each tile that its crown meets; trees has tree_id, x, y in pixels and dbh_cm.

    Trees outside the image go. Places and boxes are the tile's; boxes are
    padded, cut and rounded to three decimals, pixel places half to even.
    """
    rows = trees.where((F.col("x") >= 0) & (F.col("x") < grid.width) & (F.col("y") >= 0) & (F.col("y") < grid.height))
    rows = rows.withColumn("crown_radius", crown.radius(F.col("dbh_cm")) / metres_per_pixel)
    x, y, r = F.col("x"), F.col("y"), F.col("crown_radius")
    rows = grid.candidates(rows, x - r, y - r, x + r, y + r).where(circle_meets_rect(x, y, r, *[F.col(c).cast("double") for c in ("x0", "y0", "x1", "y1")]))
    lx, ly = x - F.col("x0"), y - F.col("y0")
    box = crown_box(lx, ly, r, F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), padding)
    named = dict(zip(("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"), [round_even(b, 3) for b in box], strict=True))
    out = rows.withColumns({"x_pixel": round_even(lx).cast("int"), "y_pixel": round_even(ly).cast("int"), **named, "crown_radius": round_even(r, 3)})
    return out.withColumn("bbox_x1", F.when((F.col("bbox_x2") > F.col("bbox_x1")) & (F.col("bbox_y2") > F.col("bbox_y1")), F.col("bbox_x1")).otherwise(F.raise_error(F.lit("a crown's box is empty"))))
