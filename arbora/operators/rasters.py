"""Height grids of points, gray images of them, and the blending of overlapping tiles."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import gray, minmax_byte


def extent(points: DataFrame) -> DataFrame:
    """One row: num_points and the ranges of x, y and z."""
    ends = [f(c).alias(f"{c}_{n}") for c in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))]
    return points.agg(F.count("*").alias("num_points"), *ends)


@dataclass(frozen=True)
class GridSpec:
    """Where a grid's cells lie."""

    x_min: float
    y_min: float
    resolution: float
    width: int
    height: int


def grid_spec(x_min: float, x_max: float, y_min: float, y_max: float, resolution: float | None = None, width: int | None = None, height: int | None = None) -> GridSpec:
    """A grid over an extent by cell size (0.5 if nothing is given) or by width, height or both; raises ValueError for both kinds and for an extent without area."""
    sized = [v for v in (width, height) if v is not None]
    if sized and resolution is not None:
        raise ValueError("a grid has either cells of a resolution or a number of them, not both")
    if any(v <= 0 for v in sized) or resolution is not None and resolution <= 0:
        raise ValueError("a grid's resolution, width and height must be above 0")
    wide, tall = x_max - x_min, y_max - y_min
    if not (wide > 0 and tall > 0):
        raise ValueError("the points cover no area")
    if sized:
        resolution = max(span / n for span, n in ((wide, width), (tall, height)) if n is not None)
    elif resolution is None:
        resolution = 0.5
    return GridSpec(x_min, y_min, resolution, width or math.ceil(wide / resolution), height or math.ceil(tall / resolution))


METHODS = {"max": F.max, "mean": F.avg, "median": F.median}


def cells(points: DataFrame, spec: GridSpec, method: str = "max") -> DataFrame:
    """(row, col, z) of the cells that hold points, z in single precision; points on the far edge count to the last cell."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}: max, mean or median")
    at = lambda c, low, n: F.least(F.greatest(((F.col(c) - low) / spec.resolution).cast("int"), F.lit(0)), F.lit(n - 1))
    binned = points.select(at("y", spec.y_min, spec.height).alias("row"), at("x", spec.x_min, spec.width).alias("col"), "z")
    return binned.groupBy("row", "col").agg(METHODS[method]("z").cast("float").alias("z"))


def height_grid(points: DataFrame, method: str = "max", **size: float) -> tuple[DataFrame, GridSpec]:
    """The cells of points with the grid that their extent gives; empty cells have no row and count as 0."""
    e = extent(points).first()
    if not e["num_points"]:
        raise ValueError("there are no points")
    spec = grid_spec(e["x_min"], e["x_max"], e["y_min"], e["y_max"], **size)
    return cells(points, spec, method), spec


def gray_cells(grid: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """(row, col, gray) by the grid's own range or the one given."""
    ends = grid.agg(F.min("z").cast("double").alias("_lo"), F.max("z").cast("double").alias("_hi"))
    rows = grid.crossJoin(F.broadcast(ends))  # one row
    pick = lambda v, c: F.col(c) if v is None else F.lit(float(v))
    return rows.select("row", "col", gray(F.col("z").cast("double"), pick(low, "_lo"), pick(high, "_hi")).alias("gray"))


def bytes_by_range(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    """df with u8: value scaled by the range of its finite values to 0-255; values that are not finite give null."""
    finite = F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.col(value))
    keys = [group] if group else []
    ends = df.groupBy(*keys).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    rows = df.join(ends, keys) if keys else df.crossJoin(F.broadcast(ends))  # one row
    return rows.withColumn("u8", minmax_byte(finite, F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def ramp(local: Column, size: Column, overlap: int) -> Column:
    """A weight that rises linearly over the overlap at both ends of a tile's axis; never 0, so that the image's own border keeps its values."""
    if not overlap:
        return F.lit(1.0)
    return F.least(F.lit(1.0), (local + 1.0) / (overlap + 1.0), (size - local) / (overlap + 1.0))


def blend(pixels: DataFrame, overlap: int) -> DataFrame:
    """(y, x, channel, value): the weighted mean of all tiles' pixels; pixels has x0, y0, width, height of the tile, and x, y, channel, value."""
    w = ramp(F.col("x") - F.col("x0"), F.col("width"), overlap) * ramp(F.col("y") - F.col("y0"), F.col("height"), overlap)
    rows = pixels.select("y", "x", "channel", w.alias("w"), (w * F.col("value")).alias("v"))
    return rows.groupBy("y", "x", "channel").agg((F.sum("v") / F.greatest(F.sum("w"), F.lit(1e-6))).alias("value"))


def overlay(image: DataFrame, grid: DataFrame) -> DataFrame:
    """An image's pixels (row, col, channel, value) times the gray of their cells, modulo 256."""
    return image.join(grid, ["row", "col"]).select("row", "col", "channel", F.pmod(F.col("value") * F.col("gray"), F.lit(256)).alias("value"))


def flipped(grid: DataFrame, height: int) -> DataFrame:
    """Rows from the top, as an image has them."""
    return grid.withColumn("row", F.lit(height - 1) - F.col("row"))


def crop(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """The pixels of a half-open window, by its own places."""
    inside = pixels.where(F.col("col").between(x0, x1 - 1) & F.col("row").between(y0, y1 - 1))
    return inside.withColumn("col", F.col("col") - x0).withColumn("row", F.col("row") - y0)
