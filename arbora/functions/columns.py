"""Column builders: parsing, rounding, allometry, tiles, geometry, pixels, names.

Everything here is a built-in expression, so it stays in generated code.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_or_empty(c: Column) -> Column:
    """A value as trimmed text; null as empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def first_present(*columns: Column) -> Column:
    """The first value that isn't blank; null if all are."""
    return F.coalesce(*[F.nullif(text_or_empty(c), F.lit("")) for c in columns])


def parse_number(c: Column) -> Column:
    """A decimal, with a comma or a point; null for anything else (also for a trailing d or f, which a cast would take)."""
    t = F.replace(text_or_empty(c), F.lit(","), F.lit("."))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?(?i:nan|inf|infinity)$"), t.try_cast("double"))


def status_is(c: Column, wanted: str, blank_as: str | None = None) -> Column:
    """Case-insensitive equality after trimming; an empty filter takes all; blank_as stands for a blank status."""
    if not wanted.strip():
        return F.lit(True)
    s = text_or_empty(c)
    if blank_as is not None:
        s = F.when(s == "", F.lit(blank_as)).otherwise(s)
    return F.lower(s) == wanted.strip().lower()


def dbh_cm(raw: Column, unit: str) -> Column:
    """A diameter in centimetres: mm by 10, cm as is, any other unit as metres."""
    return raw / 10.0 if unit == "mm" else raw if unit == "cm" else raw * 100.0


def clamp(v: Column, low: float, high: float) -> Column:
    """Into [low, high]; the lower bound is tested first."""
    return F.when(v < low, F.lit(float(low))).when(v > high, F.lit(float(high))).otherwise(v)


@dataclass(frozen=True)
class Crown:
    """A crown radius model: linear or power of the diameter, clamped."""

    model: str = "linear"
    factor: float = 0.08
    intercept: float = 0.0
    a: float = 0.15
    b: float = 0.8
    least: float = 0.5
    most: float = 15.0
    default: float = 2.5

    def radius(self, dbh: Column) -> Column:
        """Metres; a missing diameter gets the default, which only the lower bound limits."""
        v = F.lit(self.intercept) + self.factor * dbh if self.model == "linear" else self.a * F.pow(dbh, F.lit(self.b))
        return F.when(dbh > 0, clamp(v, self.least, self.most)).otherwise(F.lit(max(self.default, self.least)))


def round_even(c: Column, digits: int = 0) -> Column:
    """Half to even, on the decimal rendering."""
    return F.bround(c, digits)


def tile_id(x: Column, y: Column) -> Column:
    """tile_x{X}_y{Y}."""
    return F.format_string("tile_x%d_y%d", x.cast("long"), y.cast("long"))


def tile_origin(name: Column) -> Column:
    """struct<x, y> of a tile file's name; null for other names."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    pattern = r"^tile_x(-?\d+)_y(-?\d+)(?:\.png|\.npz)?$"
    part = lambda k: F.regexp_extract(base, pattern, k).cast("long")
    return F.when(base.rlike(pattern), F.struct(part(1).alias("x"), part(2).alias("y")))


def legacy_tile_name(index: Column, x: Column, y: Column, overlap: Column, kind: str = "png") -> Column:
    """The name of a tile's file in caches of earlier runs: its number, place and overlap."""
    return F.format_string(f"tile_%04d_x%d_y%d_overlap%d.{kind}", index.cast("long"), x.cast("long"), y.cast("long"), overlap.cast("long"))


def legacy_tile(name: Column) -> Column:
    """struct<index, x, y, overlap> of such a name; null for others."""
    base = F.regexp_extract(name, r"([^/\\]*)$", 1)
    pattern = r"^tile_(\d+)_x(-?\d+)_y(-?\d+)_overlap(\d+)\.(?:png|npz)$"
    parts = [F.regexp_extract(base, pattern, k).cast("long").alias(n) for k, n in enumerate(("index", "x", "y", "overlap"), 1)]
    return F.when(base.rlike(pattern), F.struct(*parts))


#: How a file's name tells a UTM zone.
ZONE_NAME = r"utm(\d{1,2})([ns])"


def utm_zone(stem: Column) -> Column:
    """struct<zone, north> from utm<1-60><n|s> anywhere in a name's stem, else null."""
    pattern = ZONE_NAME
    low = F.lower(F.regexp_replace(F.regexp_extract(stem, r"([^/\\]*)$", 1), r"\.[^.]*$", ""))
    zone = F.regexp_extract(low, pattern, 1).try_cast("int")
    return F.when(zone.between(1, 60), F.struct(zone.alias("zone"), (F.regexp_extract(low, pattern, 2) == "n").alias("north")))


def species_name(c: Column) -> Column:
    """Trimmed; blank as (missing)."""
    t = text_or_empty(c)
    return F.when(t == "", F.lit("(missing)")).otherwise(t)


def title_case(c: Column) -> Column:
    """Every run of letters begins with a capital and goes on in small letters; names in brackets stay."""
    low = F.lower(c)
    letters = F.split(low, "")
    up = F.transform(letters, lambda x, i: F.when((i == 0) | ~F.element_at(letters, F.greatest(i, F.lit(1))).rlike(r"\p{L}"), F.upper(x)).otherwise(x))
    return F.when(c.startswith("("), c).otherwise(F.concat_ws("", up))


def circle_meets_rect(cx: Column, cy: Column, r: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether a closed circle meets a closed rectangle."""
    dx, dy = cx - F.least(F.greatest(cx, x0), x1), cy - F.least(F.greatest(cy, y0), y1)
    return dx * dx + dy * dy <= r * r


def crown_box(cx: Column, cy: Column, r: Column, width: Column, height: Column, pad: float) -> list[Column]:
    """x1, y1, x2, y2 of a padded crown in its tile, clipped; an axis that clipping closed is opened by half a pixel each way."""
    out = []
    for c, size in ((cx, width), (cy, height)):
        s = size.cast("double")
        low, high = F.greatest(F.lit(0.0), c - r - pad), F.least(s, c + r + pad)
        shut = high <= low
        out.append((F.when(shut, F.greatest(F.lit(0.0), low - 0.5)).otherwise(low), F.when(shut, F.least(s, high + 0.5)).otherwise(high)))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def clip_box(x1: Column, y1: Column, x2: Column, y2: Column, left: Column, top: Column, right: Column, bottom: Column) -> list[Column]:
    """A box cut to a rectangle, in the rectangle's coordinates."""
    return [F.greatest(x1, left) - left, F.greatest(y1, top) - top, F.least(x2, right) - left, F.least(y2, bottom) - top]


def global_box(x1: Column, y1: Column, x2: Column, y2: Column, ox: Column, oy: Column, width: float, height: float) -> list[Column]:
    """A tile's box in the image, clamped to it."""
    at = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), F.lit(float(most)))
    return [at(x1 + ox, width), at(y1 + oy, height), at(x2 + ox, width), at(y2 + oy, height)]


def point_box(x: Column, y: Column, width: float, height: float, reach: float = 8.0) -> list[Column]:
    """A box of reach around a point, clipped to the image and at least a pixel wide."""
    out = []
    for c, most in ((x, width), (y, height)):
        low, high = F.greatest(F.lit(0.0), c - reach), F.least(F.lit(float(most)), c + reach)
        out.append((low, F.when(high <= low, F.least(F.lit(float(most)), low + 1.0)).otherwise(high)))
    return [out[0][0], out[1][0], out[0][1], out[1][1]]


def box_labels(labels: Column, n: Column) -> Column:
    """The first n labels, ones where there are fewer."""
    return F.slice(F.concat(F.coalesce(labels, F.expr("CAST(array() AS array<int>)")), F.array_repeat(F.lit(1), n.cast("int"))), F.lit(1), n.cast("int"))


def gray(z: Column, low: Column, high: Column) -> Column:
    """(z - low) / (high - low) in 0-255, truncated; out of range it wraps as a byte does; an empty range gives 0."""
    return F.when(high == low, F.lit(0)).otherwise(F.pmod(F.try_divide(z - low, high - low).__mul__(255.0).cast("int"), F.lit(256)))


def minmax_byte(v: Column, low: Column, high: Column) -> Column:
    """The same, clipped to 0-255; a constant gives 0."""
    return F.when(high <= low, F.lit(0)).otherwise(F.least(F.greatest(F.try_divide(v - low, high - low) * 255.0, F.lit(0.0)), F.lit(255.0)).cast("int"))


def parsed_numbers(c: Column, n: int) -> Column:
    """The n finite numbers of a comma-separated text; null if there are more, fewer or others."""
    parts = F.transform(F.split(c, ",", -1), lambda p: parse_number(p))
    return F.when((F.size(parts) == n) & F.forall(parts, lambda p: p.isNotNull()), parts)


def bbox_prompt(c: Column) -> Column:
    """struct<box, error>: four numbers with x2 > x1 and y2 > y1, or what is wrong."""
    count = F.size(F.split(c, ",", -1))
    box = parsed_numbers(c, 4)
    error = F.when(c.isNull() | (count != 4), "count").when(box.isNull(), "number").when((box[2] <= box[0]) | (box[3] <= box[1]), "order")
    return F.struct(F.when(error.isNull(), F.struct(*[box[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])).alias("box"), error.alias("error"))


def point_prompt(c: Column) -> Column:
    """struct<point, error>: two numbers, or what is wrong."""
    count = F.size(F.split(c, ",", -1))
    point = parsed_numbers(c, 2)
    error = F.when(c.isNull() | (count != 2), "count").when(point.isNull(), "number")
    return F.struct(F.when(error.isNull(), F.struct(point[0].alias("x"), point[1].alias("y"))).alias("point"), error.alias("error"))


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """bbox_prompt for an argument of a command; raises ValueError."""
    parts = text.split(",")
    if len(parts) != 4:
        raise ValueError(f"a box needs four numbers: {text!r}")
    try:
        x1, y1, x2, y2 = (float(p) for p in parts)
    except ValueError:
        raise ValueError(f"a box holds something that is no number: {text!r}") from None
    if x2 <= x1 or y2 <= y1:
        raise ValueError(f"a box ends before it begins: {text!r}")
    return x1, y1, x2, y2


def parse_point(text: str) -> tuple[float, float]:
    """point_prompt for an argument of a command; raises ValueError."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError(f"a point needs two numbers: {text!r}")
    try:
        x, y = (float(p) for p in parts)
    except ValueError:
        raise ValueError(f"a point holds something that is no number: {text!r}") from None
    return x, y


def zone_of_name(stem: str) -> tuple[int, bool] | None:
    """utm_zone on the driver."""
    m = re.search(ZONE_NAME, stem.lower())
    return (int(m[1]), m[2] == "n") if m and 1 <= int(m[1]) <= 60 else None
