"""Queries that write files from the driver's tables and read them back by the engine's readers, and DuckDB SQL for their rows."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.geodesy import ALPHA, BETA, DELTA, EAST, SCALE, A, B, FLAT, _RECTIFYING, offset, world_to_pixel
from ..operators import detections as D
from ..operators import inventory as I
from ..operators import rasters as R
from ..operators.staged import shared_folder
from ..operators.tiles import Grid
from ..sources import formats, readers, writers
from . import docs
from . import workflows as W

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _folder(spark: SparkSession) -> Path:
    """A new folder that driver and executors share, as a path of the machine."""
    folder = Path(readers.local_path(shared_folder(spark))) / f"files-{uuid.uuid4().hex}"
    folder.mkdir(parents=True)
    return folder


# inventories

_STATUS = "CASE WHEN c_custkey % 5 = 0 THEN 'dead' WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 2 = 0 THEN ' Alive ' ELSE 'alive' END"


def _inventory_csv(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    comma = lambda c: F.replace(c.cast("string"), F.lit("."), F.lit(","))
    rows = _read(s, d, "customer").select(
        F.concat(F.lit("T"), k).alias("TreeID"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("S"), k)).alias("StemTag"), F.col("c_mktsegment").alias("Latin"), F.expr(_STATUS).alias("Status"),
        comma(k / 8).alias("PX"), F.when(k % 11 == 0, "n/a").otherwise(comma(k / 4)).alias("PY"), F.when(k % 13 == 0, "-1").otherwise((k % 900).cast("string")).alias("DBH"),
    )
    path = str(_folder(s) / "inventory")
    rows.write.option("sep", ";").option("header", True).csv(path)
    return I.clean_csv(readers.text_table(s, path), "Status", "alive", "PX", "PY", "DBH", "mm", 10.0, 60.0).drop("ord")


_INVENTORY_CSV = f"""SELECT 'T' || c_custkey AS tree_id, CASE WHEN c_custkey % 3 <> 0 THEN 'S' || c_custkey END AS stem_id, c_mktsegment AS species, trim({_STATUS}) AS status, c_custkey / 8.0::DOUBLE AS x, c_custkey / 4.0::DOUBLE AS y,
  (c_custkey % 900) / 10.0::DOUBLE AS dbh_cm FROM customer WHERE lower(trim({_STATUS})) = 'alive' AND c_custkey % 11 <> 0 AND c_custkey % 13 <> 0 AND c_custkey % 900 BETWEEN 100 AND 600"""

_UTM32 = 'PROJCS["WGS_1984_UTM_Zone_32N",GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",9.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def _layer(s: SparkSession, d: str) -> tuple[Path, int]:
    """Suppliers as a layer in UTM: every fourth a square with a hole, every ninth without a shape."""
    path, shapes, rows = _folder(s) / "layer.shp", [], []
    for (k,) in _read(s, d, "supplier").select("s_suppkey").orderBy("s_suppkey").collect():  # a layer is one file
        x, y = 400000.0 + k * 37 % 200000, 5200000.0 + k * 91 % 300000
        square = [[(x, y), (x, y + 8), (x + 8, y + 8), (x + 8, y), (x, y)], [(x + 3, y + 2), (x + 7, y + 2), (x + 7, y + 6), (x + 3, y + 6), (x + 3, y + 2)]]
        shapes.append(None if k % 9 == 0 else square if k % 4 == 0 else (x, y))
        rows.append(["" if k % 6 == 0 else f"t{k}", "" if k % 5 == 0 else "dead" if k % 7 == 0 else "Alive", None if k % 8 == 0 else float(k % 90)])
    writers.write_layer(path, shapes, [("TREEID", "C", 12, 0), ("status", "C", 8, 0), ("Dbh", "N", 10, 3)], rows, _UTM32)
    return path, len(rows)


def _inventory_shp(s: SparkSession, d: str, low: float = 0.0) -> DataFrame:
    path, n = _layer(s, d)
    trees = I.clean_shapes(readers.shapes(s, str(path), max(1, n // 7)), "Status", "alive", "DBH", "cm", low)
    return trees.select("ord", "tree_id", "status", F.round("x", 7).alias("lon"), F.round("y", 7).alias("lat"), "dbh_cm")


def _inverse_sql(rows: str) -> str:
    """Longitude and latitude of rows with easting e and northing n in UTM zone 32, as lon and lat in degrees."""
    x = " - ".join(["eta", *(f"{b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(BETA, 1))])
    y = " - ".join(["xi", *(f"{b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(BETA, 1))])
    phi = " + ".join(["chi", *(f"{c!r} * sin({2 * j} * chi)" for j, c in enumerate(DELTA, 1))])
    return f"""SELECT * EXCLUDE (xi, eta, px, py, chi), 9 + degrees(atan2(sinh(px), cos(py))) AS lon, degrees({phi}) AS lat FROM (SELECT *, asin(sin(py) / cosh(px)) AS chi FROM (
SELECT *, {x} AS px, {y} AS py FROM (SELECT *, n / {SCALE * _RECTIFYING!r} AS xi, (e - {EAST}) / {SCALE * _RECTIFYING!r} AS eta FROM ({rows}))))"""


_PLACED = """SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_suppkey AS k, 400000.0::DOUBLE + s_suppkey * 37 % 200000 + CASE WHEN s_suppkey % 4 = 0 THEN (64 * 4 - 16 * 5) / 48.0::DOUBLE ELSE 0 END AS e,
  5200000.0::DOUBLE + s_suppkey * 91 % 300000 + CASE WHEN s_suppkey % 4 = 0 THEN 4 ELSE 0 END AS n FROM supplier"""
_INVENTORY_SHP = f"""SELECT ord, CASE WHEN k % 6 = 0 THEN 'shp_' || ord ELSE 't' || k END AS tree_id, CASE WHEN k % 5 = 0 THEN 'alive' ELSE 'Alive' END AS status, round(lon, 7) AS lon, round(lat, 7) AS lat,
  CASE WHEN k % 8 = 0 OR k % 90 = 0 THEN -1 ELSE k % 90 END::DOUBLE AS dbh_cm FROM ({_inverse_sql(_PLACED)}) WHERE k % 9 <> 0 AND (k % 5 = 0 OR k % 7 <> 0)"""


def _ordered(s: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    trees = _read(s, d, "orders").select(k.alias("ord"), F.when(k % 40 == 1, "").otherwise(F.concat(F.lit("T"), F.col("o_custkey"))).alias("tree_id"), (k * 7 % 1000 / 8).alias("lon"), (k * 3 % 1000 / 8).alias("lat"), (F.col("o_custkey") % 9).cast("double").alias("dbh_cm"))
    return I.in_id_order(I.deduplicate(trees), "lon", "lat").select("ord", "tree_id", "lon", "lat", "dbh_cm")


_ORDERED = """SELECT row_number() OVER (ORDER BY tree_id, lon, lat, ord) AS ord, tree_id, lon, lat, dbh_cm FROM (
SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 40 = 1 THEN '' ELSE 'T' || o_custkey END AS tree_id, o_orderkey * 7 % 1000 / 8.0::DOUBLE AS lon, o_orderkey * 3 % 1000 / 8.0::DOUBLE AS lat, (o_custkey % 9)::DOUBLE AS dbh_cm FROM orders
QUALIFY tree_id = '' OR row_number() OVER (PARTITION BY tree_id ORDER BY CASE WHEN dbh_cm > 0 THEN dbh_cm ELSE -1 END DESC, o_orderkey) = 1)"""


def _english(s: SparkSession, d: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in [*I.ENGLISH_NAMES][:29]], F.lit("Malus domestica"), F.lit(" "))
    k = F.col("l_partkey")
    rows = _read(s, d, "lineitem").select(F.element_at(names, (k % 31 + 1).cast("int")).alias("Latin"), F.col("l_orderkey").alias("TreeID"), F.col("l_suppkey").alias("StemID"))
    return I.summarise(rows, "Latin", "TreeID", "StemID", I.ENGLISH_NAMES)


_TITLE = "array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr({0}, (i - 1)::INT, 1), '[A-Za-z]') THEN upper(substr({0}, i::INT, 1)) ELSE lower(substr({0}, i::INT, 1)) END), '')"
_ENGLISH = f"""WITH n(i, latin, english) AS (VALUES {", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate([*list(I.ENGLISH_NAMES.items())[:29], ("Malus domestica", "Malus domestica"), ("(missing)", "(missing)")]))}),
g AS (SELECT i, count(*) AS records, count(DISTINCT l_orderkey) AS unique_trees, count(DISTINCT l_suppkey) AS unique_stems FROM lineitem JOIN n ON l_partkey % 31 = i GROUP BY i)
SELECT latin AS latin_name, records, unique_trees, unique_stems, records * 100.0::DOUBLE / sum(records) OVER () AS share, CASE WHEN english LIKE '(%' THEN english ELSE {_TITLE.format("english")} END AS english_name FROM g JOIN n USING (i)"""

# tables of labels


def _weak_csv(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 37 % 500, k * 91 % 400
    rows = _read(s, d, "supplier").select(C.tile_id(k % 5 * 896, k % 3 * 896).alias("tile_id"), *[c.cast("string").alias(n) for c, n in ((x / 4, "bbox_x1"), (y / 4, "bbox_y1"), (x / 4 + 1 + k % 9, "bbox_x2"), (y / 4 + 2, "bbox_y2"))])
    path = str(_folder(s) / "weak")
    rows.write.option("header", True).csv(path)
    return readers.weak_boxes(s, path).drop("ord")


_WEAK_CSV = """SELECT concat('tile_x', s_suppkey % 5 * 896, '_y', s_suppkey % 3 * 896) AS tile_id, s_suppkey * 37 % 500 / 4.0::DOUBLE AS bx1, s_suppkey * 91 % 400 / 4.0::DOUBLE AS by1,
  s_suppkey * 37 % 500 / 4.0::DOUBLE + 1 + s_suppkey % 9 AS bx2, s_suppkey * 91 % 400 / 4.0::DOUBLE + 2 AS by2 FROM supplier"""


def _label_layer(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    number = lambda c, n: c.cast("double").alias(n)
    labels = _read(s, d, "supplier").select(
        C.tile_id(k % 5 * 896, F.lit(0)).alias("tile_id"), F.concat(F.lit("t"), k).alias("tree_id"), (k * 7 % 1024).cast("int").alias("x_pixel"), (k * 3 % 1024).cast("int").alias("y_pixel"), number(k / 8, "crown_radius"),
        number(k / 16, "bbox_x1"), number(k / 4, "bbox_y1"), number(k / 16 + 2, "bbox_x2"), number(k / 4 + 3, "bbox_y2"), number(9 + k / 65536, "x_long_wgs84"), number(48 + k / 32768, "y_lat_wgs84"), number(k % 90, "dbh_cm"),
    ).orderBy("tree_id")
    path = _folder(s) / "labels.shp"
    writers.write_label_layer(labels, path)
    got = readers.shapes(s, str(path))
    return got.select("tile_id", "tree_id", F.col("x_pixel").cast("int").alias("x_pixel"), F.col("y_pixel").cast("int").alias("y_pixel"), *[F.col(c).cast("double").alias(c) for c in ("crown_px", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "dbh_cm")], F.round("x", 9).alias("lon"), F.round("y", 9).alias("lat"))


_LABEL_LAYER = """SELECT concat('tile_x', s_suppkey % 5 * 896, '_y0') AS tile_id, 't' || s_suppkey AS tree_id, (s_suppkey * 7 % 1024)::INT AS x_pixel, (s_suppkey * 3 % 1024)::INT AS y_pixel, round_even(s_suppkey / 8.0::DOUBLE, 3) AS crown_px, round_even(s_suppkey / 16.0::DOUBLE, 3) AS bbox_x1,
  s_suppkey / 4.0::DOUBLE AS bbox_y1, round_even(s_suppkey / 16.0::DOUBLE + 2, 3) AS bbox_x2, s_suppkey / 4.0::DOUBLE + 3 AS bbox_y2, (s_suppkey % 90)::DOUBLE AS dbh_cm, round(9 + s_suppkey / 65536.0::DOUBLE, 9) AS lon, round(48 + s_suppkey / 32768.0::DOUBLE, 9) AS lat FROM supplier"""

# rasters

WIDTH, HEIGHT, TILE, OVERLAP = 500, 380, 128, 32
_PLACE = formats.RasterMeta(WIDTH, HEIGHT, 3, 600000.0, 5300000.0, 0.5, -0.5, "EPSG:32632", -9.0)


def _raster(s: SparkSession, kind: str = "lzw", big: bool = True) -> Path:
    """An image whose pixels follow from their places."""
    y, x, c = np.meshgrid(np.arange(HEIGHT), np.arange(WIDTH), np.arange(3), indexing="ij")
    path = _folder(s) / "Flight_utm32n.tif"
    path.write_bytes(formats.tiff_encode(((x * 7 + y * 13 + c * 29) % 251).astype(np.uint8), _PLACE, kind, kind == "lzw", 37, big))
    return path


_PIXELS = f"SELECT x.i AS x, y.i AS y, c.i AS c, (x.i * 7 + y.i * 13 + c.i * 29) % 251 AS v FROM range({WIDTH}) x(i), range({HEIGHT}) y(i), range(3) c(i)"


def _tiles_sql(size: int = TILE, overlap: int = OVERLAP) -> str:
    step = size - overlap
    return f"SELECT 'tile_x' || x0 || '_y' || y0 AS tile_id, x0, y0, least(x0 + {size}, {WIDTH}) AS x1, least(y0 + {size}, {HEIGHT}) AS y1 FROM (SELECT unnest(range(0, {WIDTH}, {step})) AS x0), (SELECT unnest(range(0, {HEIGHT}, {step})) AS y0)"


def _sums(tiles: DataFrame) -> DataFrame:
    """The number and the sum of the values in each tile's pixels, without the fourth channel."""
    size = F.col("width") * F.col("height")

    def add(frames):
        for pdf in frames:
            got = [np.frombuffer(b, dtype=np.uint8).reshape(-1, c)[:, :3].astype(np.int64) for b, c in zip(pdf.data, pdf.channels, strict=True)]
            pdf["total"] = [int(a.sum()) for a in got]
            yield pdf[["tile_id", "pixels", "total"]]

    return tiles.withColumn("pixels", size.cast("long")).select("tile_id", "pixels", "channels", "data").mapInPandas(add, "tile_id string, pixels long, total long")


def _tiff_tiles(s: SparkSession, d: str) -> DataFrame:
    path = str(_raster(s))
    meta = readers.raster_meta(s, path)
    return _sums(readers.raster_tiles(s, path, Grid(meta.width, meta.height, TILE, OVERLAP).frame(s)))


_SUMS = "SELECT tile_id, (count(*) // 3)::BIGINT AS pixels, sum(v)::BIGINT AS total FROM ({0}) JOIN ({1}) ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY 1"


def _raster_info(s: SparkSession, d: str) -> DataFrame:
    m = readers.raster_meta(s, str(_raster(s, "none", False)))
    row = [(m.width, m.height, m.bands, m.channels, m.origin_x, m.origin_y, m.pixel_x, m.pixel_y, m.crs, m.nodata)]
    return s.createDataFrame(row, "width int, height int, bands int, channels int, origin_x double, origin_y double, pixel_x double, pixel_y double, crs string, nodata double")


def _tiles_joined(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    W.write_tiles(s, str(_raster(s, "deflate")), str(folder), TILE, TILE, OVERLAP)
    return _sums(W.reconstructed(s, str(folder), 100)[0])


def _tile_metadata(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    n = W.write_tiles(s, str(_raster(s, "none")), str(folder), TILE, 100, 20)
    about = s.read.option("multiLine", True).json(str(folder / "metadata.json"))
    return about.select(F.lit(n).cast("long").alias("tiles"), F.to_json("original_shape").alias("original_shape"), F.to_json("tile_size").alias("tile_size"), F.to_json("overlap").alias("overlap"))


def _prompt_boxes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = k * 37 % 480, k * 91 % 360
    return _read(s, d, "supplier").select("s_suppkey", *[c.cast("double").alias(n) for c, n in ((x, "bx1"), (y, "by1"), (x + 3 + k % 17, "bx2"), (y + 3 + k % 11, "by2"))])


def _prompts(s: SparkSession, d: str) -> list[tuple[float, float, float, float]]:
    return [tuple(r) for r in _prompt_boxes(s, d).orderBy("s_suppkey").drop("s_suppkey").collect()]  # prompts are arguments


_PROMPTS = "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ord, s_suppkey * 37 % 480 AS bx1, s_suppkey * 91 % 360 AS by1, s_suppkey * 37 % 480 + 3 + s_suppkey % 17 AS bx2, s_suppkey * 91 % 360 + 3 + s_suppkey % 11 AS by2 FROM supplier"
_CUT = f"""SELECT *, greatest(bx1, x0) AS a, greatest(by1, y0) AS b, least(bx2, x1) AS c, least(by2, y1) AS e, row_number() OVER (PARTITION BY tile_id ORDER BY ord) - 1 AS k
  FROM ({_PROMPTS}) JOIN ({_tiles_sql()}) ON bx1 < x1 AND bx2 > x0 AND by1 < y1 AND by2 > y0"""


def _archives(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Path]:
    path, folder = str(_raster(s)), _folder(s)
    merged, kept, index = W.predict_masks(s, path, W.Prompts(boxes=_prompts(s, d)), W.BoxBackend(), tile_size=TILE, overlap=OVERLAP)
    W.write_predictions(s, path, folder, W.Prompts(), merged, kept, index, archive=False)
    return merged, index, folder


def _tile_archives(s: SparkSession, d: str) -> DataFrame:
    runs, _ = readers.tile_masks(s, str(_archives(s, d)[2] / "masks" / "tiles"), WIDTH, HEIGHT)
    return runs.groupBy("label_id").agg(F.first("mask_area").alias("mask_area"), F.sum(F.col("x1") - F.col("x0")).alias("pixels"), F.min("x0").alias("x0"), F.min("y").alias("y0"), F.round(F.first("score"), 3).alias("score"))


_TILE_ARCHIVES = f"SELECT row_number() OVER (ORDER BY y0, x0, k) - 1 AS label_id, (c - a) * (e - b) AS mask_area, ((c - a) * (e - b))::BIGINT AS pixels, a AS x0, b AS y0, 0.9::DOUBLE AS score FROM ({_CUT})"


def _tile_index(s: SparkSession, d: str) -> DataFrame:
    folder = _archives(s, d)[2] / "masks" / "tiles" / "index.csv"
    t = readers.text_table(s, str(folder), ",")
    return t.select("tile_id", *[F.col(c).cast("long").alias(c) for c in ("x0", "y0", "width", "height", "count")])


_TILE_INDEX = f"WITH n AS (SELECT tile_id, count(*) AS n FROM ({_CUT}) GROUP BY 1) SELECT tile_id, x0, y0, x1 - x0 AS width, y1 - y0 AS height, coalesce(n, 0) AS count FROM ({_tiles_sql()}) LEFT JOIN n USING (tile_id)"


def _merged_archive(s: SparkSession, d: str) -> DataFrame:
    boxes = D.ranked(_prompt_boxes(s, d), F.col("s_suppkey")).withColumn("place", F.col("rank") - 1)
    n = boxes.count()
    path = _folder(s) / "merged.npz"
    writers.write_masks(boxes, lambda r: formats.box_mask((r.bx1, r.by1, r.bx2, r.by2), WIDTH, HEIGHT), n, WIDTH, HEIGHT, path, scores=(np.arange(n) % 7 / 8).astype(np.float32))
    runs = readers.merged_masks(s, str(path))
    return runs.groupBy("label_id").agg(F.first("score").alias("score"), F.first("mask_area").alias("mask_area"), F.count("y").alias("lines"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


_MERGED_ARCHIVE = f"SELECT ord AS label_id, ord % 7 / 8.0::DOUBLE AS score, (bx2 - bx1) * (by2 - by1) AS mask_area, by2 - by1 AS lines, bx1::INT AS x0, bx2::INT AS x1 FROM ({_PROMPTS})"


def _validated(s: SparkSession, d: str) -> DataFrame:
    """Stems at places that tell which box of disjoint ones holds them, so that the matching needs no walk."""
    k = F.col("ord")
    boxes = s.range(200).select(k := F.col("id").alias("label_id"), F.lit(0.5).alias("score"), F.lit(100).cast("long").alias("mask_area"), (F.col("id") % 20 * 24).alias("bx"), F.expr("id div 20 * 30").alias("by"))
    runs = boxes.withColumn("y", F.explode(F.sequence("by", F.col("by") + 9))).select("label_id", "score", "mask_area", F.col("y").cast("int").alias("y"), F.col("bx").cast("int").alias("x0"), (F.col("bx") + 10).cast("int").alias("x1"))
    k = F.col("c_custkey")
    trees = _read(s, d, "customer").select(k.alias("ord"), F.concat(F.lit("t"), k).alias("tree_id"), F.when(k % 3 == 0, F.concat(F.lit("s"), k)).alias("stem_id"), (k * 7 % 510 + 0.5).alias("x"), (k * 11 % 390 - 0.5).alias("y"))
    table, _ = W.validate(s, trees, runs, None, 480, 300)
    return table.select("tree_id", "stem_id", "label_id", "tree_pos_x", "tree_pos_y", "prediction_coverage")


_VALIDATED = """WITH t AS (SELECT c_custkey AS ord, 't' || c_custkey AS tree_id, CASE WHEN c_custkey % 3 = 0 THEN 's' || c_custkey ELSE 't' || c_custkey END AS stem_id, c_custkey * 7 % 510 + 0.5::DOUBLE AS x, c_custkey * 11 % 390 - 0.5::DOUBLE AS y FROM customer),
p AS (SELECT *, round_even(x, 0)::INT AS px, round_even(y, 0)::INT AS py FROM t), v AS (SELECT * FROM p WHERE px >= 0 AND px < 480 AND py >= 0 AND py < 300),
h AS (SELECT ord, (px // 24 + py // 30 * 20)::INT AS label FROM v WHERE px % 24 < 10 AND py % 30 < 10 QUALIFY row_number() OVER (PARTITION BY label ORDER BY ord) = 1)
SELECT tree_id, stem_id, label AS label_id, x AS tree_pos_x, y AS tree_pos_y, true AS prediction_coverage FROM v LEFT JOIN h USING (ord)"""


def _las_grid(s: SparkSession, d: str) -> DataFrame:
    path = _folder(s) / "points.las"
    n = writers.write_las(_read(s, d, "lineitem").select("l_quantity", F.round(F.col("l_discount") * 100, 0).alias("y"), "l_extendedprice"), path, 0.01)
    points = readers.las(s, str(path), rows=min(max(1000, n // 7), 1_000_000))
    return R.cells(points.select(F.round("x", 2).alias("x"), F.round("y", 2).alias("y"), F.round("z", 2).alias("z")), R.GridSpec(1.0, 0.0, 2.5, 20, 4), "max")


_LAS_GRID = "SELECT row, col, max(z)::FLOAT AS z FROM (SELECT least(greatest(trunc(round(l_discount * 100, 0) / 2.5)::INT, 0), 3) AS row, least(greatest(trunc((l_quantity - 1.0) / 2.5)::INT, 0), 19) AS col, round(l_extendedprice, 2) AS z FROM lineitem) GROUP BY 1, 2"


def _grid_overlay(s: SparkSession, d: str) -> DataFrame:
    cells = _read(s, d, "part").select((F.col("p_partkey") % 40).cast("int").alias("row"), (F.col("p_partkey") * 7 % 60).cast("int").alias("col"), "p_size").groupBy("row", "col").agg(F.max("p_size").cast("float").alias("z"))
    gray = R.flipped(R.gray_cells(cells, 0.0, 64.0), 40)
    i = F.col("id")
    image = s.range(40 * 60).select(F.expr("CAST(id div 60 AS INT)").alias("row"), (i % 60).cast("int").alias("col"), F.lit(0).alias("channel"), (i * 31 % 256).cast("int").alias("value"))
    return R.crop(R.overlay(image, gray), 5, 3, 50, 33)


_GRID_OVERLAY = """WITH c AS (SELECT p_partkey % 40 AS row, p_partkey * 7 % 60 AS col, max(p_size)::FLOAT AS z FROM part GROUP BY 1, 2), g AS (SELECT 39 - row AS row, col, trunc(z::DOUBLE / 64 * 255)::INT % 256 AS gray FROM c),
i AS (SELECT id // 60 AS row, id % 60 AS col, id * 31 % 256 AS value FROM range(2400) t(id))
SELECT (row - 3)::INT AS row, (col - 5)::INT AS col, 0 AS channel, (value * gray % 256)::INT AS value FROM i JOIN g USING (row, col) WHERE row >= 3 AND row < 33 AND col >= 5 AND col < 50"""

# places


def _offset(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _read(s, d, "customer").select(k.alias("ord"), offset(6 + (k % 600) / 100.0, 47 + (k % 700) / 100.0, (k % 401 - 200).cast("double"), (k % 307 - 150).cast("double")).alias("p"))
    return rows.select("ord", F.round("p.lon", 9).alias("lon"), F.round("p.lat", 9).alias("lat"))


def _direct_sql(rows: str, azimuth: str, metres: str) -> str:
    """Vincenty's direct solution for rows with ord, lon, lat: where they come by metres along an azimuth (radians); 0 metres leave a place as it is."""
    k = (A * A - B * B) / (B * B)
    step = f"SELECT * REPLACE (s0 + bb * sin(sigma) * (cos(2 * s1 + sigma) + bb / 4 * (cos(sigma) * (2 * pow(cos(2 * s1 + sigma), 2) - 1) - bb / 6 * cos(2 * s1 + sigma) * (4 * pow(sin(sigma), 2) - 3) * (4 * pow(cos(2 * s1 + sigma), 2) - 3))) AS sigma) FROM "
    q = f"SELECT *, atan({1 - FLAT!r} * tan(radians(lat))) AS u, {azimuth}::DOUBLE AS az, {metres}::DOUBLE AS m FROM ({rows})"
    q = f"SELECT *, atan2(tan(u), cos(az)) AS s1, cos(u) * sin(az) AS sa FROM ({q})"
    q = f"SELECT *, 1 - sa * sa AS c2, (1 - sa * sa) * {k!r} AS kk FROM ({q})"
    q = f"SELECT *, 1 + kk / 16384 * (4096 + kk * (-768 + kk * (320 - 175 * kk))) AS ba, kk / 1024 * (256 + kk * (-128 + kk * (74 - 47 * kk))) AS bb FROM ({q})"
    q = f"SELECT *, m / ({B!r} * ba) AS s0, m / ({B!r} * ba) AS sigma FROM ({q})"
    for _ in range(8):
        q = f"{step}({q})"
    q = f"SELECT *, cos(2 * s1 + sigma) AS cm, sin(sigma) AS ss, cos(sigma) AS cs, {FLAT!r} / 16 * c2 * (4 + {FLAT!r} * (4 - 3 * c2)) AS cc FROM ({q})"
    lam = f"(atan2(ss * sin(az), cos(u) * cs - sin(u) * ss * cos(az)) - (1 - cc) * {FLAT!r} * sa * (sigma + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))))"
    phi = f"atan2(sin(u) * cs + cos(u) * ss * cos(az), {1 - FLAT!r} * sqrt(sa * sa + pow(sin(u) * ss - cos(u) * cs * cos(az), 2)))"
    return f"SELECT ord, CASE WHEN m = 0 THEN lon ELSE lon + degrees({lam}) END AS lon, CASE WHEN m = 0 THEN lat ELSE degrees({phi}) END AS lat FROM ({q})"


def _offset_sql() -> str:
    rows = "SELECT c_custkey AS ord, 6 + (c_custkey % 600) / 100.0::DOUBLE AS lon, 47 + (c_custkey % 700) / 100.0::DOUBLE AS lat FROM customer"
    east = _direct_sql(rows, f"CASE WHEN ord % 401 >= 200 THEN {math.pi / 2!r} ELSE {3 * math.pi / 2!r} END", "abs(ord % 401 - 200)")
    north = _direct_sql(east, f"CASE WHEN ord % 307 >= 150 THEN 0 ELSE {math.pi!r} END", "abs(ord % 307 - 150)")
    return f"SELECT ord, round(lon, 9) AS lon, round(lat, 9) AS lat FROM ({north})"


def _to_pixels(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _read(s, d, "customer").select(k.alias("ord"), (8.9 + k % 400 / 1000.0).alias("lon"), (47.5 + k % 700 / 1000.0).alias("lat"))
    placed = W.in_pixels(rows, _PLACE, "Flight_utm32n")
    return placed.select("ord", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def _to_pixels_sql() -> str:
    n = FLAT / (2 - FLAT)
    e = 2 * n**0.5 / (1 + n)
    x = " + ".join(["eta", *(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))])
    y = " + ".join(["xi", *(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))])
    return f"""WITH p AS (SELECT c_custkey AS ord, radians(47.5 + c_custkey % 700 / 1000.0::DOUBLE) AS phi, radians(8.9 + c_custkey % 400 / 1000.0::DOUBLE - 9) AS lam FROM customer),
t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS t FROM p), u AS (SELECT ord, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT ord, round(({EAST} + {SCALE * _RECTIFYING!r} * ({x}) - {_PLACE.origin_x}) / {_PLACE.pixel_x}, 4) AS x, round(({SCALE * _RECTIFYING!r} * ({y}) - {_PLACE.origin_y}) / {_PLACE.pixel_y}, 4) AS y FROM u"""


# names, labels, runs


def _names(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _read(s, d, "customer").select(k.alias("ord"), C.legacy_tile_name(k, k * 37 % 5000 - 50, k * 91 % 4000, k % 129, "npz").alias("name"))
    shown = F.when(F.col("ord") % 10 == 0, F.lit("out/preview.png")).otherwise(F.concat(F.lit("out/"), "name"))
    return rows.select("ord", "name", C.legacy_tile(shown).alias("t")).select("ord", "name", "t.index", "t.x", "t.y", "t.overlap")


_NAMES = """SELECT c_custkey AS ord, printf('tile_%04d_x%d_y%d_overlap%d.npz', c_custkey, c_custkey * 37 % 5000 - 50, c_custkey * 91 % 4000, c_custkey % 129) AS name, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey END AS "index",
  CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 37 % 5000 - 50 END AS x, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey * 91 % 4000 END AS y, CASE WHEN c_custkey % 10 <> 0 THEN c_custkey % 129 END AS overlap FROM customer"""


def _run_totals(s: SparkSession, d: str) -> DataFrame:
    """A run of which an earlier one has left some tiles."""
    path, out = str(_raster(s)), _folder(s)
    W.predict_cached(s, path, out, _Fixed(), "tree", TILE, OVERLAP, most=7)
    got = W.predict_cached(s, path, out, _Fixed(), "tree", TILE, OVERLAP, start=(1, 0))
    return s.createDataFrame([tuple(got[k] for k in ("tiles", "processed", "skipped", "masks"))], "tiles long, processed long, skipped long, masks long")


class _Fixed:
    """A stand-in for a model: one mask a tile."""

    reads_text = True

    def predict(self, pixels, text, boxes, points):
        mask = np.zeros((1, *pixels.shape[:2]), dtype=bool)
        mask[0, 2:6, 3:9] = True
        return mask, None, np.array([0.5])


#: The first run leaves the six tiles of the first row and one of the second; the second run begins a tile's width later, on places of its own.
_STEP = TILE - OVERLAP
_RUN_TOTALS = f"""WITH a AS (SELECT x, y FROM (SELECT unnest(range(0, {WIDTH}, {_STEP})) AS x), (SELECT unnest(range(0, {HEIGHT}, {_STEP})) AS y) ORDER BY y, x LIMIT 7),
b AS (SELECT x, y FROM (SELECT unnest(range({TILE}, {WIDTH}, {_STEP})) AS x), (SELECT unnest(range(0, {HEIGHT}, {_STEP})) AS y)),
t AS (SELECT count(*) AS n, count(a.x) AS hit FROM b LEFT JOIN a USING (x, y)) SELECT n AS tiles, n - hit AS processed, hit AS skipped, n - hit AS masks FROM t"""


def _docstrings(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    for k, name in _read(s, d, "nation").select("n_nationkey", "n_name").collect():
        head = f'"""{name}."""\n' if k % 3 else ""
        body = "".join(f'def {"_" * (j % 2)}f{j}():\n    {chr(34) * 3}Does {j}.{chr(34) * 3}\n\n\n' if (j + k) % 4 else f"def {'_' * (j % 2)}f{j}():\n    pass\n\n\n" for j in range(k))
        (folder / f"m{k}.py").write_text(f"{head}class K:\n    {'x = 1' if k % 2 else chr(34) * 3 + 'A class.' + chr(34) * 3}\n\n\n{body}")
    return docs.coverage(docs.definitions(s, str(folder)))


_DOCSTRINGS = """WITH f AS (SELECT n_nationkey AS k, unnest(range(n_nationkey)) AS j FROM nation)
SELECT 'modules' AS category, count(*) AS total, count(*) FILTER (n_nationkey % 3 <> 0) AS documented FROM nation UNION ALL SELECT 'classes', count(*), count(*) FILTER (n_nationkey % 2 = 0) FROM nation
UNION ALL SELECT CASE WHEN j % 2 = 1 THEN 'private functions' ELSE 'public functions' END, count(*), count(*) FILTER ((j + k) % 4 <> 0) FROM f GROUP BY 1"""


def _labels(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = _read(s, d, "part").select(k, F.slice(F.array(F.lit(0), F.lit(1), F.lit(0)), F.lit(1), (k % 4).cast("int")).alias("given"), (k % 6).alias("n"), D.label_matches(F.col("p_name"), " ALMOND ").alias("hit"))
    return rows.select("p_partkey", "hit", F.array_join(F.transform(C.box_labels(F.when(F.col("p_partkey") % 5 != 0, F.col("given")), F.col("n")), lambda x: x.cast("string")), ",").alias("labels"))


_LABELS = """SELECT p_partkey, contains(lower(p_name), 'almond') AS hit, array_to_string(list_transform(range(1, (p_partkey % 6)::BIGINT + 1), lambda i: CASE WHEN p_partkey % 5 <> 0 AND i <= p_partkey % 4 THEN (i + 1) % 2 ELSE 1 END), ',') AS labels FROM part"""

_START = Grid(5000, 4000, 1024, 128)


def _run_metadata(s: SparkSession, d: str) -> DataFrame:
    folder = _folder(s)
    W.write_run_metadata(folder, str(folder / "a.tif"), 640, 64, W.Prompts("tree", _prompts(s, d)), "sam3", "predict")
    got = s.read.option("multiLine", True).json(str(folder / "run_metadata.json"))
    return got.select("tile.size", "tile.overlap", "prompt.text", F.size("prompt.bbox_prompts").alias("boxes"), F.aggregate(F.flatten("prompt.bbox_prompts"), F.lit(0.0), lambda a, x: a + x).alias("sum"), "model", "command")


ALL: dict[str, tuple[Query, str]] = {
    "inventory_csv": (_inventory_csv, _INVENTORY_CSV),
    "inventory_shp": (_inventory_shp, _INVENTORY_SHP),
    "inventory_shp_range": (lambda s, d: _inventory_shp(s, d, 20.0), _INVENTORY_SHP + " AND k % 8 <> 0 AND k % 90 >= 20"),
    "inventory_order": (_ordered, _ORDERED),
    "species_english": (_english, _ENGLISH),
    "weak_csv": (_weak_csv, _WEAK_CSV),
    "label_layer": (_label_layer, _LABEL_LAYER),
    "raster_info": (_raster_info, f"SELECT {WIDTH} AS width, {HEIGHT} AS height, 3 AS bands, 3 AS channels, 600000::DOUBLE AS origin_x, 5300000::DOUBLE AS origin_y, 0.5::DOUBLE AS pixel_x, -0.5::DOUBLE AS pixel_y, 'EPSG:32632' AS crs, -9::DOUBLE AS nodata"),
    "raster_tiles": (_tiff_tiles, _SUMS.format(_PIXELS, _tiles_sql())),
    "tiles_joined": (_tiles_joined, _SUMS.format(_PIXELS, _tiles_sql(100, 0))),
    "tile_metadata": (_tile_metadata, f"SELECT 25::BIGINT AS tiles, '[{HEIGHT},{WIDTH},3]' AS original_shape, '[{TILE},100]' AS tile_size, '[20,20]' AS overlap"),
    "tile_archives": (_tile_archives, _TILE_ARCHIVES),
    "tile_index": (_tile_index, _TILE_INDEX),
    "merged_archive": (_merged_archive, _MERGED_ARCHIVE),
    "validated_stems": (_validated, _VALIDATED),
    "las_grid": (_las_grid, _LAS_GRID),
    "height_overlay": (_grid_overlay, _GRID_OVERLAY),
    "geodesic_offset": (_offset, _offset_sql()),
    "world_to_pixel": (_to_pixels, _to_pixels_sql()),
    "legacy_names": (_names, _NAMES),
    "label_prompts": (_labels, _LABELS),
    "run_totals": (_run_totals, _RUN_TOTALS),
    "run_metadata": (_run_metadata, f"SELECT 640 AS size, 64 AS overlap, 'tree' AS text, count(*)::INT AS boxes, sum(bx1 + by1 + bx2 + by2)::DOUBLE AS sum, 'sam3' AS model, 'predict' AS command FROM ({_PROMPTS})"),
    "docstring_coverage": (_docstrings, _DOCSTRINGS),
    "tile_grid_part": (lambda s, d: _START.frame(s, (2, 1), 9), "SELECT 'tile_x' || x0 || '_y' || y0 AS tile_id, x0::INT AS x0, y0::INT AS y0, least(x0 + 1024, 5000)::INT AS x1, least(y0 + 1024, 4000)::INT AS y1 FROM (SELECT unnest(range(2048, 5000, 896)) AS x0), (SELECT unnest(range(1024, 4000, 896)) AS y0) ORDER BY y0, x0 LIMIT 9"),
}
