"""The four workflows: weak labels, mask prediction, validation of predictions, image tiles; and the height map and species summary."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import drawing
from ..functions import pixels as rasters
from ..functions.columns import Crown, legacy_tile, legacy_tile_name, round_even, tile_id, tile_origin
from ..functions.geodesy import metres_to_pixels, offset, origin_wgs84, to_raster, world_to_pixel
from ..operators import detections as D
from ..operators import inventory as I
from ..operators import rasters as R
from ..operators import tiles as T
from ..operators.staged import staged
from ..operators.tiles import Grid
from ..sources import formats, readers, writers

#: Columns of the label table and of the validation table, in order.
LABEL_COLUMNS = ("tile_id", "tree_id", "x_pixel", "y_pixel", "crown_radius", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "x_long_wgs84", "y_lat_wgs84", "dbh_cm")
MATCH_COLUMNS = ("tree_id", "stem_id", "label_id", "tree_pos_x", "tree_pos_y", "prediction_coverage")


@dataclass(frozen=True)
class InventoryOptions:
    """Where an inventory's values are and which trees count."""

    x_field: str = "PX"
    y_field: str = "PY"
    tree_id_field: str = "TreeID"
    stem_id_field: str = "StemTag"
    species_field: str = "Latin"
    status_field: str = "Status"
    status_filter: str = "alive"
    dbh_field: str = "DBH"
    dbh_unit: str = "mm"
    min_dbh_cm: float = 0.0
    max_dbh_cm: float = 0.0
    deduplicate: bool = False


def load_trees(spark: SparkSession, meta: formats.RasterMeta, options: InventoryOptions, csv: str | None = None, shp: str | None = None) -> DataFrame:
    """Trees in longitude and latitude from one table of text or of shapes; a text table's metres count from the raster's upper left corner."""
    if (csv is None) == (shp is None):
        raise ValueError("give an inventory as CSV or as shapefile, one of both")
    o = options
    if shp is not None:
        trees = I.clean_shapes(readers.shapes(spark, shp), o.status_field, o.status_filter, o.dbh_field, o.dbh_unit, o.min_dbh_cm, o.max_dbh_cm, o.tree_id_field, o.stem_id_field, o.species_field).withColumnsRenamed({"x": "lon", "y": "lat"})
    else:
        rows = I.clean_csv(readers.text_table(spark, csv), o.status_field, o.status_filter, o.x_field, o.y_field, o.dbh_field, o.dbh_unit, o.min_dbh_cm, o.max_dbh_cm, o.tree_id_field, o.stem_id_field, o.species_field)
        lon, lat = origin_wgs84(meta.origin_x, meta.origin_y, meta.crs)
        trees = rows.withColumn("_p", offset(F.lit(lon), F.lit(lat), F.col("x"), F.col("y"))).withColumns({"lon": F.col("_p.lon"), "lat": F.col("_p.lat")}).drop("_p", "x", "y")
    return I.in_id_order(I.deduplicate(trees, order=("ord",)), "lon", "lat") if o.deduplicate else trees


def in_pixels(trees: DataFrame, meta: formats.RasterMeta, stem: str) -> DataFrame:
    """x, y in unrounded pixels beside lon, lat."""
    x, y = world_to_pixel(*to_raster(F.col("lon"), F.col("lat"), meta.crs, stem), meta.origin_x, meta.origin_y, meta.pixel_x, meta.pixel_y)
    return trees.withColumns({"x": x, "y": y})


def make_weak_labels(spark: SparkSession, image: str, options: InventoryOptions, csv: str | None = None, shp: str | None = None, tile_size: int = 1024, overlap: int = 128, crown: Crown | None = None, padding: float = 4.0) -> DataFrame:
    """The label table of all tiles that hold a crown."""
    if padding < 0:
        raise ValueError("the padding must be at least 0")
    meta = readers.raster_meta(spark, image)
    trees = in_pixels(load_trees(spark, meta, options, csv, shp), meta, Path(image).stem)
    labels = T.weak_labels(trees, Grid(meta.width, meta.height, tile_size, overlap), crown or Crown(), 1 / metres_to_pixels(meta.pixel_x, meta.pixel_y), padding)
    out = labels.withColumns({"x_long_wgs84": round_even(F.col("lon"), 9), "y_lat_wgs84": round_even(F.col("lat"), 9), "dbh_cm": round_even(F.col("dbh_cm"), 3)})
    return out.orderBy("y0", "x0", "ord").select(*LABEL_COLUMNS)


def write_weak_labels(spark: SparkSession, labels: DataFrame, image: str, out: Path, tile_size: int, overlap: int, pictures: bool = False) -> dict[str, int]:
    """The label table as weak_labels.csv and as a layer of points, and, if asked for, the labelled tiles with their crowns and boxes; how many of each."""
    out.mkdir(parents=True, exist_ok=True)
    for old in ("weak_labels.yaml", "weak_labels.yml"):
        (out / old).unlink(missing_ok=True)
    kept = staged(labels.withColumn("_no", F.monotonically_increasing_id()))
    table = kept.orderBy("_no").drop("_no")
    write_csv(table, out / "weak_labels.csv")
    counts = {"labels": writers.write_label_layer(table, out / "weak_labels.shp")}
    if pictures:
        meta = readers.raster_meta(spark, image)
        trees = F.array_sort(F.collect_list(F.struct("_no", *[F.col(c).cast("double").alias(c) for c in ("x_pixel", "y_pixel", "crown_radius", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2")])))
        marked = Grid(meta.width, meta.height, tile_size, overlap).frame(spark).join(kept.groupBy("tile_id").agg(trees.alias("trees")), "tile_id")
        counts["pictures"] = writers.write_pictures(drawn(readers.raster_tiles(spark, image, marked), _draw_trees), out / "visualizations" / "tiles", "tif")
    return counts


def _draw_trees(pixels: np.ndarray, t: Any) -> np.ndarray:
    return drawing.draw_labels(pixels, [r.asDict() if hasattr(r, "asDict") else dict(r) for r in t.trees])


def drawn(tiles: DataFrame, draw: Callable[[np.ndarray, Any], np.ndarray]) -> DataFrame:
    """Tiles (tile_id, width, height, channels, data) as draw makes them of their pixels and their row."""

    def paint(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples():
                a = draw(np.frombuffer(t.data, dtype=np.uint8).reshape(t.height, t.width, t.channels), t)
                yield pd.DataFrame([(t.tile_id, a.shape[1], a.shape[0], a.shape[2], np.ascontiguousarray(a).tobytes())], columns=["tile_id", "width", "height", "channels", "data"])

    return tiles.mapInPandas(paint, "tile_id string, width int, height int, channels int, data binary")


@dataclass
class Prompts:
    """What the model is asked: a text, boxes and points in the image, boxes by tile."""

    text: str | None = None
    boxes: Sequence[tuple[float, float, float, float]] = ()
    points: Sequence[tuple[float, float]] = ()
    by_tile: DataFrame | None = None

    def check(self, model: str) -> None:
        if model not in ("sam3", "sam2", "dinov3"):
            raise ValueError(f"unknown model {model!r}")
        placed = bool(self.boxes or self.points or self.by_tile is not None)
        if model == "sam2" and self.text:
            raise ValueError("sam2 takes no text prompt")
        if model == "dinov3" and (placed or not self.text):
            raise ValueError("dinov3 takes a text prompt only")
        if not placed and not self.text:
            raise ValueError("give at least one prompt")


class Backend(Protocol):
    """A segmentation model on an executor: masks (n, height, width), boxes (n, 4) or none, and scores (n,) of a tile."""

    def predict(self, pixels: np.ndarray, text: str | None, boxes: list[list[float]], points: list[list[float]]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]: ...


@dataclass
class BoxBackend:
    """A stand-in without a model: every box is its own mask, every point a box of eight pixels around it."""

    score: float = 0.9
    reach: int = field(default=8)
    reads_text: bool = False

    def predict(self, pixels: np.ndarray, text: str | None, boxes: list[list[float]], points: list[list[float]]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
        h, w = pixels.shape[:2]
        all_ = [*boxes, *([max(0, x - self.reach), max(0, y - self.reach), min(w, x + self.reach), min(h, y + self.reach)] for x, y in points)]
        masks = np.stack([formats.box_mask(tuple(b), w, h) for b in all_]) if all_ else np.zeros((0, h, w), dtype=bool)
        return masks, np.array(all_, dtype=float).reshape(-1, 4), np.full(len(all_), self.score)


def prompt_tiles(spark: SparkSession, grid: Grid, prompts: Prompts) -> DataFrame:
    """Every tile with its boxes and points (empty arrays without), global boxes first, then those of the tile."""
    tiles = grid.frame(spark)
    boxes = spark.createDataFrame([(k, *map(float, b)) for k, b in enumerate(prompts.boxes)], "ord long, bx1 double, by1 double, bx2 double, by2 double")
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(prompts.points)], "ord long, x double, y double")
    local = T.boxes_in_tiles(boxes, grid).select("tile_id", F.struct(F.lit(0).alias("g"), "ord", F.array("lx1", "ly1", "lx2", "ly2").alias("v")).alias("b"))
    if prompts.by_tile is not None:
        own = prompts.by_tile.select("tile_id", F.struct(F.lit(1).alias("g"), F.col("ord").cast("long").alias("ord"), F.array("bx1", "by1", "bx2", "by2").alias("v")).alias("b"))
        local = local.unionByName(own)
    b = local.groupBy("tile_id").agg(F.array_sort(F.collect_list("b")).alias("b")).select("tile_id", F.col("b.v").alias("boxes"))
    p = T.points_in_tiles(points, grid).groupBy("tile_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.array("x_local", "y_local").alias("v")))).alias("p")).select("tile_id", F.col("p.v").alias("points"))
    none = F.expr("CAST(array() AS array<array<double>>)")
    return tiles.join(b, "tile_id", "left").join(p, "tile_id", "left").withColumns({"boxes": F.coalesce("boxes", none), "points": F.coalesce("points", none)})


_FOUND = "tile_id string, x0 int, y0 int, x1 int, y1 int, k int, score double, lx1 double, ly1 double, lx2 double, ly2 double, mask binary"


def infer(tiles: DataFrame, backend: Backend, text: str | None) -> DataFrame:
    """The detections of tiles with their pixels, boxes and points: a row each, masks in packed bits of their tile."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples():
                w, h = t.x1 - t.x0, t.y1 - t.y0
                a = np.frombuffer(t.data, dtype=np.uint8).reshape(h, w, t.channels)
                masks, boxes, scores = backend.predict(a, text, [list(b) for b in t.boxes], [list(p) for p in t.points])
                n = min(len(masks), len(scores)) if masks is not None and len(masks) else min(len(boxes), len(scores))
                out = []
                for k in range(n):
                    m = formats.fitted(masks[k], w, h) if masks is not None and len(masks) else formats.box_mask(tuple(boxes[k]), w, h)
                    box = tuple(map(float, boxes[k])) if boxes is not None and k < len(boxes) else formats.mask_box(m)
                    if box is not None:
                        out.append((t.tile_id, t.x0, t.y0, t.x1, t.y1, k, float(scores[k]), *box, np.packbits(m).tobytes()))
                yield pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return tiles.mapInPandas(ask, _FOUND)


def asked_tiles(spark: SparkSession, image: str, tiles: DataFrame, text: str | None) -> DataFrame:
    """Tiles (of prompt_tiles) that there is something to ask about, with their pixels; the others aren't read."""
    asked = tiles if text else tiles.where((F.size("boxes") > 0) | (F.size("points") > 0))
    return readers.raster_tiles(spark, image, asked.repartition(max(1, spark.sparkContext.defaultParallelism), "tile_id"))


def predict_masks(spark: SparkSession, image: str, prompts: Prompts, backend: Backend, model: str = "sam3", threshold: float = 0.5, tile_size: int = 640, overlap: int = 64, merge_iou: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(merged, found, index): kept detections with label_rank by score, all detections by tile, and a count for every tile.

    A tile without any prompt isn't read. Masks are packed bits of their tile,
    never of the whole image. A backend that doesn't read texts takes no text
    prompt.
    """
    prompts.check(model)
    if prompts.text and not getattr(backend, "reads_text", True):
        raise ValueError("this backend reads no text; name one that does")
    meta = readers.raster_meta(spark, image)
    grid = Grid(meta.width, meta.height, tile_size, overlap)
    found = staged(infer(asked_tiles(spark, image, prompt_tiles(spark, grid, prompts), prompts.text), backend, prompts.text))
    kept = D.confident(found, "tile_id", "score", threshold, fallback=True, order="k")
    at = lambda c, o, most: F.least(F.greatest(F.col(c) + F.col(o), F.lit(0.0)), F.lit(float(most))).cast("float").cast("double")
    boxed = kept.withColumns({"bx1": at("lx1", "x0", meta.width), "by1": at("ly1", "y0", meta.height), "bx2": at("lx2", "x0", meta.width), "by2": at("ly2", "y0", meta.height)}).where("bx2 > bx1 AND by2 > by1")
    plain = boxed.select("tile_id", "k", "score", "mask", F.col("x0").alias("tx"), F.col("y0").alias("ty"), (F.col("x1") - F.col("x0")).alias("tw"), (F.col("y1") - F.col("y0")).alias("th"), F.col("bx1").alias("x1"), F.col("by1").alias("y1"), F.col("bx2").alias("x2"), F.col("by2").alias("y2"))
    plain = plain.withColumn("ord", F.struct("ty", "tx", "k"))
    merged = D.suppress(plain, merge_iou).drop("ord").withColumnRenamed("rank", "label_rank")
    index = D.per_tile(grid.frame(spark), kept).select("tile_id", "x0", "y0", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"), "count").orderBy("y0", "x0")
    return merged, kept, index


def write_predictions(spark: SparkSession, image: str, out: Path, prompts: Prompts, merged: DataFrame, kept: DataFrame, index: DataFrame, archive: bool = True, pictures: bool = False) -> dict[str, float | int | None]:
    """Everything of a prediction: the table of kept masks, an archive for every tile and, if asked for, one of the whole image and pictures of the tiles.

    The tiles' archives are what validation reads. Returns the numbers of kept
    masks and tiles, and the range and mean of the scores.
    """
    meta = readers.raster_meta(spark, image)
    folder = out / "masks" / "tiles"
    merged = staged(merged)
    merged.write.mode("overwrite").parquet(str(out / "masks.parquet"))
    tiles = index.select("tile_id", "x0", "y0", (F.col("x0") + F.col("width")).alias("x1"), (F.col("y0") + F.col("height")).alias("y1"))
    n = writers.write_tile_archives(kept, tiles, folder)
    write_csv(index, folder / "index.csv")
    if archive:
        writers.write_merged_archive(merged, meta.width, meta.height, out / "masks" / "image_masks.npz")
    if pictures:
        label = prompts.text or ("bbox" if prompts.boxes or prompts.by_tile is not None else "point" if prompts.points else None)
        annotate(spark, image, tiles, kept, out / "tiles_annotated", label)
    scores = D.confidence_summary(merged).first()
    return {"masks": scores.n, "tiles": n, "least": scores.least, "mean": scores["mean"], "greatest": scores.greatest}


def annotate(spark: SparkSession, image: str, tiles: DataFrame, found: DataFrame, folder: Path, label: str | None = None) -> int:
    """Every tile as a picture with its detections; tiles without any as they are; the number of tiles."""
    item = F.struct("k", "score", "lx1", "ly1", "lx2", "ly2", "mask")
    held = tiles.join(found.groupBy("tile_id").agg(F.array_sort(F.collect_list(item)).alias("found")), "tile_id", "left")

    def draw(pixels: np.ndarray, t: Any) -> np.ndarray:
        got = list(t.found) if t.found is not None else []
        masks = [writers.unpacked(g["mask"], t.width, t.height) for g in got]
        return drawing.draw_detections(pixels, masks, [[g[c] for c in ("lx1", "ly1", "lx2", "ly2")] for g in got], [g["score"] for g in got], label)

    return writers.write_pictures(drawn(readers.raster_tiles(spark, image, held), draw), folder)


def label_by_boxes(spark: SparkSession, image: str, boxes: Sequence[tuple[float, float, float, float]], out: Path, backend: Backend, by_tile: DataFrame | None = None, tile_size: int = 1024, overlap: int = 128) -> int:
    """The older workflow: tiles, and beside them the tiles with what the model finds for their boxes, without merging; the number of tiles."""
    write_tiles(spark, image, str(out), tile_size, tile_size, overlap)
    meta = readers.raster_meta(spark, image)
    grid = Grid(meta.width, meta.height, tile_size, overlap)
    found = staged(infer(asked_tiles(spark, image, prompt_tiles(spark, grid, Prompts(boxes=boxes, by_tile=by_tile)), None), backend, None))
    return annotate(spark, image, grid.frame(spark), D.confident(found, "tile_id", "score", 0.5, fallback=True, order="k"), out / "tiles_annotated")


def cached_tiles(spark: SparkSession, folder: Path) -> DataFrame:
    """(x0, y0) of the tiles that a folder has files of, by their names alone."""
    if not any(folder.glob("tile_*_overlap*")):
        return spark.range(0).select(F.lit(0).alias("x0"), F.lit(0).alias("y0"))
    names = spark.read.format("binaryFile").option("pathGlobFilter", "tile_*").load(str(folder)).select(legacy_tile(F.col("path")).alias("t"))
    return names.where("t IS NOT NULL").select(F.col("t.x").cast("int").alias("x0"), F.col("t.y").cast("int").alias("y0")).distinct()


def predict_cached(spark: SparkSession, image: str, out: Path, backend: Backend, text: str = "tree crowns", tile_size: int = 640, overlap: int = 64, start: tuple[int, int] = (0, 0), most: int | None = None, use_cache: bool = True) -> dict[str, float | int]:
    """The older prediction by tile: files by number and place, tiles that have some already are passed over; totals of the run."""
    out.mkdir(parents=True, exist_ok=True)
    meta = readers.raster_meta(spark, image)
    grid = Grid(meta.width, meta.height, tile_size, overlap)
    tiles = D.ranked(grid.frame(spark, start, most), F.asc("y0"), F.asc("x0")).withColumn("no", F.col("rank") - 1).drop("rank")
    todo = staged(tiles.join(cached_tiles(spark, out), ["x0", "y0"], "left_anti")) if use_cache else staged(tiles)
    none = F.expr("CAST(array() AS array<array<double>>)")
    rows = todo.withColumns({"boxes": none, "points": none})
    began, read = time.perf_counter(), Observation()
    found = staged(infer(asked_tiles(spark, image, rows, text), backend, text).observe(read, F.count(F.lit(1)).alias("masks")))
    took = time.perf_counter() - began
    named = todo.withColumn("tile_id", F.regexp_replace(legacy_tile_name(F.col("no"), F.col("x0"), F.col("y0"), F.lit(overlap)), r"\.png$", ""))
    renamed = found.drop("tile_id").join(named.select("tile_id", "x0", "y0"), ["x0", "y0"])
    writers.write_tile_archives(renamed, named, out)
    annotate(spark, image, named, renamed, out, None)
    total, done = tiles.count(), todo.count()
    return {"tiles": total, "processed": done, "skipped": total - done, "masks": read.get["masks"], "seconds": took}


def validate(spark: SparkSession, trees: DataFrame, runs: DataFrame, extents: DataFrame | None, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """(table, summary) of stems (ord, tree_id, stem_id, x, y in pixels) against masks' row runs.

    A stem's pixel is rounded half to even and must lie in the image. Without
    extents the whole image is covered; label_id is null for stems without a mask.
    """
    stems = trees.withColumns({"px": round_even(F.col("x")).cast("int"), "py": round_even(F.col("y")).cast("int")}).where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height))
    stems = staged(D.ranked(stems, F.asc("ord")).withColumn("tree_index", F.col("rank") - 1))
    if extents is None:
        seen = stems.select("tree_index")
    else:
        side = 256
        cut = extents.withColumn("_bx", F.explode(F.sequence(F.floor(F.col("x0") / side), F.floor((F.col("x1") - 1) / side)))).withColumn("_by", F.explode(F.sequence(F.floor(F.col("y0") / side), F.floor((F.col("y1") - 1) / side))))
        at = stems.withColumns({"_bx": F.floor(F.col("px") / side), "_by": F.floor(F.col("py") / side)})
        seen = at.join(cut, ["_bx", "_by"]).where("px >= x0 AND px < x1 AND py >= y0 AND py < y1").select("tree_index").distinct()
    covered = stems.join(seen.withColumn("covered", F.lit(True)), "tree_index", "left").withColumn("covered", F.coalesce("covered", F.lit(False)))
    live = runs.where("y IS NOT NULL")
    live = live.where("counts") if "counts" in runs.columns else live
    points = covered.where("covered").select("tree_index", F.col("px").cast("long").alias("x"), F.col("py").cast("long").alias("y"))
    got = D.match(D.stems_in_masks(points, live)).select("tree_index", "label_id")
    table = covered.join(got, "tree_index", "left").select("tree_index", "tree_id", I.stem_or_tree(F.col("stem_id"), F.col("tree_id")).alias("stem_id"), F.col("label_id").cast("int").alias("label_id"), F.col("x").alias("tree_pos_x"), F.col("y").alias("tree_pos_y"), F.col("covered").alias("prediction_coverage"))
    summary = D.match_summary(table.select(F.col("prediction_coverage").alias("covered"), "label_id"), runs.select("label_id").distinct())
    return table.orderBy("tree_index").select(*MATCH_COLUMNS), summary


def write_tiles(spark: SparkSession, image: str, out: str, tile_width: int = 2048, tile_height: int = 2048, overlap: int = 64) -> int:
    """A raster's tiles as PNG files named by their origin, and metadata.json beside them; the number of tiles."""
    meta = readers.raster_meta(spark, image)
    grid = Grid(meta.width, meta.height, tile_width, overlap, tile_height)
    n = writers.write_pictures(readers.raster_tiles(spark, image, grid.frame(spark)), Path(out) / "tiles_rgb")
    (Path(out) / "metadata.json").write_text(json.dumps({"original_shape": [meta.height, meta.width, meta.channels], "tile_size": [tile_width, tile_height], "overlap": [overlap, overlap]}) + "\n")
    return n


def reconstructed(spark: SparkSession, folder: str, side: int = 1024) -> tuple[DataFrame, int, int]:
    """The image of a folder of tiles in blocks (tile_id, x0, y0, width, height, channels, data; RGBA), blended over their overlaps; its width and height.

    Every tile is cut to the blocks that it meets, and every block is summed by
    one task, so nothing holds the image whole. A tile of another size than its
    place asks for is resized.
    """
    about = json.loads((Path(folder) / "metadata.json").read_text())
    (h, w, _), (tw, th), overlap = about["original_shape"], about["tile_size"], about["overlap"][0]
    origin = tile_origin(F.col("path"))
    tiles = readers.images(spark, str(Path(folder) / "tiles_rgb")).withColumn("o", origin).where("o IS NOT NULL").select("width", "height", "channels", "data", F.col("o.x").alias("x0"), F.col("o.y").alias("y0"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples():
                a = np.frombuffer(t.data, dtype=np.uint8).reshape(t.height, t.width, t.channels)
                a = rasters.rgba(rasters.resized(a, min(tw, w - t.x0), min(th, h - t.y0)))
                weight = rasters.ramps(a.shape[1], overlap)[None, :] * rasters.ramps(a.shape[0], overlap)[:, None]
                out = []
                for by in range(t.y0 // side, (t.y0 + a.shape[0] - 1) // side + 1):
                    for bx in range(t.x0 // side, (t.x0 + a.shape[1] - 1) // side + 1):
                        ys, xs = slice(max(0, by * side - t.y0), by * side + side - t.y0), slice(max(0, bx * side - t.x0), bx * side + side - t.x0)
                        part = a[ys, xs]
                        out.append((bx, by, t.x0 + xs.start - bx * side, t.y0 + ys.start - by * side, part.shape[1], part.shape[0], np.ascontiguousarray(part).tobytes(), np.ascontiguousarray(weight[ys, xs]).tobytes()))
                yield pd.DataFrame(out, columns=["bx", "by", "x", "y", "w", "h", "data", "weight"])

    def blend(pdf: pd.DataFrame) -> pd.DataFrame:
        bx, by = int(pdf.bx.iloc[0]), int(pdf.by.iloc[0])
        bw, bh = min(side, w - bx * side), min(side, h - by * side)
        total, weights = np.zeros((bh, bw, 4)), np.zeros((bh, bw))
        for t in pdf.sort_values(["y", "x", "w", "h"]).itertuples():
            weight = np.frombuffer(t.weight).reshape(t.h, t.w)
            total[t.y : t.y + t.h, t.x : t.x + t.w] += np.frombuffer(t.data, dtype=np.uint8).reshape(t.h, t.w, 4) * weight[:, :, None]
            weights[t.y : t.y + t.h, t.x : t.x + t.w] += weight
        out = np.floor(total / np.maximum(weights, 1e-6)[:, :, None] + 1e-9).astype(np.uint8)
        return pd.DataFrame([(f"tile_x{bx * side}_y{by * side}", bx * side, by * side, bw, bh, 4, out.tobytes())], columns=["tile_id", "x0", "y0", "width", "height", "channels", "data"])

    parts = tiles.mapInPandas(cut, "bx int, by int, x int, y int, w int, h int, data binary, weight binary")
    return parts.groupBy("bx", "by").applyInPandas(blend, "tile_id string, x0 int, y0 int, width int, height int, channels int, data binary"), w, h


def reconstruct(spark: SparkSession, folder: str) -> np.ndarray:
    """The image (RGBA) of a folder of tiles as one array, block by block; for images that the driver can hold."""
    blocks, w, h = reconstructed(spark, folder)
    out = np.zeros((h, w, 4), dtype=np.uint8)
    for b in blocks.toLocalIterator():
        out[b.y0 : b.y0 + b.height, b.x0 : b.x0 + b.width] = np.frombuffer(b.data, dtype=np.uint8).reshape(b.height, b.width, 4)
    return out


def height_map(spark: SparkSession, las: str, method: str = "max", **size: float) -> np.ndarray:
    """A dense grid (single precision, row 0 at the least y) of a LAS file; empty cells are 0; for grids that the driver can hold."""
    if not Path(las).exists():
        raise FileNotFoundError(las)
    grid, spec = R.height_grid(readers.las(spark, las), method, **size)
    out = np.zeros((spec.height, spec.width), dtype=np.float32)
    got = grid.toPandas()
    out[got.row, got.col] = got.z
    return out


def write_height_picture(spark: SparkSession, las: str, path: Path, method: str = "max", low: float | None = None, high: float | None = None, **size: float) -> tuple[int, int]:
    """A LAS file's height grid as a gray PNG, the greatest y first; width and height. Rows are packed by the executors and written one after the other."""
    if not Path(las).exists():
        raise FileNotFoundError(las)
    grid, spec = R.height_grid(readers.las(spark, las), method, **size)
    grid = staged(grid)
    rows = R.flipped(R.gray_cells(grid, low, high), spec.height).groupBy("row").agg(F.collect_list(F.struct("col", "gray")).alias("cells")).orderBy("row")

    def lines() -> Iterator[bytes]:
        at = 0
        for r in rows.toLocalIterator():
            for _ in range(at, r.row):
                yield bytes(spec.width)
            line = bytearray(spec.width)
            for c in r.cells:
                line[c.col] = c.gray
            yield bytes(line)
            at = r.row + 1
        for _ in range(at, spec.height):
            yield bytes(spec.width)

    path.parent.mkdir(parents=True, exist_ok=True)
    formats.png_write(path, spec.width, spec.height, 1, lines())
    return spec.width, spec.height


def write_height_overlay(spark: SparkSession, image: str, las: str, out: Path, method: str = "max", side: int = 1024) -> int:
    """An image times the gray of a height grid of its own size, modulo 256, in blocks as PNG files; the number of blocks."""
    meta = readers.raster_meta(spark, image)
    grid, spec = R.height_grid(readers.las(spark, las), method, width=meta.width, height=meta.height)
    cells = R.flipped(R.gray_cells(staged(grid)), spec.height).withColumn("tile_id", tile_id(F.floor(F.col("col") / side) * side, F.floor(F.col("row") / side) * side))
    held = Grid(meta.width, meta.height, side).frame(spark).join(cells.groupBy("tile_id").agg(F.collect_list("col").alias("cols"), F.collect_list("row").alias("rows"), F.collect_list("gray").alias("grays")), "tile_id", "left")

    def draw(pixels: np.ndarray, t: Any) -> np.ndarray:
        gray = np.zeros(pixels.shape[:2], dtype=np.uint8)
        if t.cols is not None:
            gray[np.asarray(t.rows) - t.y0, np.asarray(t.cols) - t.x0] = t.grays
        return pixels * gray[:, :, None]

    return writers.write_pictures(drawn(readers.raster_tiles(spark, image, held), draw), out)


def write_run_metadata(out: Path, image: str, tile_size: int, overlap: int, prompts: Prompts, model: str | None = None, command: str | None = None) -> None:
    """run_metadata.json: tiles, image, prompts, model, command."""
    body: dict = {"tile": {"size": tile_size, "overlap": overlap}, "image_path": str(Path(image).resolve()), "prompt": {"text": prompts.text, "bbox_prompts": [list(b) for b in prompts.boxes], "point_prompts": [list(p) for p in prompts.points], "weak_label_prompt_count": prompts.by_tile.count() if prompts.by_tile is not None else 0}}
    body |= {k: v for k, v in (("model", model), ("command", command)) if v}
    (out / "run_metadata.json").write_text(json.dumps(body, indent=2) + "\n")


def write_csv(df: DataFrame, path: Path) -> None:
    """A table of a report's size as one CSV file with a header."""
    df.toPandas().to_csv(path, index=False)


