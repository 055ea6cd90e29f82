"""Files that others read: shapefiles, point files, prediction archives, tiles of images."""

from __future__ import annotations

import io
import itertools
import math
import shutil
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.detections import ranked
from ..operators.staged import staged
from . import formats

#: The label layer's fields (name, kind, width, decimals) with the label table's columns.
LABEL_FIELDS = (
    ("tile_id", "C", 48, 0, "tile_id"), ("tree_id", "C", 48, 0, "tree_id"), ("x_pixel", "N", 9, 0, "x_pixel"), ("y_pixel", "N", 9, 0, "y_pixel"), ("crown_px", "N", 12, 3, "crown_radius"),
    ("bbox_x1", "N", 12, 3, "bbox_x1"), ("bbox_y1", "N", 12, 3, "bbox_y1"), ("bbox_x2", "N", 12, 3, "bbox_x2"), ("bbox_y2", "N", 12, 3, "bbox_y2"),
    ("x_long", "N", 18, 9, "x_long_wgs84"), ("y_lat", "N", 18, 9, "y_lat_wgs84"), ("dbh_cm", "N", 10, 3, "dbh_cm"),
)
WGS84_WKT = 'GEOGCS["GCS_WGS_1984",DATUM["D_WGS_1984",SPHEROID["WGS_1984",6378137.0,298.257223563]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]]'


_PART = 1 << 33  # an id is the partition's number times this, plus the row's in it


def _numbered(rows: DataFrame) -> tuple[DataFrame, dict[int, int], int]:
    """The rows, written, with _id in their order, the number of rows before each partition, and that of all."""
    kept = staged(rows.withColumn("_id", F.monotonically_increasing_id()))
    before, n = {}, 0
    for r in kept.groupBy(F.expr(f"_id div {_PART}").alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect():  # one row a partition
        before[r.p], n = n, n + r.n
    return kept, before, n


def _write_records(kept: DataFrame, before: dict[int, int], files: list[tuple[Path, bytes, int, bytes]], n: int, encode: Callable[[pd.DataFrame, np.ndarray], list[bytes]]) -> None:
    """Files (path, head, record length, tail) of n records: the executors write each stretch of rows at its place.

    encode gives a stretch's records for each file, from its rows and their
    places. The files must be on a path that all executors and the driver see.
    """
    at = [(str(path.resolve()), len(head), size) for path, head, size, _ in files]
    for path, head, size, tail in files:
        with path.open("wb") as f:
            f.write(head)
            f.seek(len(head) + n * size)
            f.write(tail)
            f.truncate()

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if pdf.empty:
                continue
            ids = pdf.pop("_id").to_numpy()
            parts, which = np.unique(ids // _PART, return_inverse=True)
            places = np.array([before[int(p)] for p in parts], dtype=np.int64)[which] + ids % _PART
            ends = [*(np.flatnonzero(np.diff(places) != 1) + 1), len(places)]
            for a, b in zip([0, *ends[:-1]], ends, strict=True):
                for (path, begin, size), data in zip(at, encode(pdf.iloc[a:b], places[a:b]), strict=True):
                    with open(path, "r+b") as f:
                        f.seek(begin + int(places[a]) * size)
                        f.write(data)
            yield pd.DataFrame({"n": [len(ids)]})

    written = kept.mapInPandas(save, "n long").agg(F.sum("n")).first()[0] or 0
    if written != n:
        raise RuntimeError(f"{written} of {n} records were written")


def write_las(points: DataFrame, path: Path, scale: float = 0.001) -> int:
    """Points (x, y, z, in this order) as one LAS 1.2 file, written by the executors; the number of them. Raises ValueError for points without a place."""
    kept, before, n = _numbered(points.select(*[F.col(f"`{c}`").cast("double").alias(a) for c, a in zip(points.columns, "xyz", strict=True)]))
    ends = kept.agg(*[f(c) for f in (F.min, F.max) for c in "xyz"], *[F.count_if(F.col(c).isNull() | F.isnan(c)) for c in "xyz"]).first()
    if n and (any(ends[6:]) or not np.isfinite(ends[:6]).all()):
        raise ValueError("there are points without a place")
    low, high = (np.array(ends[k : k + 3] if n else [0.0] * 3) for k in (0, 3))
    if ((high - low) / scale >= 1 << 31).any():
        raise ValueError(f"the points are too far apart for steps of {scale}")
    _write_records(kept, before, [(path, formats.las_head(n, low, high, scale), 20, b"")], n, lambda pdf, _: [formats.las_body(pdf[["x", "y", "z"]].to_numpy(), low, scale)])
    return n


def _cleared(path: Path) -> None:
    """Files of an earlier layer go."""
    for kind in ("shp", "shx", "dbf", "prj", "cpg", "qix"):
        path.with_suffix(f".{kind}").unlink(missing_ok=True)


def write_layer(path: Path, points: list[tuple[float, float]], fields: list[tuple[str, str, int, int]], rows: list[list], wkt: str = WGS84_WKT) -> None:
    """A layer of points as .shp, .shx, .dbf and .prj; files of an earlier one go first."""
    _cleared(path)
    for kind, data in formats.shp_encode(points, fields, rows).items():
        path.with_suffix(f".{kind}").write_bytes(data)
    path.with_suffix(".prj").write_text(wkt)


#: Points of a layer whose .shp has a length that its header can tell, in 16-bit words.
LAYER_POINTS = ((1 << 31) - 1 - 50) // 14


def write_label_layer(labels: DataFrame, path: Path) -> int:
    """The label table as a layer of points in longitude and latitude, in its order, written by the executors; the number of them."""
    kept, before, n = _numbered(labels.select(*[f[4] for f in LABEL_FIELDS]))
    if n > LAYER_POINTS:
        raise ValueError(f"{n} points are too many for one layer; the table holds them")
    x, y = F.col("x_long_wgs84"), F.col("y_lat_wgs84")
    *ends, bare = kept.agg(F.min(x), F.min(y), F.max(x), F.max(y), F.count_if(x.isNull() | y.isNull())).first()
    if bare:
        raise ValueError(f"{bare} labels have no place")
    fields, names = [f[:4] for f in LABEL_FIELDS], [f[4] for f in LABEL_FIELDS]

    def encode(pdf: pd.DataFrame, places: np.ndarray) -> list[bytes]:
        shp = np.zeros(len(pdf), dtype=[("no", ">i4"), ("words", ">i4"), ("kind", "<i4"), ("x", "<f8"), ("y", "<f8")])
        shx = np.zeros(len(pdf), dtype=[("at", ">i4"), ("words", ">i4")])
        shp["no"], shp["words"], shp["kind"], shp["x"], shp["y"] = places + 1, 10, 1, pdf.x_long_wgs84, pdf.y_lat_wgs84
        shx["at"], shx["words"] = 50 + 14 * places, 10
        rows = pdf[names].astype(object).where(pdf[names].notna(), None)
        return [shp.tobytes(), shx.tobytes(), formats.dbf_body(fields, rows.itertuples(index=False, name=None))]

    _cleared(path)
    box = tuple(ends) if n else (0.0,) * 4
    files = [
        (path.with_suffix(".shp"), formats.shp_head(50 + 14 * n, 1, box), 28, b""),
        (path.with_suffix(".shx"), formats.shp_head(50 + 4 * n, 1, box), 8, b""),
        (path.with_suffix(".dbf"), formats.dbf_header(n, fields), formats.dbf_width(fields), b"\x1a"),
    ]
    _write_records(kept, before, files, n, encode)
    path.with_suffix(".prj").write_text(WGS84_WKT)
    return n


def npz(**arrays: np.ndarray) -> bytes:
    """Named arrays as a compressed archive."""
    buffer = io.BytesIO()
    np.savez_compressed(buffer, **arrays)
    return buffer.getvalue()


def unpacked(mask: bytes, width: int, height: int) -> np.ndarray:
    """A mask of its packed bits."""
    return np.unpackbits(np.frombuffer(mask, dtype=np.uint8), count=width * height).reshape(height, width).astype(bool)


def write_tile_archives(found: DataFrame, tiles: DataFrame, folder: Path) -> int:
    """An archive for each tile (tile_id, x0, y0, x1, y1), also of those without a mask, by the executors; the number of tiles.

    found has tile_id, k, score, lx1, ly1, lx2, ly2 and mask in packed bits. The
    folder must be one that all executors and the driver see.
    """
    folder.mkdir(parents=True, exist_ok=True)
    out = str(folder.resolve())
    item = F.struct("k", "score", "lx1", "ly1", "lx2", "ly2", "mask")
    per = tiles.join(found.groupBy("tile_id").agg(F.array_sort(F.collect_list(item)).alias("found")), "tile_id", "left")

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples():
                w, h = t.x1 - t.x0, t.y1 - t.y0
                got = list(t.found) if t.found is not None else []
                masks = np.stack([unpacked(g["mask"], w, h) for g in got]) if got else np.zeros((0, h, w), dtype=bool)
                boxes = np.array([[g[c] for c in ("lx1", "ly1", "lx2", "ly2")] for g in got], dtype=np.float32).reshape(-1, 4)
                body = npz(tile_id=np.asarray(t.tile_id), tile_origin=np.array([t.x0, t.y0], dtype=np.int32), tile_size=np.array([w, h], dtype=np.int32), masks=masks, boxes=boxes, scores=np.array([g["score"] for g in got], dtype=np.float32))
                Path(out, f"{t.tile_id}.npz").write_bytes(body)
            yield pdf[["tile_id"]]

    return per.select("tile_id", "x0", "y0", "x1", "y1", "found").mapInPandas(save, "tile_id string").count()


#: Pixels of all masks together that one archive may hold.
ARCHIVE_PIXELS = 1 << 31


def write_merged_archive(merged: DataFrame, width: int, height: int, path: Path) -> int:
    """The kept masks in the whole image as one archive, by label_rank; for images and numbers of masks that one file can hold."""
    n = merged.count()
    if n * width * height > ARCHIVE_PIXELS:
        raise ValueError(f"{n} masks of {width} by {height} pixels are too many for one archive; the tiles' archives and the table hold them")

    def draw(r) -> np.ndarray:
        out, w, h = np.zeros((height, width), dtype=bool), min(r.tw, width - r.tx), min(r.th, height - r.ty)
        out[r.ty : r.ty + h, r.tx : r.tx + w] = unpacked(r.mask, r.tw, r.th)[:h, :w]
        return out

    rows = merged.orderBy("label_rank").select("score", "tx", "ty", "x1", "y1", "x2", "y2").collect()
    boxes = np.array([[r.x1, r.y1, r.x2, r.y2] for r in rows], dtype=np.float32).reshape(-1, 4)
    source = {f"source_tile_{a}": np.array([r[f"t{a}"] for r in rows], dtype=np.int32) for a in "xy"}
    placed = ranked(merged.select("label_rank", "mask", "tx", "ty", "tw", "th"), F.col("label_rank")).withColumn("place", F.col("rank") - 1)
    write_masks(placed, draw, n, width, height, path, boxes=boxes, scores=np.array([r.score for r in rows], dtype=np.float32), image_size=np.array([width, height], dtype=np.int32), **source)
    return n


#: Pixels of masks that are packed together.
STRETCH_PIXELS = 1 << 24


def write_masks(placed: DataFrame, draw: Callable[..., np.ndarray], n: int, width: int, height: int, path: Path, **arrays: np.ndarray) -> None:
    """An archive of n masks of an image, drawn from rows that have place (from 0), and of other arrays.

    The executors draw and pack the masks in stretches, which the driver puts one
    after the other, so that neither holds many masks. The path must be one that
    all executors and the driver see.
    """
    many = max(1, STRETCH_PIXELS // max(1, width * height))
    path.parent.mkdir(parents=True, exist_ok=True)
    folder = path.resolve().parent / f".{path.name}-{uuid.uuid4().hex}"
    folder.mkdir()
    out = str(folder)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in frames for r in pdf.itertuples())
        for stretch, held in itertools.groupby(rows, lambda r: r.place // many):
            crc, length, packed = formats.deflated(draw(r).tobytes() for r in held)
            part = Path(out, f"{stretch}-{uuid.uuid4().hex}")
            part.write_bytes(packed)
            yield pd.DataFrame({"stretch": [stretch], "crc": [crc], "length": [length], "name": [part.name]})

    parts = min(math.ceil(n / many), 8 * placed.sparkSession.sparkContext.defaultParallelism) or 1
    try:
        dealt = placed.repartition(parts, F.expr(f"place div {many}")).sortWithinPartitions("place")
        got = sorted(dealt.mapInPandas(pack, "stretch long, crc long, length long, name string").collect())  # one row a stretch
        formats.npz_write(path, "masks", (n, height, width), [(r.crc, r.length, folder / r.name) for r in got], **arrays)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def write_pictures(tiles: DataFrame, folder: Path, kind: str = "png", compression: str = "lzw") -> int:
    """Tiles (tile_id, width, height, channels, data) as files named by their tile, by the executors; the number of tiles.

    Files of that kind from an earlier run go first.
    """
    folder.mkdir(parents=True, exist_ok=True)
    for old in folder.glob(f"tile_*.{kind}"):
        old.unlink()
    out = str(folder.resolve())

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for t in pdf.itertuples():
                a = np.frombuffer(t.data, dtype=np.uint8).reshape(t.height, t.width, t.channels)
                Path(out, f"{t.tile_id}.{kind}").write_bytes(formats.png_encode(a) if kind == "png" else formats.tiff_encode(a, compression=compression))
            yield pdf[["tile_id"]]

    return tiles.select("tile_id", "width", "height", "channels", "data").mapInPandas(save, "tile_id string").count()
