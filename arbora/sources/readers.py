"""Tables of files: Spark's own readers where it has them, a Python data source or a map over binary files where it hasn't."""

from __future__ import annotations

import io
import mmap
import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, IntegerType, StructField, StructType

from ..functions.columns import parse_number
from ..functions.projections import ToWgs84
from . import formats


def text_table(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A delimited table with a header, all columns text, and ord, the place of a row in its files."""
    df = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)
    return df.withColumn("ord", F.monotonically_increasing_id())


def weak_boxes(spark: SparkSession, path: str) -> DataFrame:
    """(ord, tile_id, bx1, by1, bx2, by2) of a weak label table; a bad row raises an error that names it."""
    df = text_table(spark, path, ",")
    needed = ["tile_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
    if missing := [c for c in needed if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    b = [parse_number(F.col(c)) for c in needed[1:]]
    wrong = F.when(F.trim(F.coalesce("tile_id", F.lit(""))) == "", "a blank tile_id").when(F.greatest(*[x.isNull().cast("int") for x in b]) == 1, "something that is no number").when((b[2] <= b[0]) | (b[3] <= b[1]), "a box that ends before it begins")
    sure = F.when(wrong.isNull(), F.trim("tile_id")).otherwise(F.raise_error(F.concat(F.lit("row "), (F.col("ord") + 2).cast("string"), F.lit(" has "), wrong)))
    return df.select("ord", sure.alias("tile_id"), *[x.alias(n) for x, n in zip(b, ("bx1", "by1", "bx2", "by2"), strict=True)])


_MASK = "label_no long, score double, mask_area long, y int, x0 int, x1 int"


def merged_masks(spark: SparkSession, path: str) -> DataFrame:
    """The row runs of a merged prediction file's masks: label_id, score, mask_area, y, x0, x1; empty masks have one row without a run."""

    here = os.path.exists(local_path(path))  # then the executors open it themselves, and it may be of any size

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for file in (local_path(p) for p in pdf.path) if here else (io.BytesIO(c) for c in pdf.content):
                for first, masks, scores in formats.npz_blocks(file):
                    k, y, x0, x1 = formats.block_runs(masks)
                    area = np.bincount(k, x1 - x0, len(masks)).astype(np.int64)
                    bare = np.flatnonzero(area == 0)
                    of, empty = np.concatenate([k, bare]), np.arange(len(k) + len(bare)) >= len(k)
                    run = {c: pd.arrays.IntegerArray(np.concatenate([v, bare]).astype(np.int32), empty) for c, v in (("y", y), ("x0", x0), ("x1", x1))}
                    yield pd.DataFrame({"label_no": first + of, "score": scores[of], "mask_area": area[of], **run})

    files = spark.read.format("binaryFile").load(path)
    return files.select("path" if here else "content").mapInPandas(read, _MASK).withColumnRenamed("label_no", "label_id")


def tile_masks(spark: SparkSession, folder: str, width: int, height: int) -> tuple[DataFrame, DataFrame]:
    """The row runs of all tiles' masks in the image, and the tiles' extents cut to it.

    Labels are numbered over the tiles by (y0, x0, name) and their place in the
    tile. Of tiles with one origin the last one's masks count, but all are numbered.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                z = formats.npz_tile(content)
                (ox, oy), (w, h) = (int(v) for v in z["tile_origin"]), (int(v) for v in z["tile_size"])
                x1, y1 = min(ox + w, width), min(oy + h, height)
                if x1 <= max(ox, 0) or y1 <= max(oy, 0):
                    continue
                head = (PurePosixPath(path).stem, ox, oy, x1, y1)
                rows = [(*head, k, float(s), int(m.sum()), *r) for k, (m, s) in enumerate(zip(z["masks"].astype(bool), z["scores"], strict=True)) for r in (formats.runs(m[: y1 - oy, : x1 - ox], ox, oy) or [(None, None, None)])]
                yield pd.DataFrame(rows or [(*head, None, None, None, None, None, None)], columns=["stem", "ox", "oy", "ex", "ey", "k", "score", "mask_area", "y", "x0", "x1"]).astype({c: "Int64" for c in ("k", "mask_area", "y", "x0", "x1")})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "tile_x*_y*.npz").load(folder)
    raw = files.select("path", "content").mapInPandas(read, "stem string, ox int, oy int, ex int, ey int, k long, score double, mask_area long, y long, x0 long, x1 long")
    extents = raw.select("stem", F.col("ox").alias("x0"), F.col("oy").alias("y0"), F.col("ex").alias("x1"), F.col("ey").alias("y1")).distinct()
    # one row a file: the numbers of a tile's labels begin after those of the tiles before it
    counts = raw.groupBy("oy", "ox", "stem").agg(F.coalesce(F.max("k") + 1, F.lit(0)).alias("n"))
    first = counts.withColumn("first", F.coalesce(F.sum("n").over(W.orderBy("oy", "ox", "stem").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = first.withColumn("last", F.max("stem").over(W.partitionBy("oy", "ox")))
    rows = raw.where("k IS NOT NULL").join(last.select("stem", "first", "last"), "stem")
    return rows.select((F.col("first") + F.col("k")).alias("label_id"), "score", "mask_area", "y", "x0", "x1", (F.col("stem") == F.col("last")).alias("counts")), extents


class _Range(InputPartition):
    def __init__(self, path: str, start: int, count: int) -> None:
        self.path, self.start, self.count = path, start, count


#: Points that are decoded at a time.
LAS_ROWS = 1 << 16


class _LasReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path, rows

    def partitions(self) -> list[_Range]:
        with open(self.path, "rb") as f:
            count = formats.las_header(f.read(375))[2]
        return [_Range(self.path, at, min(self.rows, count - at)) for at in range(0, count, self.rows)] or [_Range(self.path, 0, 0)]

    def read(self, partition: _Range):
        import pyarrow as pa

        with open(partition.path, "rb") as f:
            begin, length, _, scale, offset = formats.las_header(f.read(375))
            f.seek(begin + partition.start * length)
            for at in range(0, max(1, partition.count), LAS_ROWS):
                points = formats.las_points(f.read(min(LAS_ROWS, partition.count - at) * length), length, scale, offset)
                yield pa.RecordBatch.from_arrays([pa.array(points[:, k].copy()) for k in range(3)], ["x", "y", "z"])


class LasDataSource(DataSource):
    """LAS points x, y, z, by ranges of records; the file must be on a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "x double, y double, z double"

    def reader(self, schema) -> _LasReader:
        return _LasReader(self.options["path"], int(self.options.get("rows", 1_000_000)))


def las(spark: SparkSession, path: str, rows: int = 1_000_000) -> DataFrame:
    """The points of a LAS file."""
    spark.dataSource.register(LasDataSource)
    return spark.read.format("las").option("rows", rows).load(path)


class _ShpReader(DataSourceReader):
    def __init__(self, path: str, rows: int) -> None:
        self.stem, self.rows = path[:-4], rows

    def _file(self, suffix: str) -> str | None:
        """The layer's file of a kind, in small or capital letters."""
        return next((p for p in (self.stem + suffix, self.stem + suffix.upper()) if os.path.exists(p)), None)

    def partitions(self) -> list[InputPartition]:
        shx = self._file(".shx")
        if shx:
            count = (os.path.getsize(shx) - 100) // 8
            return [_Range(self.stem, at, min(self.rows, count - at)) for at in range(0, count, self.rows)] or [_Range(self.stem, 0, 0)]
        with open(self._file(".shp"), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            places = formats.shp_records(data)  # without an index the records' headers are read once
        return [_Places(at, places[at : at + self.rows]) for at in range(0, len(places), self.rows)] or [_Places(0, [])]

    def read(self, partition):
        import pyarrow as pa

        if isinstance(partition, _Places):
            start, places = partition.start, partition.places
        else:
            start = partition.start
            with open(self._file(".shx"), "rb") as f:
                f.seek(100 + 8 * start)
                places = formats.shx_records(f.read(8 * partition.count))
        prj = self._file(".prj")
        way = ToWgs84(open(prj, encoding="utf-8", errors="replace").read()) if prj else None  # noqa: SIM115
        with open(self._file(".shp"), "rb") as f:
            points = []
            for at, size in places:
                f.seek(at)
                points.append(formats.shp_point(f.read(size)))
        at = [k for k, p in enumerate(points) if p is not None]
        x, y = np.array([points[k][0] for k in at]), np.array([points[k][1] for k in at])
        if way is not None and at:
            x, y = way(x, y)
        lon, lat = [None] * len(points), [None] * len(points)
        for k, a, b in zip(at, x.tolist(), y.tolist(), strict=True):
            if np.isfinite(a) and np.isfinite(b):
                lon[k], lat[k] = a, b
        with open(self._file(".dbf"), "rb") as f:
            _, begin, size, fields = formats.dbf_head(f.read(65536))
            f.seek(begin + start * size)
            raw = f.read(size * len(points))
        values = [formats.dbf_values(raw[k * size : (k + 1) * size], fields) for k in range(len(points))]
        columns = [pa.array([v[i] for v in values], pa.string()) for i in range(len(fields))]
        yield pa.RecordBatch.from_arrays([pa.array(range(start, start + len(points)), pa.int64()), pa.array(lon, pa.float64()), pa.array(lat, pa.float64()), *columns], ["ord", "x", "y", *(n for n, _ in fields)])


class _Places(InputPartition):
    def __init__(self, start: int, places: list[tuple[int, int]]) -> None:
        self.start, self.places = start, places


class ShpDataSource(DataSource):
    """A shapefile's features by ranges of records; its files must be on a path that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "shp"

    def schema(self) -> str:
        reader = self.reader(None)
        with open(reader._file(".dbf"), "rb") as f:
            fields = formats.dbf_head(f.read(65536))[3]
        return ", ".join(["ord long", "x double", "y double", *(f"`{n}` string" for n, _ in fields)])

    def reader(self, schema) -> _ShpReader:
        return _ShpReader(local_path(self.options["path"]), int(self.options.get("rows", 100_000)))


def shapes(spark: SparkSession, path: str, rows: int = 100_000) -> DataFrame:
    """A shapefile's features: ord (counted over all of them), x, y and its fields as text.

    Places are longitudes and latitudes on WGS84: the .prj beside the file says
    from which system they come, and without one they are taken as they are; a
    system that isn't known raises ValueError. A feature without a shape, or
    beyond its projection's reach, has null places. A missing .shx is made up for.
    """
    reader = _ShpReader(local_path(path), rows)
    if missing := [k for k in (".shp", ".dbf") if not reader._file(k)]:
        raise FileNotFoundError(f"{reader.stem}{missing[0]}")
    if prj := reader._file(".prj"):
        ToWgs84(open(prj, encoding="utf-8", errors="replace").read())  # noqa: SIM115
    spark.dataSource.register(ShpDataSource)
    return spark.read.format("shp").option("rows", rows).load(local_path(path))


class _Ranges:
    """A file of Hadoop's file systems as slices of its bytes, for the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        self.stream, self.jvm = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where), spark._jvm

    def __getitem__(self, part: slice) -> bytes:
        self.stream.seek(part.start or 0)
        return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(self.jvm.org.apache.commons.io.input.BoundedInputStream(self.stream, part.stop - (part.start or 0))))


def local_path(path: str) -> str:
    """A path that the machine's own calls take, wherever a process was started."""
    return os.path.abspath(path.removeprefix("file://").removeprefix("file:"))


def is_tiff(path: str) -> bool:
    return path.lower().endswith((".tif", ".tiff"))


def raster_meta(spark: SparkSession, path: str) -> formats.RasterMeta:
    """What a raster says of itself, from its header and tags only; a plain image has a size alone."""
    if not is_tiff(path):
        r = picture(spark, path).first()
        return formats.RasterMeta(r["width"], r["height"], r["channels"], 0.0, 0.0, 1.0, -1.0, None, None)
    if os.path.exists(local_path(path)):
        with open(local_path(path), "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return formats.Tiff(data).meta()
    return formats.Tiff(_Ranges(spark, path)).meta()


def picture(spark: SparkSession, path: str) -> DataFrame:
    """(path, width, height, channels, data) of PNGs, or of JPEGs and what else Spark's own image reader takes."""
    if path.lower().endswith(".png"):
        return _decoded(spark.read.format("binaryFile").load(path).select("path", "content"))
    rows = spark.read.format("image").load(path).select(F.col("image.origin").alias("path"), "image.width", "image.height", F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def turn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:  # blue comes first there
            pixels = [np.frombuffer(d, dtype=np.uint8).reshape(-1, c) for d, c in zip(pdf.data, pdf.channels, strict=True)]
            pdf["data"] = [(p[:, [2, 1, 0, *range(3, p.shape[1])]] if p.shape[1] >= 3 else p).tobytes() for p in pixels]
            yield pdf

    return rows.mapInPandas(turn, "path string, width int, height int, channels int, data binary")


def _decoded(files: DataFrame) -> DataFrame:
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [formats.png_decode(c) for c in pdf.content]
            yield pd.DataFrame({"path": pdf.path.to_numpy(), "width": [a.shape[1] for a in got], "height": [a.shape[0] for a in got], "channels": [a.shape[2] for a in got], "data": [a.tobytes() for a in got]})

    return files.mapInPandas(read, "path string, width int, height int, channels int, data binary")


def images(spark: SparkSession, path: str, glob: str = "tile_*.png") -> DataFrame:
    """(path, width, height, channels, data) of the PNGs in a folder."""
    return _decoded(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content"))


def raster_tiles(spark: SparkSession, path: str, tiles: DataFrame) -> DataFrame:
    """Each tile (tile_id, x0, y0, x1, y1, and what else it has) with its pixels: width, height, channels, data.

    A TIFF's windows are read where they are asked for, so it must be on a path
    that all executors see. A plain image is decoded once, and each tile is cut
    from it.
    """
    schema = StructType([*tiles.schema.fields, *(StructField(n, IntegerType()) for n in ("width", "height", "channels")), StructField("data", BinaryType())])
    if not is_tiff(path):
        return _cut_tiles(picture(spark, path), tiles, schema)
    source = local_path(path)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(source, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            tiff = formats.Tiff(data)
            for pdf in frames:
                for k, t in enumerate(pdf.itertuples()):
                    a = tiff.window(t.x0, t.y0, t.x1 - t.x0, t.y1 - t.y0)
                    yield pdf.iloc[k : k + 1].assign(width=a.shape[1], height=a.shape[0], channels=a.shape[2], data=[a.tobytes()])
            del tiff

    return tiles.mapInPandas(read, schema)


def _cut_tiles(image: DataFrame, tiles: DataFrame, schema: StructType) -> DataFrame:
    """Tiles of one decoded image: its row meets all tiles as rows of one array."""
    every = tiles.groupBy().agg(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in tiles.columns])).alias("tiles"))
    both = image.select(F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("channels").alias("_c"), F.col("data").alias("_data")).crossJoin(F.broadcast(every))  # one row each
    names = tiles.columns

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False, name=None):
                w, h, c, data, held = r
                a = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)[:, :, : 1 if c < 3 else 4]
                for t in held:
                    part = a[t["y0"] : t["y1"], t["x0"] : t["x1"]]
                    row = {n: [t[n]] for n in names} | {"width": [part.shape[1]], "height": [part.shape[0]], "channels": [part.shape[2]], "data": [part.tobytes()]}
                    yield pd.DataFrame(row)

    return both.mapInPandas(cut, schema)
