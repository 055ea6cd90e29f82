"""Files in and out: coordinate systems, shapefiles, rasters, pictures, model results, and the commands that read and write them."""

import itertools
import json
import math
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from arbora import cli
from arbora.functions import columns as C
from arbora.functions import drawing, pixels
from arbora.functions import projections as P
from arbora.operators import detections as D
from arbora.operators import inventory as I
from arbora.operators import rasters as R
from arbora.operators.tiles import Grid
from arbora.plans import docs, queries
from arbora.plans import workflows as W
from arbora.sources import formats, models, readers, writers


def _one(f, x, y, *rest):
    return np.degrees(f(np.array([x]), np.array([y]), *rest)).ravel()


def test_projections_give_published_places():
    d, deg = math.radians, lambda a, b=0, c=0.0: a + b / 60 + c / 3600
    foot = 0.304800609601219
    got = _one(P.conic_inverse, (2963503.91 - 2000000) * foot, 254759.80 * foot, P.Ellipsoid(6378206.4, 1 / 294.97870), d(-99), d(deg(27, 50)), d(deg(28, 23)), d(deg(30, 17)), 1.0)
    assert got == pytest.approx([-96, 28.5], abs=1e-7)
    got = _one(P.conic_inverse, 255966.58 - 250000, 142493.51 - 150000, P.Ellipsoid(6378206.4, 1 / 294.9786982), d(-77), d(18), d(18), d(18), 1.0)
    assert got == pytest.approx([-deg(76, 56, 37.26), deg(17, 55, 55.8)], abs=1e-7)
    got = _one(P.transverse_mercator_inverse, 577274.99 - 400000, 69740.50 + 100000, P.Ellipsoid(6377563.396, 1 / 299.32496), d(-2), d(49), 0.9996012717)
    assert got == pytest.approx([0.5, 50.5], abs=2e-7)
    assert _one(P.equal_area_inverse, 3962799.45 - 4321000, 2999718.85 - 3210000, P.Ellipsoid(6378137, 1 / 298.2572221), d(10), d(52)) == pytest.approx([5, 50], abs=1e-7)
    assert _one(P.equal_area_inverse, 0.0, 0.0, P.Ellipsoid(), d(10), d(52)) == pytest.approx([10, 52])
    assert _one(P.mercator_inverse, -11169055.58, 2800000.0, P.Ellipsoid(), 0, 1, True) == pytest.approx([-deg(100, 20), deg(24, 22, 54.433)], abs=1e-7)
    assert _one(P.shift_datum, d(4), d(55), P.Ellipsoid(6378135, 1 / 298.26), [0, 0, 4.5, 0, 0, 0.554, 0.219]) == pytest.approx([4 + 0.554 / 3600, 55 + 0.09 / 3600], abs=2e-6)


UTM33 = 'PROJCS["ETRS_1989_UTM_Zone_33N",GEOGCS["GCS_ETRS_1989",DATUM["D_ETRS_1989",SPHEROID["GRS_1980",6378137.0,298.257222101]],PRIMEM["Greenwich",0.0],UNIT["Degree",0.0174532925199433]],PROJECTION["Transverse_Mercator"],PARAMETER["False_Easting",500000.0],PARAMETER["False_Northing",0.0],PARAMETER["Central_Meridian",15.0],PARAMETER["Scale_Factor",0.9996],PARAMETER["Latitude_Of_Origin",0.0],UNIT["Meter",1.0]]'


def test_layers_systems(spark):
    from arbora.functions.geodesy import utm

    places = [(13.0, 47.5), (15.0, 52.0), (17.9, 0.5)]
    made = [spark.range(1).select(*utm(F.lit(a), F.lit(b), 33)).first() for a, b in places]
    lon, lat = P.ToWgs84(UTM33)(np.array([m[0] for m in made]), np.array([m[1] for m in made]))
    assert lon == pytest.approx([p[0] for p in places], abs=1e-8) and lat == pytest.approx([p[1] for p in places], abs=1e-8)
    gauss = UTM33.replace("D_ETRS_1989", "D_Deutsches_Hauptdreiecksnetz").replace('"GRS_1980",6378137.0,298.257222101]', '"Bessel_1841",6377397.155,299.1528128],TOWGS84[598.1,73.7,418.2,0.202,0.045,-2.455,6.7]')
    there = P.ToWgs84(gauss)(np.array([500000.0]), np.array([5300000.0]))
    here = P.ToWgs84(UTM33)(np.array([500000.0]), np.array([5300000.0]))
    assert 30 < math.hypot((there[0] - here[0])[0] * 75000, (there[1] - here[1])[0] * 111000) < 1000
    for bad in ("", "x", "LOCAL_CS[\"a\"]", UTM33.replace("D_ETRS_1989", "D_Monte_Mario"), UTM33.replace("Transverse_Mercator", "Krovak"), UTM33[:80]):
        with pytest.raises(ValueError):
            P.ToWgs84(bad)


def _polygon(rings):
    flat = [p for r in rings for p in r]
    starts = list(itertools.accumulate([0, *map(len, rings[:-1])]))
    xs, ys = [p[0] for p in flat], [p[1] for p in flat]
    import struct

    return struct.pack("<i4dii", 5, min(xs), min(ys), max(xs), max(ys), len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<dd", *p) for p in flat)


def test_representative_points():
    square, hole = [(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1.5, 1), (3.5, 1), (3.5, 3), (1.5, 3), (1.5, 1)]
    assert formats.shp_point(_polygon([square])) == (2.0, 2.0)
    assert formats.shp_point(_polygon([square, hole])) == pytest.approx(((32 - 4 * 2.5) / 12, 2.0))
    far = [[(x + 1e7, y + 1e7) for x, y in r] for r in (square, hole)]
    assert formats.shp_point(_polygon(far)) == pytest.approx(((32 - 4 * 2.5) / 12 + 1e7, 2.0 + 1e7), abs=1e-6)
    assert formats.centroid([np.array(square, dtype=float)[:3]], False) == (1.0, 3.0)
    assert formats.centroid([np.ones((3, 2))], True) == (1.0, 1.0) and formats.centroid([], True) is None


def test_shapefiles_are_reprojected(spark, tmp_path):
    points = [(500000.0 + k, 5300000.0 + 2 * k) for k in range(10)]
    writers.write_layer(tmp_path / "a.shp", points, [("TreeID", "C", 8, 0), ("DBH", "N", 10, 3)], [[f"t{k}", k / 2] for k in range(10)], UTM33)
    want = P.ToWgs84(UTM33)(*np.array(points).T)
    got = readers.shapes(spark, str(tmp_path / "a.shp"), rows=3).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(10)) and [r.TreeID for r in got] == [f"t{k}" for k in range(10)] and got[3].DBH == "1.500"
    assert [r.x for r in got] == pytest.approx(list(want[0])) and [r.y for r in got] == pytest.approx(list(want[1]))
    (tmp_path / "a.shx").unlink()
    assert [tuple(r) for r in readers.shapes(spark, str(tmp_path / "a.shp"), rows=4).orderBy("ord").collect()] == [tuple(r) for r in got]
    (tmp_path / "a.prj").unlink()
    assert readers.shapes(spark, str(tmp_path / "a.shp")).where("ord = 2").first().x == 500002.0
    (tmp_path / "a.prj").write_text(UTM33.replace("Transverse_Mercator", "Krovak"))
    with pytest.raises(ValueError, match="krovak"):
        readers.shapes(spark, str(tmp_path / "a.shp"))
    writers.write_layer(tmp_path / "none.shp", [], [("TreeID", "C", 8, 0)], [])
    assert readers.shapes(spark, str(tmp_path / "none.shp")).count() == 0
    with pytest.raises(FileNotFoundError):
        readers.shapes(spark, str(tmp_path / "missing.shp"))


def test_tiffs_come_back():
    rng = np.random.default_rng(0)
    for n, most in itertools.product((0, 1, 2, 300, 5000, 60000), (2, 256)):
        data = rng.integers(0, most, n).astype(np.uint8).tobytes()
        assert formats.unpack_lzw(formats.pack_lzw(data)) == data
    a = rng.integers(0, 256, (33, 41, 3)).astype(np.uint8)
    place = formats.RasterMeta(41, 33, 3, 1.0, 2.0, 0.5, -0.5, "EPSG:32632", -9.0)
    for kind, predictor, rows, big, planar in itertools.product(("none", "deflate", "lzw"), (False, True), (0, 7), (False, True), (False, True)):
        t = formats.Tiff(formats.tiff_encode(a, place, kind, predictor, rows, big, planar))
        assert t.meta() == place and (t.window(0, 0, 41, 33) == a).all() and (t.window(5, 6, 20, 15) == a[6:21, 5:25]).all()
    # the example of the PackBits note
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert formats.unpack_bits(packed).hex().upper() == "AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA"
    # a known strip, first bit first: clear, 7, 258, 8, 8, 258, 6, 6, end
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert formats.unpack_lzw(int(bits.ljust(88, "0"), 2).to_bytes(11, "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    with pytest.raises(ValueError, match="compression 7"):
        formats.Tiff(formats.tiff_encode(a).replace(b"\x03\x01\x03\x00\x01\x00\x00\x00\x08", b"\x03\x01\x03\x00\x01\x00\x00\x00\x07", 1)).window(0, 0, 4, 4)


def test_raster_headers_are_read_by_range(spark, tmp_path):
    a = np.zeros((50, 60, 3), dtype=np.uint8)
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(a, formats.RasterMeta(60, 50, 3, 1.0, 2.0, 0.5, -0.5, "EPSG:4326", None)))
    assert readers.raster_meta(spark, str(tmp_path / "a.tif")) == formats.Tiff(readers._Ranges(spark, f"file://{tmp_path}/a.tif")).meta()


def _jpeg(spark, path, a):
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(a.shape[1], a.shape[0], jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    for y in range(a.shape[0]):
        for x in range(a.shape[1]):
            image.setRGB(x, y, int(a[y, x, 0]) << 16 | int(a[y, x, 1]) << 8 | int(a[y, x, 2]))
    assert jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(path)))


def test_pictures(spark, tmp_path):
    a = np.zeros((20, 24, 3), dtype=np.uint8)
    a[:, :, 0], a[:, :, 1], a[:, :, 2] = 200, 100, 30
    _jpeg(spark, tmp_path / "a.jpg", a)
    (tmp_path / "a.png").write_bytes(formats.png_encode(a))
    for name in ("a.jpg", "a.png"):
        meta = readers.raster_meta(spark, str(tmp_path / name))
        assert (meta.width, meta.height, meta.bands) == (24, 20, 3)
        got = readers.raster_tiles(spark, str(tmp_path / name), Grid(24, 20, 16).frame(spark).withColumn("more", F.lit("x"))).orderBy("y0", "x0").collect()
        assert [(r.x0, r.y0, r.width, r.height, r.channels, r.more) for r in got] == [(0, 0, 16, 16, 3, "x"), (16, 0, 8, 16, 3, "x"), (0, 16, 16, 4, 3, "x"), (16, 16, 8, 4, 3, "x")]
        assert all(abs(int(v) - w) <= 3 for r in got for v, w in zip(r.data[:3], (200, 100, 30), strict=True))
    merged, _, index = W.predict_masks(spark, str(tmp_path / "a.png"), W.Prompts(boxes=[(2.0, 2.0, 9.0, 9.0)]), W.BoxBackend(), tile_size=16, overlap=0)
    assert merged.count() == 1 and index.count() == 4


def test_model_results():
    plane = np.array([[0, 0, 1], [2, 2, 1]])
    segments = [{"id": 0, "label_id": 1, "score": 0.5}, {"id": 1, "label_id": 2}, {"id": -1, "label_id": 1}, {"label_id": 1}, {"id": 9, "label_id": 1}, {"id": 2, "label_id": 3}]
    found = models.from_segments(plane, segments, {1: "Tree Crown", "2": "Straße"}, " tree ")
    assert found.boxes.tolist() == [[0, 0, 2, 1]] and found.scores.tolist() == [0.5]
    assert models.from_segments(plane, segments, {"2": "Straße"}, "STRASSE").boxes.tolist() == [[2, 0, 3, 2]]
    assert len(models.from_segments(plane, segments, {}, None).masks) == 3 and len(models.from_segments(plane, segments, {}, "3").masks) == 1
    assert len(models.from_segments(None, [], {}).masks) == 0
    stack = np.zeros((2, 3, 4, 4))
    stack[0, 1, 1, 1] = stack[1, 0, 2:, 2] = 1
    found = models.from_stacks(stack[None], np.array([[[0.1, 0.9, 0.3], [0.8, 0.2, 0.2]]]))
    assert found.boxes.tolist() == [[1, 1, 2, 2], [2, 2, 3, 4]] and found.scores.tolist() == pytest.approx([0.9, 0.8])
    assert models.from_stacks(stack, np.array([1.0])).boxes.tolist() == [[2, 2, 3, 4]] and models.from_stacks(stack[0, 1]).scores.tolist() == [1.0]
    assert len(models.from_stacks(np.zeros(3)).masks) == 0
    found = models.from_result({"masks": stack[:, :1], "boxes": np.zeros((2, 4)), "scores": [0.2, 0.4]})
    assert found.masks.shape == (2, 4, 4) and len(models.from_result({"masks": [], "boxes": [], "scores": []}).masks) == 0
    for bad in ({"masks": stack}, {"masks": stack[:, 0], "boxes": np.zeros((1, 4)), "scores": [1, 1]}, {"masks": np.zeros((2, 2)), "boxes": np.zeros((2, 4)), "scores": [1, 1]}):
        with pytest.raises(ValueError):
            models.from_result(bad)
    assert models.confident(found, 0.3).scores.tolist() == pytest.approx([0.4]) and len(models.confident(found, 0.9, False).scores) == 0
    assert models.confident(found, 0.9).scores.tolist() == pytest.approx([0.4])


def bright_backend():
    """A model of the tests: segments are the bright and the dark pixels."""

    def make():
        return lambda pixels, text, boxes, points: {"segmentation": (pixels[:, :, 0] > 100).astype(int), "segments_info": [{"id": 1, "label_id": 7, "score": 0.75}, {"id": 0, "label_id": 8, "score": 0.25}]}

    return models.ModelBackend("bright", make, "segments", {7: "tree crowns", 8: "ground"})


def test_predictions_validate_as_they_are_written(spark, tmp_path, capsys, monkeypatch):
    a = np.zeros((96, 96, 3), dtype=np.uint8)
    a[30:50, 40:60] = 200
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(a, formats.RasterMeta(96, 96, 3, 0.0, 0.0, 1.0, -1.0, "EPSG:4326", None), "lzw"))
    (tmp_path / "i.csv").write_text("TreeID;StemTag;Latin;Status;PX;PY;DBH\n")
    monkeypatch.chdir(tmp_path)
    monkeypatch.syspath_prepend(str(Path(__file__).parent))
    monkeypatch.setattr(spark, "stop", lambda: None)
    assert cli.main(["predict", "a.tif", "--text", "tree", "--tile-size", "64", "--overlap", "32"]) == 2 and "no text" in capsys.readouterr().err
    assert cli.main(["predict", "none.tif", "--bbox", "1,2,3,4"]) == 2 and "none.tif" in capsys.readouterr().err
    assert cli.main(["predict", "a.tif", "--text", "Tree", "--backend", "test_files:bright_backend", "--tile-size", "64", "--overlap", "32", "--merge-iou", "0.1", "--pictures", "--output", "out"]) == 0
    made = json.loads((tmp_path / "out" / "run_metadata.json").read_text())
    assert made["prompt"]["text"] == "Tree" and len(list((tmp_path / "out" / "masks" / "tiles").glob("*.npz"))) == 9 and len(list((tmp_path / "out" / "tiles_annotated").glob("*.png"))) == 9
    merged = readers.merged_masks(spark, str(tmp_path / "out" / "masks" / "image_masks.npz"))
    assert merged.select("label_id").distinct().count() == 1 and merged.agg(F.max("mask_area")).first()[0] == 400
    runs, extents = readers.tile_masks(spark, str(tmp_path / "out" / "masks" / "tiles"), 96, 96)
    trees = spark.createDataFrame([(0, "a", None, 45.0, 40.0), (1, "b", None, 5.0, 5.0)], "ord long, tree_id string, stem_id string, x double, y double")
    for table, summary in (W.validate(spark, trees, runs, extents, 96, 96), W.validate(spark, trees, merged, None, 96, 96)):
        assert [r.label_id is not None for r in table.collect()] == [True, False] and summary.first().tp == 1
    # a tile without a prompt has an empty archive and a row of count 0
    asked = W.Prompts(boxes=[(1.0, 1.0, 9.0, 9.0)])
    got = W.predict_masks(spark, "a.tif", asked, W.BoxBackend(), tile_size=64, overlap=32)
    said = W.write_predictions(spark, "a.tif", tmp_path / "boxes", asked, *got, archive=False)
    assert said["masks"] == 1 and said["tiles"] == 9 and not (tmp_path / "boxes" / "masks" / "image_masks.npz").exists()
    z = formats.npz_tile((tmp_path / "boxes" / "masks" / "tiles" / "tile_x64_y64.npz").read_bytes())
    assert z["masks"].shape == (0, 32, 32) and z["tile_origin"].tolist() == [64, 64]
    monkeypatch.setattr(writers, "ARCHIVE_PIXELS", 10)
    with pytest.raises(ValueError, match="too many"):
        writers.write_merged_archive(got[0], 96, 96, tmp_path / "x.npz")
    for bad in ("nothing", "json:nothing", "no.such.module:x"):
        with pytest.raises(ValueError):
            models.backend_of(bad)


def test_older_workflows(spark, tmp_path):
    a = np.zeros((40, 60, 3), dtype=np.uint8)
    a[5:12, 5:12] = 200
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(a))
    image, out = str(tmp_path / "a.tif"), tmp_path / "cached"
    first = W.predict_cached(spark, image, out, bright_backend(), "tree", 32, 8, most=3)
    assert (first["tiles"], first["processed"], first["skipped"], first["masks"]) == (3, 3, 0, 1) and first["seconds"] > 0
    assert sorted(p.name for p in out.glob("*.png")) == ["tile_0000_x0_y0_overlap8.png", "tile_0001_x24_y0_overlap8.png", "tile_0002_x48_y0_overlap8.png"]
    again = W.predict_cached(spark, image, out, bright_backend(), "tree", 32, 8)
    assert (again["tiles"], again["processed"], again["skipped"]) == (6, 3, 3) and len(list(out.glob("*.npz"))) == 6
    assert W.predict_cached(spark, image, tmp_path / "other", bright_backend(), "tree", 32, 8, start=(1, 0))["tiles"] == 4
    assert W.label_by_boxes(spark, image, [(4.0, 4.0, 12.0, 12.0)], tmp_path / "boxes", W.BoxBackend(), tile_size=32, overlap=8) == 6
    drawn = formats.png_decode((tmp_path / "boxes" / "tiles_annotated" / "tile_x0_y0.png").read_bytes())
    plain = formats.png_decode((tmp_path / "boxes" / "tiles_rgb" / "tile_x0_y0.png").read_bytes())
    assert (plain == a[:32, :32]).all() and (drawn[4:12, 4:12] != plain[4:12, 4:12]).any() and (drawn[20:, 20:] == plain[20:, 20:]).all()


def test_weak_labels_as_files(spark, tmp_path, monkeypatch):
    a = np.full((96, 96, 3), 50, dtype=np.uint8)
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(a, formats.RasterMeta(96, 96, 3, 500000.0, 5300000.0, 1.0, -1.0, "EPSG:32633", None), "lzw", True, 16))
    rows = [(f"t{k}", 500010.0 + 20 * k, 5299990.0 - 20 * k) for k in range(4)]
    writers.write_layer(tmp_path / "i.shp", [r[1:] for r in rows], [("TreeID", "C", 8, 0), ("DBH", "N", 10, 3)], [[r[0], 300] for r in rows], UTM33)
    monkeypatch.chdir(tmp_path)
    assert cli.main(["weak", "a.tif", "--inventory-shp", "i.shp", "--tile-size", "64", "--overlap", "32", "--pictures", "--output", "out"]) == 0
    table = readers.text_table(spark, str(tmp_path / "out" / "weak_labels.csv"), ",")
    layer = readers.shapes(spark, str(tmp_path / "out" / "weak_labels.shp"))
    assert table.count() == layer.count() > 4 and set(layer.columns) >= {"tile_id", "crown_px", "x_long", "y_lat"} and (tmp_path / "out" / "run_metadata.json").exists()
    both = sorted((r.tile_id, r.tree_id) for r in table.collect())
    assert both == sorted((r.tile_id, r.tree_id) for r in layer.collect())
    pictures = {p.stem for p in (tmp_path / "out" / "visualizations" / "tiles").glob("*.tif")}
    assert pictures == {t for t, _ in both} and "tile_x0_y64" not in pictures
    t = formats.Tiff((tmp_path / "out" / "visualizations" / "tiles" / "tile_x0_y0.tif").read_bytes())
    drawn = t.window(0, 0, 64, 64)
    assert t.tags[259] == (5,) and (drawn[10, 10] != 50).any() and (drawn == np.array(drawing.CROWN)).all(axis=2).any()


def test_order_after_duplicates_have_gone(spark):
    rows = [(0, "b", 1.0, 2.0, 5.0), (1, "a", 3.0, 1.0, 1.0), (2, "", 9.0, 9.0, 1.0), (3, "a", 2.0, 1.0, 7.0), (4, "", 1.0, 9.0, 1.0)]
    trees = spark.createDataFrame(rows, "ord long, tree_id string, lon double, lat double, dbh_cm double")
    got = I.in_id_order(I.deduplicate(trees), "lon", "lat").orderBy("ord").collect()
    assert [(r.tree_id, r.lon) for r in got] == [("", 1.0), ("", 9.0), ("a", 2.0), ("b", 1.0)]


def test_reconstruction(spark, tmp_path):
    a = (np.arange(70 * 50 * 3) * 7 % 251).astype(np.uint8).reshape(50, 70, 3)
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(a))
    W.write_tiles(spark, str(tmp_path / "a.tif"), str(tmp_path / "out"), 32, 24, 6)
    blocks, w, h = W.reconstructed(spark, str(tmp_path / "out"), side=20)
    assert (w, h) == (70, 50) and blocks.count() == 12 and (W.reconstruct(spark, str(tmp_path / "out"))[:, :, :3] == a).all()
    # a gray tile of twice its size is taken for what its place holds
    folder = tmp_path / "gray"
    (folder / "tiles_rgb").mkdir(parents=True)
    (folder / "metadata.json").write_text('{"original_shape": [8, 8, 1], "tile_size": [8, 8], "overlap": [0, 0]}')
    (folder / "tiles_rgb" / "tile_x0_y0.png").write_bytes(formats.png_encode(np.full((16, 16, 1), 90, dtype=np.uint8)))
    got = W.reconstruct(spark, str(folder))
    assert (got[:, :, :3] == 90).all() and (got[:, :, 3] == 255).all()
    assert pixels.resized(np.array([[[0], [100]]], dtype=np.uint8), 4, 1).ravel().tolist() == [0, 25, 75, 100]


def test_points_are_written_by_the_executors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    pts = np.round(rng.uniform(-50, 50, (5000, 3)), 2)
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["a", "b", "c"])).repartitionByRange(5, "a").sortWithinPartitions("a")
    assert writers.write_las(df, tmp_path / "a.las", 0.01) == 5000
    assert (tmp_path / "a.las").read_bytes() == formats.las_encode(df.toPandas().to_numpy(), 0.01)
    assert writers.write_las(df.where("a > 99"), tmp_path / "a.las") == 0 and readers.las(spark, str(tmp_path / "a.las")).count() == 0
    for x in (None, float("nan"), 1e9):
        with pytest.raises(ValueError, match="point"):
            writers.write_las(spark.createDataFrame([(0.0, 0.0, 0.0), (x, 1.0, 1.0)], "x double, y double, z double"), tmp_path / "b.las")
    # nor does the query bring its rows to the driver
    monkeypatch.setattr(type(df), "toPandas", lambda self: pytest.fail("rows at the driver"))
    spark.range(3000).selectExpr("id % 50 + 1.0D AS l_quantity", "id % 11 / 100.0D AS l_discount", "id * 1.25D AS l_extendedprice").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = queries.QUERIES["las_grid"](spark, str(tmp_path)).collect()
    assert len(got) == 80 and max(r.z for r in got) == 2999 * 1.25


def test_masks_are_packed_in_stretches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "STRETCH_PIXELS", 3 * 9 * 13)
    rng = np.random.default_rng(4)
    masks = rng.random((20, 9, 13)) > 0.6
    masks[[0, 7]] = False
    masks[3] = True
    rows = spark.createDataFrame([(k, m.tobytes()) for k, m in enumerate(masks)], "place long, data binary").repartition(4)
    writers.write_masks(rows, lambda r: np.frombuffer(r.data, dtype=bool).reshape(9, 13), 20, 13, 9, tmp_path / "m.npz", scores=np.arange(20) / 8)
    with np.load(tmp_path / "m.npz") as z:  # which checks the sum over the stretches
        assert (z["masks"] == masks).all() and z["scores"].tolist() == [k / 8 for k in range(20)]
    np.savez(tmp_path / "c.npz", masks=np.asfortranarray(masks.astype(np.float32)), scores=np.arange(20) / 8)
    want = sorted((k, k / 8, int(m.sum()), *(r or (-1,) * 3)) for k, m in enumerate(masks) for r in formats.runs(m) or [None])
    for name in ("m.npz", "c.npz"):
        got = readers.merged_masks(spark, str(tmp_path / name)).na.fill(-1).collect()
        assert sorted(tuple(r) for r in got) == want
    assert [k for k, *_ in formats.npz_blocks(tmp_path / "m.npz", 2 * 9 * 13)] == [*range(0, 20, 2)] and [p.name for p in tmp_path.iterdir() if p.name.startswith(".")] == []
    writers.write_masks(rows.limit(0), None, 0, 13, 9, tmp_path / "m.npz", scores=np.zeros(0))
    assert readers.merged_masks(spark, str(tmp_path / "m.npz")).count() == 0


def test_layers_are_written_by_the_executors(spark, tmp_path, monkeypatch):
    names = [f[4] for f in writers.LABEL_FIELDS]
    rows = [(f"tile_{k % 7}", None if k % 5 == 0 else f"t\u00e9{k}", k, -k, k / 8, k / 3, 0.0, 1.0, 2.0, 9 + k / 64, 48 - k / 64, None if k % 4 == 0 else k / 7) for k in range(3000)]
    kinds = ", ".join(f"{n} {'string' if f[1] == 'C' else 'int' if f[3] == 0 else 'double'}" for n, f in zip(names, writers.LABEL_FIELDS, strict=True))
    labels = spark.createDataFrame(rows, kinds).repartition(6).orderBy(F.desc("x_pixel"))
    want = formats.shp_encode([(r[9], r[10]) for r in rows[::-1]], [f[:4] for f in writers.LABEL_FIELDS], [list(r) for r in rows[::-1]])
    # no rows come to the driver, and records aren't put to the end of a growing text
    monkeypatch.setattr(formats, "shp_encode", lambda *a: pytest.fail("a layer made at the driver"))
    assert writers.write_label_layer(labels, tmp_path / "a.shp") == 3000
    assert all((tmp_path / f"a.{kind}").read_bytes() == data for kind, data in want.items())
    assert writers.write_label_layer(labels.where("x_pixel < 0"), tmp_path / "a.shp") == 0 and readers.shapes(spark, str(tmp_path / "a.shp")).count() == 0
    with pytest.raises(ValueError, match="no place"):
        writers.write_label_layer(labels.withColumn("x_long_wgs84", F.lit(None).cast("double")), tmp_path / "b.shp")


def test_height_pictures(spark, tmp_path):
    rng = np.random.default_rng(2)
    pts = np.column_stack([rng.uniform(0, 30, 4000), rng.uniform(0, 20, 4000), rng.uniform(0, 25, 4000)])
    (tmp_path / "a.las").write_bytes(formats.las_encode(pts))
    size = W.write_height_picture(spark, str(tmp_path / "a.las"), tmp_path / "h.png", "max", resolution=1.0)
    grid = W.height_map(spark, str(tmp_path / "a.las"), "max", resolution=1.0)
    got = formats.png_decode((tmp_path / "h.png").read_bytes())[:, :, 0]
    held = grid[grid > 0]
    want = np.where(grid > 0, ((grid.astype(float) - held.min()) / (float(held.max()) - float(held.min())) * 255).astype(int) % 256, 0)[::-1]
    assert got.shape == (size[1], size[0]) and np.abs(got.astype(int) - want).max() <= 1
    image = rng.integers(0, 256, (20, 30, 3)).astype(np.uint8)
    (tmp_path / "a.tif").write_bytes(formats.tiff_encode(image))
    assert W.write_height_overlay(spark, str(tmp_path / "a.tif"), str(tmp_path / "a.las"), tmp_path / "over", side=16) == 4
    spec_grid, spec = R.height_grid(readers.las(spark, str(tmp_path / "a.las")), "max", width=30, height=20)
    gray = {(r.row, r.col): r.gray for r in R.flipped(R.gray_cells(spec_grid), spec.height).collect()}
    part = formats.png_decode((tmp_path / "over" / "tile_x16_y0.png").read_bytes())
    assert all((part[y, x] == image[y, x + 16] * np.uint8(gray.get((y, x + 16), 0))).all() for y in range(16) for x in range(14))
    with pytest.raises(FileNotFoundError):
        W.write_height_picture(spark, str(tmp_path / "b.las"), tmp_path / "x.png")


def test_drawing():
    a = np.zeros((30, 40, 1), dtype=np.uint8)
    out = drawing.draw_labels(a, [{"x_pixel": 20, "y_pixel": 15, "crown_radius": 5.2, "bbox_x1": 10.4, "bbox_y1": 5, "bbox_x2": 29.6, "bbox_y2": 25}, {"x_pixel": -9, "y_pixel": 99, "crown_radius": 0, "bbox_x1": 39, "bbox_y1": 29, "bbox_x2": 39, "bbox_y2": 29}])
    assert tuple(out[15, 20]) == tuple(round(0.3 * c) for c in drawing.CROWN) and tuple(out[15, 25]) == drawing.CROWN and tuple(out[5, 15]) == drawing.BOX and not out[0, 0].any() and not a.any()
    mask = np.zeros((30, 40), dtype=bool)
    mask[10:20, 10:20] = True
    out = drawing.draw_detections(a, [mask], [[10, 10, 20, 20]], [0.5], "a1")
    assert tuple(out[15, 15]) == (153, 153, 0) and tuple(out[10, 10]) == (255, 255, 0) and (out[1:10] == 255).any() and out[2:9, 10:30].any()


def test_small_builders(spark):
    df = spark.createDataFrame([("out/tile_0012_x-3_y40_overlap8.png",), ("tile_1_x2_y3_overlap0.npz",), ("tile_x0_y0.png",), ("other.png",), (None,)], "n string")
    got = [r.t for r in df.select(C.legacy_tile(F.col("n")).alias("t")).collect()]
    assert tuple(got[0]) == (12, -3, 40, 8) and tuple(got[1]) == (1, 2, 3, 0) and got[2:] == [None, None, None]
    assert spark.range(1).select(C.legacy_tile_name(F.lit(12), F.lit(-3), F.lit(40), F.lit(8))).first()[0] == "tile_0012_x-3_y40_overlap8.png"
    assert spark.range(1).select(D.label_matches(F.lit("Tree Crown"), " CROWN "), D.label_matches(F.lit("x"), "crown")).first()[:] == (True, False)
    cells = spark.createDataFrame([(0, 0, 9), (2, 3, 7), (4, 4, 5)], "row int, col int, value int")
    assert sorted(tuple(r) for r in R.crop(cells, 3, 2, 5, 5).collect()) == [(0, 0, 7), (2, 1, 5)]
    gray = cells.select("row", "col", F.col("value").alias("gray"))
    assert sorted(tuple(r) for r in R.overlay(cells.withColumn("value", F.lit(100)).withColumn("channel", F.lit(0)), gray).collect()) == [(0, 0, 0, 900 % 256), (2, 3, 0, 700 % 256), (4, 4, 0, 500 % 256)]
    grid = Grid(100, 50, 32, 8)
    assert [(r.x0, r.y0) for r in grid.frame(spark, (1, 0), 4).collect()] == [(32, 0), (56, 0), (80, 0), (32, 24)] and grid.frame(spark, (9, 9)).count() == 0


def test_docs(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg" / "a.py").write_text('"""Module a."""\n\n\nclass K:\n    """A class."""\n\n    def m(self, x: int = 1) -> int:\n        return x\n\n    def _p(self):\n        """Hidden."""\n\n\ndef f(a, *, b=2):\n    """Does f."""\n\n    def inner():\n        """Inside."""\n')
    (tmp_path / "pkg" / "b.py").write_text("def g():\n    pass\n")
    (tmp_path / "pkg" / "broken.py").write_text("def (")
    found = docs.definitions(spark, str(tmp_path))
    got = {r.category: (r.total, r.documented) for r in docs.coverage(found).collect()}
    assert got == {"modules": (2, 1), "classes": (1, 1), "public functions": (4, 2), "private functions": (1, 1)}
    a = str(tmp_path / "pkg" / "a.py")
    (tmp_path / "f.json").write_text(json.dumps([{"filename": a, "location": {"row": 17}, "code": "D205"}, {"filename": a, "location": {"row": 8}, "code": "D400"}, {"filename": a, "location": {"row": 7}, "code": "D102"}, {"filename": str(tmp_path / "x.py"), "location": {"row": 1}, "code": "D205"}]))
    per, bad = docs.compliance(found, docs.findings(spark, str(tmp_path / "f.json")))
    # row 8 lies in an undocumented method, so it counts for the class
    assert {r.category: (r.total, r.compliant) for r in per.collect()} == {"modules": (1, 1), "classes": (1, 0), "public functions": (2, 1), "private functions": (1, 1)}
    assert {(r.problem, r.name) for r in bad.collect()} == {("undocumented", "K.m"), ("undocumented", "g"), ("style", "f.inner")}
    assert docs.write_pages(found, tmp_path / "pages") == 2
    page = (tmp_path / "pages" / "pkg-a.md").read_text()
    assert "m(self, x: int=1) -> int" in page and "f(a, *, b=2)" in page and "_p" not in page and "[pkg-a](pkg-a.md): Module a." in (tmp_path / "pages" / "index.md").read_text()


def test_fetch(tmp_path):
    (tmp_path / "w.bin").write_bytes(b"x" * (3 << 20))
    told = []
    assert models.fetch(f"file://{tmp_path}/w.bin", str(tmp_path / "got.bin"), lambda n, of: told.append((n, of))) == 3 << 20
    assert told[-1] == (3 << 20, 3 << 20) and (tmp_path / "got.bin").stat().st_size == 3 << 20 and not (tmp_path / "got.bin.part").exists()
