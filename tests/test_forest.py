"""The forest operators against plain versions and known values."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arbora.functions import columns as C
from arbora.functions.geodesy import crs_of, direct, origin_wgs84, to_raster, utm, utm_inverse
from arbora.operators import detections as D
from arbora.operators import inventory as I
from arbora.operators import rasters as R
from arbora.operators import tiles as T
from arbora.plans import workflows as W
from arbora.sources import formats, readers


def test_nms_is_greedy(spark):
    rng = random.Random(1)
    boxes = []
    for k in range(80):
        x, y = rng.randrange(60), rng.randrange(60)
        boxes.append((k, float(x), float(y), float(x + rng.randrange(5, 25)), float(y + rng.randrange(5, 25)), rng.randrange(10) / 10))

    def iou(a, b):
        w, h = max(0, min(a[3], b[3]) - max(a[1], b[1])), max(0, min(a[4], b[4]) - max(a[2], b[2]))
        return w * h / ((a[3] - a[1]) * (a[4] - a[2]) + (b[3] - b[1]) * (b[4] - b[2]) - w * h)

    kept = []
    for b in sorted(boxes, key=lambda b: (-b[5], b[0])):
        if all(iou(a, b) <= 0.3 for a in kept):
            kept.append(b)
    df = spark.createDataFrame(boxes, "ord long, x1 double, y1 double, x2 double, y2 double, score double")
    assert {r.ord for r in D.suppress(df, 0.3, 16.0).collect()} == {b[0] for b in kept}


def test_match_is_greedy(spark):
    rng = random.Random(2)
    edges = list({(rng.randrange(15), rng.randrange(12)): (rng.randrange(4) / 4, rng.randrange(3)) for _ in range(70)}.items())
    rows = [(t, lab, s, a) for (t, lab), (s, a) in edges]
    trees, labels, want = set(), set(), set()
    for t, lab, s, a in sorted(rows, key=lambda e: (-e[2], e[3], e[1], e[0])):
        if t not in trees and lab not in labels:
            trees.add(t), labels.add(lab), want.add((t, lab))
    df = spark.createDataFrame(rows, "tree_index long, label_id long, score double, mask_area long")
    assert {(r.tree_index, r.label_id) for r in D.match(df).collect()} == want
    assert D.match(df.limit(0)).count() == 0


def test_range_join_makes_no_nested_loop(spark):
    trees = spark.createDataFrame([(0, "a", 10.0, 10.0, 30.0), (1, "b", 63.9, 40.0, 50.0), (2, "c", -1.0, 5.0, 9.0)], "ord long, tree_id string, x double, y double, dbh_cm double")
    grid = T.Grid(96, 96, 64, 32)
    labels = T.weak_labels(trees, grid, C.Crown(), 1.0)
    assert "NestedLoop" not in labels._jdf.queryExecution().toString() and "Exchange" not in labels._jdf.queryExecution().toString()
    got = {(r.tree_id, r.tile_id) for r in labels.collect()}
    want = set()
    for t in grid.frame(spark).collect():
        for name, x, y, d in (("a", 10, 10, 30), ("b", 63.9, 40, 50)):
            r = min(max(0.08 * d, 0.5), 15)
            if (x - min(max(x, t.x0), t.x1)) ** 2 + (y - min(max(y, t.y0), t.y1)) ** 2 <= r * r:
                want.add((name, t.tile_id))
    assert got == want and grid.frame(spark).count() == 9


def test_grid_guards():
    for bad in ((10, 10, 0, 0), (10, 10, 5, 5), (10, 10, 5, -1)):
        with pytest.raises(ValueError):
            T.Grid(*bad)


def test_inventory(spark):
    rows = [("1", "s", "Oak", "Alive", "1,5", "2", "300"), ("1", "", "Oak", "alive ", "1", "2", "400"), ("", "", "", "ALIVE", "1", "2", "12"), ("", "", "", "alive", "1", "2", "13"), ("2", "", "Ash", "dead", "1", "2", "50"), ("3", "", "Ash", "alive", "x", "2", "50"), ("4", "", "Ash", "alive", "1", "2", "0"), ("5", "", "Ash", "alive", "1", "2", "5d"), ("6", "", "Ash", None, "1", "2", "5"), ("7", "", "Ash", "alive", "1", "2", "nan")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "TreeID string, StemTag string, Latin string, Status string, PX string, PY string, DBH string, ord long")
    trees = I.clean_csv(df, "Status", "alive", "PX", "PY", "DBH", "mm")
    assert sorted(r.ord for r in trees.collect()) == [0, 1, 2, 3, 9]
    kept = I.deduplicate(trees)
    assert sorted(r.ord for r in kept.collect()) == [1, 2, 3, 9]
    assert trees.where("ord = 0").first().x == 1.5 and trees.where("ord = 0").first().dbh_cm == 30.0
    assert I.clean_csv(df.limit(0), "Status", "alive", "PX", "PY", "DBH", "mm").count() == 0
    shapes = I.clean_shapes(spark.createDataFrame([(0, 1.0, 2.0, "", None, "x"), (1, None, None, "", "9", "3")], "ord long, x double, y double, STATUS string, treeid string, dbh string"), "Status", "alive", "DBH")
    r = shapes.collect()
    assert len(r) == 1 and r[0].tree_id == "shp_0" and r[0].dbh_cm == -1.0 and r[0].status == "alive"


def test_columns(spark):
    df = spark.createDataFrame([("1,2,3,4", "5,6", "a/tile_x-3_y7.png"), ("1,2,1,4", "5", "x.png"), ("1,b,1,4", "5,z", None), (None, None, "tile_x1_y2")], "b string, p string, n string")
    got = df.select(C.bbox_prompt(F.col("b")).alias("b"), C.point_prompt(F.col("p")).alias("p"), C.tile_origin(F.col("n")).alias("o")).collect()
    assert [r.b.error for r in got] == [None, "order", "number", "count"] and got[0].b.box.x2 == 3.0
    assert [r.p.error for r in got] == [None, "count", "number", "count"]
    assert got[0].o.x == -3 and got[1].o is None and got[2].o is None and got[3].o.y == 2
    one = spark.range(1)
    assert one.select(C.title_case(F.lit("norway maple x-y"))).first()[0] == "Norway Maple X-Y"
    assert one.select(C.Crown(most=2.0).radius(F.lit(-1.0))).first()[0] == 2.5
    assert one.select(C.gray(F.lit(3.0), F.lit(0.0), F.lit(2.0))).first()[0] == 382 % 256
    assert one.select(C.box_labels(F.array(F.lit(0)), F.lit(3))).first()[0] == [0, 1, 1]
    for f, bad in ((C.parse_bbox, ("1,2", "a,b,c,d", "1,1,1,2")), (C.parse_point, ("1", "a,b"))):
        for text in bad:
            with pytest.raises(ValueError):
                f(text)


def test_geodesy(spark):
    e, n = utm(F.lit(9.5), F.lit(48.2), 32)
    got = spark.range(1).select(e, n).first()
    lon, lat = utm_inverse(got[0], got[1], 32)
    assert abs(lon - 9.5) < 1e-9 and abs(lat - 48.2) < 1e-9
    assert abs(got[0] - 537153) < 5 and abs(got[1] - 5338600) < 200
    lon, lat = direct(np.array([0.0]), np.array([0.0]), np.array([90.0]), np.array([111319.49079327358]))
    assert abs(lon[0] - 1) < 1e-9 and abs(lat[0]) < 1e-9
    assert crs_of("EPSG:32733") == ("utm", 33, False) and crs_of(" ") is None
    assert crs_of("EPSG:25832") == ("utm", 32, True) and crs_of("EPSG:26917") == ("utm", 17, True)
    with pytest.raises(ValueError):
        crs_of("EPSG:2056")
    x, y = spark.range(1).select(*to_raster(F.lit(-100 - 1 / 3), F.lit(24 + 22 / 60 + 54.433 / 3600), "EPSG:3857")).first()
    assert abs(x + 11169055.58) < 0.01 and abs(y - 2800000) < 0.01
    assert origin_wgs84(x, y, "EPSG:3857") == pytest.approx((-100 - 1 / 3, 24 + 22 / 60 + 54.433 / 3600))


def test_height_grid(spark, tmp_path):
    pts = np.array([[0.2, 0.2, 1], [0.2, 1.2, 2], [1.2, 0.2, 3], [1.2, 1.2, 4.0]])
    (tmp_path / "a.las").write_bytes(formats.las_encode(pts))
    assert W.height_map(spark, str(tmp_path / "a.las")).tolist()[0][0] == 1.0
    assert readers.las(spark, str(tmp_path / "a.las"), rows=3).count() == 4
    df = spark.createDataFrame([(0.2, 0.2, 1.0), (0.4, 0.4, 2.0), (0.6, 0.6, 3.0)], "x double, y double, z double")
    for method in ("mean", "median"):
        assert [r.z for r in R.cells(df, R.GridSpec(0.0, 0.0, 1.0, 1, 1), method).collect()] == [2.0]
    assert R.grid_spec(0, 10, 0, 10).width == 20
    for bad in ({"resolution": 1.0, "width": 3}, {"width": 0}, {"resolution": 0.0}):
        with pytest.raises(ValueError):
            R.grid_spec(0, 1, 0, 1, **bad)
    with pytest.raises(ValueError):
        R.grid_spec(0, 0, 0, 1)
    with pytest.raises(FileNotFoundError):
        W.height_map(spark, str(tmp_path / "none.las"))


def _raster(path, width, height, channels=1):
    a = (np.arange(width * height * channels) * 7 % 251).astype(np.uint8).reshape(height, width, channels)
    path.write_bytes(formats.tiff_encode(a, formats.RasterMeta(width, height, channels, 0.0, 0.0, 1.0, -1.0, "EPSG:4326", None)))
    return a


def test_formats(tmp_path):
    a = _raster(tmp_path / "a.tif", 9, 7, 3)
    assert (formats.png_decode(formats.png_encode(a)) == a).all()
    t = formats.Tiff((tmp_path / "a.tif").read_bytes())
    assert (t.window(2, 1, 5, 4) == a[1:5, 2:7]).all() and t.meta().crs == "EPSG:4326"
    got = formats.shp_encode([(1.0, 2.0)], [("TreeID", "C", 8, 0), ("DBH", "N", 10, 3)], [["a", 1.5]])
    assert formats.shp_shapes(got["shp"]) == [(1.0, 2.0)] and formats.dbf_rows(got["dbf"])[1] == [{"TreeID": "a", "DBH": "1.500"}]
    for bad in (formats.png_decode, formats.Tiff, formats.las_header, formats.shp_shapes):
        with pytest.raises(ValueError):
            bad(b"nothing of the kind" * 20)


def test_narrowest_of_many_spans_over_a_point(spark):
    """Rows follow the numbers of points and spans, not those of the pairs of them."""
    rng = np.random.default_rng(5)
    spans = [(k, int(a), int(a + w)) for k, (a, w) in enumerate(zip(rng.integers(-40, 60, 400), rng.integers(-3, 60, 400), strict=True))] + [(400, None, 3), (401, 3, None)]
    points = [(k, int(v)) for k, v in enumerate(rng.integers(-60, 140, 300))] + [(300, None)]
    for scale in (1, 0.37):
        of = lambda v, scale=scale: None if v is None else v * scale
        kind = "long" if scale == 1 else "double"
        p = spark.createDataFrame([(k, of(v)) for k, v in points], f"ord long, at {kind}")
        s = spark.createDataFrame([(k, of(a), of(b)) for k, a, b in spans], f"span_id long, start {kind}, end {kind}")
        got = {r.ord: (r.span_id, r.span) for r in D.narrowest(p, s, 16).collect()}
        for k, v in points:
            over = [(of(b) - of(a), of(a), n) for n, a, b in spans if None not in (v, a, b) and of(a) <= of(v) <= of(b)]
            assert got[k] == ((min(over)[2], min(over)[0]) if over else (None, None))
    # 20,000 spans over each of 20,000 points: 400 million pairs
    many = spark.range(20000).select(F.col("id").alias("span_id"), (-F.col("id")).alias("start"), (F.col("id") + 200).alias("end"))
    at = spark.range(20000).select(F.col("id").alias("ord"), (F.col("id") % 200).alias("at"))
    plan = D.narrowest(at, many, 1 << 20)
    assert plan.agg(F.count("span_id"), F.max("span_id"), F.max("span")).first()[:] == (20000, 0, 200)
    joins, todo = [], [plan._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
        if node.nodeName() == "Join":
            joins.append(node.toString().split("\n")[0])
    assert joins and all(" = " in j and ">=" not in j for j in joins)  # by equal keys only, never every span over a point


def test_tiles_come_back(spark, tmp_path):
    a = _raster(tmp_path / "a.tif", 40, 30, 3)
    assert W.write_tiles(spark, str(tmp_path / "a.tif"), str(tmp_path / "out"), 16, 16, 4) == 12
    back = W.reconstruct(spark, str(tmp_path / "out"))
    assert (back[:, :, :3] == a).all() and (back[:, :, 3] == 255).all()


def test_predict_merges_over_tiles(spark, tmp_path):
    _raster(tmp_path / "a.tif", 96, 96, 3)
    prompts = W.Prompts(boxes=[(40.0, 40.0, 50.0, 50.0)])
    merged, found, index = W.predict_masks(spark, str(tmp_path / "a.tif"), prompts, W.BoxBackend(), tile_size=64, overlap=32)
    m = merged.collect()
    assert len(m) == 1 and (m[0].x1, m[0].y1, m[0].x2, m[0].y2) == (40, 40, 50, 50)
    assert index.count() == 9 and found.count() == index.where("count > 0").count() == 4
    for bad in (W.Prompts(), W.Prompts(text="tree", boxes=[(0, 0, 1, 1)])):
        with pytest.raises(ValueError):
            bad.check("dinov3")
    with pytest.raises(ValueError):
        W.Prompts(text="tree").check("sam2")


def test_validate(spark, tmp_path):
    folder = tmp_path / "tiles"
    folder.mkdir()
    for name, origin, score in (("tile_x0_y0", (0, 0), 0.6), ("tile_x2_y0", (2, 0), 0.8)):
        masks = np.zeros((1, 4, 4), dtype=bool)
        masks[0, 1, 3 - origin[0]] = True
        masks[0, 2, 2 - origin[0] + (1 if origin[0] else 0)] = True
        np.savez(folder / f"{name}.npz", tile_id=name, tile_origin=np.array(origin), tile_size=np.array([4, 4]), masks=masks, boxes=np.zeros((1, 4)), scores=np.array([score]))
    runs, extents = readers.tile_masks(spark, str(folder), 6, 6)
    trees = spark.createDataFrame([(0, "a", None, 3.0, 1.0), (1, "b", "s", 2.0, 2.0), (2, "c", "", 5.0, 5.0)], "ord long, tree_id string, stem_id string, x double, y double")
    table, summary = W.validate(spark, trees, runs, extents, 6, 6)
    r = table.collect()
    assert [x.label_id for x in r] == [1, 0, None] and [x.prediction_coverage for x in r] == [True, True, False]
    assert [x.stem_id for x in r] == ["a", "s", "c"]
    s = summary.first()
    assert (s.tp, s.fp, s.fn, s.total, s.covered) == (2, 0, 1, 3, 2)
    np.savez(tmp_path / "m.npz", masks=np.ones((2, 3, 3), dtype=bool))
    t2, s2 = W.validate(spark, trees.where("ord = 1"), readers.merged_masks(spark, str(tmp_path / "m.npz")), None, 3, 3)
    assert [x.label_id for x in t2.collect()] == [0] and s2.first().fp == 1


def test_stream_of_tiles(spark, tmp_path):
    from arbora.streaming.partial import validate_as_they_come

    folder = tmp_path / "tiles"
    folder.mkdir()
    np.savez(folder / "tile_x0_y0.npz", tile_id="t", tile_origin=np.array([0, 0]), tile_size=np.array([4, 4]), masks=np.ones((1, 4, 4), dtype=bool), scores=np.array([0.5]))
    trees = spark.createDataFrame([(0, "a", None, 3.0, 1.0)], "ord long, tree_id string, stem_id string, x double, y double")
    seen = []
    q = validate_as_they_come(spark, str(folder), trees, 4, 4, str(tmp_path / "c"), lambda t, s, n: seen.append(s.first().tp))
    q.awaitTermination(120)
    assert seen == [1]


def test_weak_boxes(spark, tmp_path):
    head = "tile_id,bbox_x1,bbox_y1,bbox_x2,bbox_y2\n"
    (tmp_path / "a.csv").write_text(head + "t,1,2,3,4\n")
    assert readers.weak_boxes(spark, str(tmp_path / "a.csv")).first().bx2 == 3.0
    (tmp_path / "b.csv").write_text(head + "t,1,2,1,4\n")
    with pytest.raises(Exception, match="row 2"):
        readers.weak_boxes(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("tile_id\nt\n")
    with pytest.raises(ValueError, match="missing"):
        readers.weak_boxes(spark, str(tmp_path / "c.csv"))


def test_species(spark):
    df = spark.createDataFrame([("oak", "1", "a"), ("oak", "1", ""), (None, "2", "b")], "s string, t string, u string")
    r = I.summarise(df, "s", "t", "u", {"oak": "common oak"}).collect()
    assert (r[0].latin_name, r[0].records, r[0].unique_trees, r[0].unique_stems, r[0].english_name) == ("oak", 2, 1, 1, "Common Oak")
    assert r[1].latin_name == "(missing)" and r[1].english_name == "(missing)"


def test_queries_match_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    import os

    from arbora.plans.queries import ORACLES, QUERIES

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for f in os.listdir(d):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{d}/{f}'")
    for name in ("weak_labels", "group_summary_share", "dedup_max_first", "conf_filter_fallback", "nms_merge", "match_summary"):
        df = QUERIES[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(repr([round(v, 6) if isinstance(v, float) else v for v in (r[c] for c in cols)]) for r in df.collect())
        cur = con.execute(ORACLES[name])
        at = [x[0] for x in cur.description]
        want = sorted(repr([round(float(v), 6) if isinstance(v, float) else int(v) if type(v).__name__ == "Decimal" else v for v in (r[at.index(c)] for c in cols)]) for r in cur.fetchall())
        assert got == want, name
