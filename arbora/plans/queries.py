"""The forest operators over the driver's tables, and DuckDB SQL for their rows.

Trees, points and boxes are derived from whole tables with integer arithmetic,
so that both engines start from the same numbers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.geodesy import utm
from ..operators import detections as D
from ..operators import inventory as I
from ..operators import rasters as R
from ..operators import tiles as T
from ..operators.tiles import Grid
from .file_queries import ALL as FILES

Query = Callable[[SparkSession, str], DataFrame]

GRID = Grid(5000, 4000, 1024, 128)
CROWN = C.Crown()
POWER = C.Crown(model="power")
#: Part types by a name of their own, the rest by their own type.
ENGLISH = {"PROMO": "promotion", "STANDARD": "standard wood", "ECONOMY": "economy (bulk)"}


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _order(*names: str):
    """A line's ordinal: its order and line number are a key."""
    return F.col("l_orderkey") * 100 + F.col("l_linenumber")


def _trees(s: SparkSession, d: str) -> DataFrame:
    li = _read(s, d, "lineitem")
    return li.select(
        _order().alias("ord"),
        F.concat(F.lit("T"), F.col("l_orderkey")).alias("tree_id"),
        ((F.col("l_partkey") * 7919 + F.col("l_linenumber") * 31) % 5000 + 0.25).alias("x"),
        ((F.col("l_orderkey") * 10473 + F.col("l_suppkey") * 17) % 4000 + 0.25).alias("y"),
        F.col("l_quantity").alias("dbh_cm"),
    )


_TREES = """SELECT l_orderkey * 100 + l_linenumber AS ord, 'T' || l_orderkey AS tree_id, (l_partkey * 7919 + l_linenumber * 31) % 5000 + 0.25::DOUBLE AS x,
  (l_orderkey * 10473 + l_suppkey * 17) % 4000 + 0.25::DOUBLE AS y, l_quantity AS dbh_cm FROM lineitem"""


def _tiles_sql(g: Grid) -> str:
    step, tall = g.size - g.overlap, g.tall - g.overlap
    return f"""SELECT 'tile_x' || x0 || '_y' || y0 AS tile_id, x0::INT AS x0, y0::INT AS y0, least(x0 + {g.size}, {g.width})::INT AS x1, least(y0 + {g.tall}, {g.height})::INT AS y1
  FROM (SELECT unnest(range(0, {g.width}, {step})) AS x0) a, (SELECT unnest(range(0, {g.height}, {tall})) AS y0) b"""


def _linear(d: str) -> str:
    c = CROWN
    return f"(CASE WHEN {d} > 0 THEN CASE WHEN {c.intercept} + {c.factor} * {d} < {c.least} THEN {c.least} WHEN {c.intercept} + {c.factor} * {d} > {c.most} THEN {c.most} ELSE {c.intercept}::DOUBLE + {c.factor}::DOUBLE * {d} END ELSE {max(c.default, c.least)} END)::DOUBLE"


PIXEL = 0.5
_LABELS = ["tile_id", "tree_id", "x_pixel", "y_pixel", "crown_radius", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "dbh_cm"]


def _weak(s: SparkSession, d: str) -> DataFrame:
    return T.weak_labels(_trees(s, d), GRID, CROWN, PIXEL).select(*_LABELS)


_MEET = "(x - least(greatest(x, x0), x1)) * (x - least(greatest(x, x0), x1)) + (y - least(greatest(y, y0), y1)) * (y - least(greatest(y, y0), y1)) <= r * r"
_WEAK = f"""WITH trees AS ({_TREES}), t AS ({_tiles_sql(GRID)}), r AS (SELECT *, {_linear("dbh_cm")} / {PIXEL}::DOUBLE AS r FROM trees WHERE x >= 0 AND x < 5000 AND y >= 0 AND y < 4000),
j AS (SELECT *, x - x0 AS lx, y - y0 AS ly, x1 - x0 AS w, y1 - y0 AS h FROM r JOIN t ON {_MEET}),
b AS (SELECT *, greatest(0::DOUBLE, lx - r - 4) AS a, greatest(0::DOUBLE, ly - r - 4) AS b, least(w::DOUBLE, lx + r + 4) AS c, least(h::DOUBLE, ly + r + 4) AS e FROM j)
SELECT tile_id, tree_id, round_even(lx, 0)::INT AS x_pixel, round_even(ly, 0)::INT AS y_pixel, round_even(r, 3) AS crown_radius,
  round_even(CASE WHEN c <= a THEN greatest(0::DOUBLE, a - 0.5) ELSE a END, 3) AS bbox_x1, round_even(CASE WHEN e <= b THEN greatest(0::DOUBLE, b - 0.5) ELSE b END, 3) AS bbox_y1,
  round_even(CASE WHEN c <= a THEN least(w::DOUBLE, c + 0.5) ELSE c END, 3) AS bbox_x2, round_even(CASE WHEN e <= b THEN least(h::DOUBLE, e + 0.5) ELSE e END, 3) AS bbox_y2, dbh_cm FROM b"""


def _species(s: SparkSession, d: str, limit: int = 0) -> DataFrame:
    li, part = _read(s, d, "lineitem"), _read(s, d, "part")
    rows = li.join(part, li["l_partkey"] == part["p_partkey"]).select("p_type", "l_orderkey", "l_suppkey")
    return I.summarise(rows, "p_type", "l_orderkey", "l_suppkey", ENGLISH, limit)


_TITLE = "CASE WHEN starts_with({0}, '(') THEN {0} ELSE array_to_string(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(substr(lower({0}), (i - 1)::INT, 1), '\\p{{L}}') THEN upper(substr({0}, i::INT, 1)) ELSE lower(substr({0}, i::INT, 1)) END), '') END"
_CASES = " ".join(f"WHEN latin_name = '{k}' THEN '{v}'" for k, v in ENGLISH.items())
_SPECIES = f"""WITH g AS (SELECT coalesce(nullif(trim(p_type), ''), '(missing)') AS latin_name, count(*) AS records, count(DISTINCT l_orderkey) AS unique_trees, count(DISTINCT l_suppkey) AS unique_stems
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), n AS (SELECT *, CASE {_CASES} ELSE latin_name END AS n FROM g)
SELECT latin_name, records, unique_trees, unique_stems, records * 100.0::DOUBLE / sum(records) OVER () AS share, {_TITLE.format("n")} AS english_name FROM n"""


def _boxes(s: SparkSession, d: str) -> DataFrame:
    """Every customer as a scored box."""
    k = F.col("c_custkey")
    x, y = (k * 7919) % 4900, (k * 10473) % 3900
    return _read(s, d, "customer").select(k.alias("ord"), *[c.cast("double").alias(n) for c, n in ((x, "x1"), (y, "y1"), (x + 20 + k % 80, "x2"), (y + 20 + (k * 3) % 80, "y2"))], ((k * 31) % 997 / 1000.0).alias("score"))


_BOXES = "SELECT c_custkey AS ord, ((c_custkey * 7919) % 4900)::DOUBLE AS x1, ((c_custkey * 10473) % 3900)::DOUBLE AS y1, ((c_custkey * 7919) % 4900 + 20 + c_custkey % 80)::DOUBLE AS x2, ((c_custkey * 10473) % 3900 + 20 + (c_custkey * 3) % 80)::DOUBLE AS y2, ((c_custkey * 31) % 997) / 1000.0::DOUBLE AS score FROM customer"
_RANKED = f"SELECT *, row_number() OVER (ORDER BY score DESC, ord) AS rank FROM ({_BOXES})"
_IOU = """WITH r AS ({0}), p AS (SELECT a.rank AS hi, b.rank AS lo, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS u, (b.x2 - b.x1) * (b.y2 - b.y1) AS v FROM r a JOIN r b ON a.rank < b.rank AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2),
e AS (SELECT hi, lo, i / (u + v - i) AS iou FROM p WHERE i / (u + v - i) > 0.3)"""

_EDGES = "SELECT p_partkey % 500 AS tree_index, (p_partkey * 7919) % 401 AS label_id, max(((p_partkey * 37) % 101) / 100.0::DOUBLE) AS score, max(p_size) AS mask_area FROM part GROUP BY 1, 2"


def _edges(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return _read(s, d, "part").groupBy((k % 500).alias("tree_index"), ((k * 7919) % 401).alias("label_id")).agg(F.max((k * 37) % 101 / 100.0).alias("score"), F.max("p_size").alias("mask_area"))


_MATCH = f"""WITH RECURSIVE e AS ({_EDGES}), o AS (SELECT *, row_number() OVER (ORDER BY score DESC, mask_area, label_id, tree_index) AS r FROM e),
w(r, trees, labels, hit) AS (SELECT 0::BIGINT, []::BIGINT[], []::BIGINT[], false UNION ALL
  SELECT o.r, CASE WHEN f THEN list_append(trees, tree_index) ELSE trees END, CASE WHEN f THEN list_append(labels, label_id) ELSE labels END, f
  FROM (SELECT o.*, w.trees, w.labels, NOT list_contains(w.trees, o.tree_index) AND NOT list_contains(w.labels, o.label_id) AS f FROM w JOIN o ON o.r = w.r + 1) o),
m AS (SELECT tree_index, label_id, score, mask_area FROM w JOIN o USING (r) WHERE hit)"""


def _match_summary(s: SparkSession, d: str) -> DataFrame:
    edges = _edges(s, d)
    trees = s.range(500).select(F.col("id").alias("tree_index"), (F.col("id") % 7 != 0).alias("covered"))
    got = D.match(edges.where("tree_index % 7 <> 0")).select("tree_index", "label_id")
    return D.match_summary(trees.join(got, "tree_index", "left"), edges.select("label_id").distinct())


_POINTS = "SELECT l_quantity AS x, l_discount * 100 AS y, l_extendedprice AS z FROM lineitem"


def _points(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "lineitem").select(F.col("l_quantity").alias("x"), F.round(F.col("l_discount") * 100, 0).alias("y"), F.col("l_extendedprice").alias("z"))


SPEC = R.GridSpec(1.0, 0.0, 2.5, 20, 4)
_BINNED = "SELECT least(greatest(trunc((round(l_discount * 100, 0) - 0.0) / 2.5)::INT, 0), 3) AS row, least(greatest(trunc((l_quantity - 1.0) / 2.5)::INT, 0), 19) AS col, l_extendedprice AS z FROM lineitem"


def _grid(method: str) -> tuple[Query, str]:
    f = {"max": "max", "mean": "avg", "median": "median"}[method]
    return (lambda s, d: R.cells(_points(s, d), SPEC, method)), f"SELECT row, col, {f}(z)::FLOAT AS z FROM ({_BINNED}) GROUP BY 1, 2"


def _events(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "events").select(F.col("event_id").alias("ord"), F.col("user_id").alias("tile"), "event_type", F.col("value").alias("conf"))


def _blend(s: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    rows = _read(s, d, "lineitem").select(((k % 2) * 48).alias("x0"), F.lit(0).alias("y0"), F.lit(64).alias("width"), F.lit(64).alias("height"), ((k % 2) * 48 + k % 64).alias("x"), (F.col("l_partkey") % 64).alias("y"), F.lit(0).alias("channel"), F.col("l_quantity").alias("value"))
    return R.blend(rows, 16).select("y", "x", "channel", F.round("value", 6).alias("value"))


_BLEND = """WITH k AS (SELECT l_orderkey * 7 + l_linenumber AS k, l_partkey % 64 AS ly, l_quantity AS value FROM lineitem),
w AS (SELECT (k % 2) * 48 + k % 64 AS x, ly AS y, value, least(1.0::DOUBLE, (k % 64 + 1.0::DOUBLE) / 17, (64 - k % 64) / 17.0::DOUBLE) * least(1.0::DOUBLE, (ly + 1.0::DOUBLE) / 17, (64 - ly) / 17.0::DOUBLE) AS w FROM k)
SELECT y, x, 0 AS channel, round(sum(w * value) / greatest(sum(w), 1e-6), 6) AS value FROM w GROUP BY y, x"""


def _spans_of_nations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    spans = _read(s, d, "supplier").select(k.alias("span_id"), ((k * 37) % 9000).alias("start"), ((k * 37) % 9000 + 50 + (k * 13) % 900).alias("end"))
    points = _read(s, d, "customer").select(F.col("c_custkey").alias("ord"), ((F.col("c_custkey") * 7919) % 10000).alias("at"))
    return points, spans


_NARROW = """WITH s AS (SELECT s_suppkey AS span_id, (s_suppkey * 37) % 9000 AS a, (s_suppkey * 37) % 9000 + 50 + (s_suppkey * 13) % 900 AS b FROM supplier),
p AS (SELECT c_custkey AS ord, (c_custkey * 7919) % 10000 AS "at" FROM customer),
j AS (SELECT ord, span_id, b - a AS span FROM p JOIN s ON "at" BETWEEN a AND b QUALIFY row_number() OVER (PARTITION BY ord ORDER BY b - a, a, span_id) = 1)
SELECT ord, "at", span_id, span FROM p LEFT JOIN j USING (ord)"""


def _texts(s: SparkSession, d: str) -> DataFrame:
    """Prompt texts of every customer, one in seven of them broken."""
    k = F.col("c_custkey")
    x, y = (k * 31) % 500, (k * 17) % 400
    box = F.concat_ws(",", *[c.cast("string") for c in (x, y, x + k % 7, y + 5)])
    return _read(s, d, "customer").select(k.alias("ord"), F.when(k % 11 == 0, "1,2,3").when(k % 13 == 0, "a,b,c,d").otherwise(box).alias("box"), F.when(k % 11 == 0, "1").otherwise(F.concat_ws(",", x.cast("string"), y.cast("string"))).alias("point"), F.format_string("out/tile_x%d_y%d.png", x - 100, y).alias("path"), F.format_string("Flight_UTM%d%s_rgb.tif", k % 70, F.when(k % 2 == 0, "N").otherwise("s")).alias("image"))


_TEXTS = """SELECT c_custkey AS ord, CASE WHEN c_custkey % 11 = 0 THEN '1,2,3' WHEN c_custkey % 13 = 0 THEN 'a,b,c,d' ELSE concat_ws(',', (c_custkey * 31) % 500, (c_custkey * 17) % 400, (c_custkey * 31) % 500 + c_custkey % 7, (c_custkey * 17) % 400 + 5) END AS box,
  CASE WHEN c_custkey % 11 = 0 THEN '1' ELSE concat_ws(',', (c_custkey * 31) % 500, (c_custkey * 17) % 400) END AS point, concat('out/tile_x', (c_custkey * 31) % 500 - 100, '_y', (c_custkey * 17) % 400, '.png') AS path,
  concat('Flight_UTM', c_custkey % 70, CASE WHEN c_custkey % 2 = 0 THEN 'N' ELSE 's' END, '_rgb.tif') AS image FROM customer"""


def _utm(s: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    e, n = utm(6 + (k % 600) / 100.0, 47 + (k % 700) / 100.0, 32)
    return _read(s, d, "customer").select(k.alias("ord"), F.round(e, 4).alias("easting"), F.round(n, 4).alias("northing"))


def _utm_sql() -> str:
    from ..functions.geodesy import ALPHA, EAST, SCALE, N, _RECTIFYING

    e = 2 * N**0.5 / (1 + N)
    x = " + ".join(f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))
    y = " + ".join(f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(ALPHA, 1))
    return f"""WITH p AS (SELECT c_custkey AS ord, radians(47 + (c_custkey % 700) / 100.0::DOUBLE) AS phi, radians(6 + (c_custkey % 600) / 100.0::DOUBLE - 9) AS lam FROM customer),
t AS (SELECT *, sinh(atanh(sin(phi)) - {e!r} * atanh({e!r} * sin(phi))) AS t FROM p), u AS (SELECT ord, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM t)
SELECT ord, round({EAST} + {SCALE * _RECTIFYING!r} * (eta + {x}), 4) AS easting, round({SCALE * _RECTIFYING!r} * (xi + {y}), 4) AS northing FROM u"""


def _box_cols(s: SparkSession, d: str) -> DataFrame:
    return _boxes(s, d).select("ord", F.col("x1").alias("bx1"), F.col("y1").alias("by1"), F.col("x2").alias("bx2"), F.col("y2").alias("by2"))


_max, _mean, _median = _grid("max"), _grid("mean"), _grid("median")
_SOME = "x0 % 1792 = 0"

#: name -> (query, DuckDB SQL)
ALL: dict[str, tuple[Query, str]] = {
    "weak_labels": (_weak, _WEAK),
    "weak_label_tile_counts": (lambda s, d: _weak(s, d).groupBy("tile_id").agg(F.count("*").alias("trees")), f"SELECT tile_id, count(*) AS trees FROM ({_WEAK}) GROUP BY 1"),
    "group_summary_share": (lambda s, d: _species(s, d), _SPECIES),
    "summary_top_n": (lambda s, d: _species(s, d, 5), _SPECIES + " ORDER BY records DESC, latin_name LIMIT 5"),
    "lookup_default": (
        lambda s, d: D.class_names(_read(s, d, "nation").select((F.col("n_nationkey") - 3).alias("label"), "n_name"), _read(s, d, "region").select(F.col("r_regionkey").alias("label"), F.col("r_name").alias("name"))),
        "SELECT n_nationkey - 3 AS label, n_name, coalesce(r_name, (n_nationkey - 3)::VARCHAR) AS class_name FROM nation LEFT JOIN region ON n_nationkey - 3 = r_regionkey WHERE n_nationkey >= 3",
    ),
    "title_case": (lambda s, d: _read(s, d, "part").select("p_partkey", C.title_case(F.col("p_name")).alias("title")), f"SELECT p_partkey, {_TITLE.format('p_name')} AS title FROM part"),
    "status_dbh_filter": (
        lambda s, d: I.in_range(_read(s, d, "lineitem").where(C.status_is(F.col("l_linestatus"), "o")).select(_order().alias("ord"), C.dbh_cm(F.col("l_quantity"), "mm").alias("dbh_cm")).where("dbh_cm > 0"), 1.0, 4.0),
        "SELECT l_orderkey * 100 + l_linenumber AS ord, l_quantity / 10.0::DOUBLE AS dbh_cm FROM lineitem WHERE lower(trim(l_linestatus)) = 'o' AND l_quantity / 10.0 > 0 AND l_quantity / 10.0 BETWEEN 1 AND 4",
    ),
    "decimal_comma_parse": (
        lambda s, d: _read(s, d, "orders").select("o_orderkey", C.parse_number(F.when(F.col("o_orderkey") % 9 == 0, F.lit("12,5d")).otherwise(F.replace((F.col("o_custkey") / 8).cast("string"), F.lit("."), F.lit(",")))).alias("v")),
        "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey / 8::DOUBLE END AS v FROM orders",
    ),
    "dedup_max_first": (
        lambda s, d: I.deduplicate(_trees(s, d).withColumn("tree_id", F.when(F.col("ord") % 50 == 1, "").otherwise(F.col("tree_id")))).select("ord", "tree_id", "dbh_cm"),
        f"WITH t AS (SELECT * REPLACE (CASE WHEN ord % 50 = 1 THEN '' ELSE tree_id END AS tree_id) FROM ({_TREES})) SELECT ord, tree_id, dbh_cm FROM t QUALIFY tree_id = '' OR row_number() OVER (PARTITION BY tree_id ORDER BY CASE WHEN dbh_cm > 0 THEN dbh_cm ELSE -1 END DESC, ord) = 1",
    ),
    "fallback_chain": (
        lambda s, d: _read(s, d, "orders").select("o_orderkey", C.first_present(F.when(F.col("o_orderkey") % 3 == 0, F.lit("  ")).otherwise(F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 6 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")), F.concat(F.lit("shp_"), F.col("o_orderkey"))).alias("v")),
        "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 <> 0 THEN trim(o_orderstatus) END, CASE WHEN o_orderkey % 6 <> 0 THEN trim(o_orderpriority) END, 'shp_' || o_orderkey) AS v FROM orders",
    ),
    "crown_radius_linear": (lambda s, d: _trees(s, d).select("ord", CROWN.radius(F.col("dbh_cm") - 3).alias("radius")), f"SELECT ord, {_linear('(dbh_cm - 3)')} AS radius FROM ({_TREES})"),
    "crown_radius_power": (
        lambda s, d: _trees(s, d).select("ord", F.round(POWER.radius(F.col("dbh_cm")), 6).alias("radius")),
        f"SELECT ord, round(greatest(least(0.15::DOUBLE * pow(dbh_cm, 0.8), 15), 0.5), 6) AS radius FROM ({_TREES})",
    ),
    "tile_grid": (lambda s, d: GRID.frame(s), _tiles_sql(GRID)),
    "points_in_tiles": (
        lambda s, d: T.points_in_tiles(_trees(s, d).select("ord", "x", "y"), GRID).select("ord", "tile_id", "x_local", "y_local"),
        f"SELECT ord, tile_id, x - x0 AS x_local, y - y0 AS y_local FROM ({_TREES}) p JOIN ({_tiles_sql(GRID)}) t ON x >= x0 AND x < x1 AND y >= y0 AND y < y1",
    ),
    "boxes_in_tiles": (
        lambda s, d: T.boxes_in_tiles(_box_cols(s, d), GRID).select("ord", "tile_id", "lx1", "ly1", "lx2", "ly2"),
        f"SELECT ord, tile_id, greatest(b.x1, t.x0) - x0 AS lx1, greatest(b.y1, y0) - y0 AS ly1, least(b.x2, t.x1) - x0 AS lx2, least(b.y2, t.y1) - y0 AS ly2 FROM ({_BOXES}) b JOIN ({_tiles_sql(GRID)}) t ON b.x1 < t.x1 AND b.x2 > x0 AND b.y1 < t.y1 AND b.y2 > y0",
    ),
    "coverage_semi": (
        lambda s, d: _trees(s, d).join(T.points_in_tiles(_trees(s, d).select("ord", "x", "y"), GRID).where(_SOME).select("ord", "x", "y").distinct().withColumn("hit", F.lit(True)), ["ord", "x", "y"], "left").select("ord", F.coalesce("hit", F.lit(False)).alias("covered")),
        f"SELECT ord, EXISTS (SELECT 1 FROM ({_tiles_sql(GRID)}) t WHERE {_SOME} AND x >= x0 AND x < x1 AND y >= y0 AND y < y1) AS covered FROM ({_TREES}) p",
    ),
    "cached_anti": (
        lambda s, d: (lambda g: g.join(g.where(_SOME).select("x0", "y0"), ["x0", "y0"], "left_anti").select("tile_id", "x0", "y0"))(GRID.frame(s)),
        f"SELECT tile_id, x0, y0 FROM ({_tiles_sql(GRID)}) WHERE NOT ({_SOME})",
    ),
    "tile_weak_left": (
        lambda s, d: GRID.frame(s).join(_weak(s, d).where("tile_id NOT LIKE '%_x896_%'").groupBy("tile_id").agg(F.count("*").alias("n"), F.max("bbox_x2").alias("edge")), "tile_id", "left").select("tile_id", F.coalesce("n", F.lit(0)).alias("n"), "edge"),
        f"WITH w AS (SELECT tile_id, count(*) AS n, max(bbox_x2) AS edge FROM ({_WEAK}) WHERE tile_id NOT LIKE '%_x896_%' GROUP BY 1) SELECT tile_id, coalesce(n, 0) AS n, edge FROM ({_tiles_sql(GRID)}) LEFT JOIN w USING (tile_id)",
    ),
    "grid_max": _max,
    "grid_mean": _mean,
    "grid_median": _median,
    "grid_extent": (lambda s, d: R.extent(_points(s, d)), f"SELECT count(*) AS num_points, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM (SELECT x, round(y, 0) AS y, z FROM ({_POINTS}))"),
    "gray_u8": (
        lambda s, d: _read(s, d, "part").select("p_partkey", C.gray(F.col("p_partkey") % 997 * 1.0, F.lit(100.0), F.lit(612.0)).alias("gray")),
        "SELECT p_partkey, (((trunc((p_partkey % 997 - 100) / 512.0::DOUBLE * 255)::INT % 256) + 256) % 256)::INT AS gray FROM part",
    ),
    "minmax_u8": (
        lambda s, d: R.bytes_by_range(_read(s, d, "part").select("p_partkey", (F.col("p_partkey") % 997).cast("double").alias("v")), "v").select("p_partkey", "u8"),
        "WITH v AS (SELECT p_partkey, (p_partkey % 997)::DOUBLE AS v FROM part) SELECT p_partkey, trunc((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) * 255.0)::INT AS u8 FROM v",
    ),
    "parse_bbox": (
        lambda s, d: _texts(s, d).select("ord", C.bbox_prompt(F.col("box")).alias("p")).select("ord", "p.box.x1", "p.box.y1", "p.box.x2", "p.box.y2", "p.error"),
        f"""WITH t AS (SELECT ord, string_split(box, ',') AS b FROM ({_TEXTS})), v AS (SELECT ord, len(b) AS n, list_transform(b, lambda z: TRY_CAST(z AS DOUBLE)) AS v FROM t),
e AS (SELECT *, CASE WHEN n <> 4 THEN 'count' WHEN len(list_filter(v, lambda z: z IS NULL)) > 0 THEN 'number' WHEN v[3] <= v[1] OR v[4] <= v[2] THEN 'order' END AS error FROM v)
SELECT ord, CASE WHEN error IS NULL THEN v[1] END AS x1, CASE WHEN error IS NULL THEN v[2] END AS y1, CASE WHEN error IS NULL THEN v[3] END AS x2, CASE WHEN error IS NULL THEN v[4] END AS y2, error FROM e""",
    ),
    "parse_point": (
        lambda s, d: _texts(s, d).select("ord", C.point_prompt(F.col("point")).alias("p")).select("ord", "p.point.x", "p.point.y", "p.error"),
        f"SELECT ord, CASE WHEN contains(point, ',') THEN split_part(point, ',', 1)::DOUBLE END AS x, CASE WHEN contains(point, ',') THEN split_part(point, ',', 2)::DOUBLE END AS y, CASE WHEN NOT contains(point, ',') THEN 'count' END AS error FROM ({_TEXTS})",
    ),
    "parse_tile_origin": (
        lambda s, d: _texts(s, d).select("ord", C.tile_origin(F.col("path")).alias("o")).select("ord", "o.x", "o.y", C.tile_id(F.col("o.x"), F.col("o.y")).alias("tile_id")),
        rf"WITH t AS (SELECT ord, regexp_extract(path, 'x(-?\d+)_y', 1)::BIGINT AS x, regexp_extract(path, '_y(-?\d+)', 1)::BIGINT AS y FROM ({_TEXTS})) SELECT ord, x, y, concat('tile_x', x, '_y', y) AS tile_id FROM t",
    ),
    "utm_from_name": (
        lambda s, d: _texts(s, d).select("ord", C.utm_zone(F.col("image")).alias("z")).select("ord", "z.zone", "z.north"),
        f"WITH t AS (SELECT ord, regexp_extract(lower(image), 'utm([0-9]+)([ns])', 1)::INT AS zone, regexp_extract(lower(image), 'utm([0-9]+)([ns])', 2) = 'n' AS north FROM ({_TEXTS})) SELECT ord, CASE WHEN zone BETWEEN 1 AND 60 THEN zone END AS zone, CASE WHEN zone BETWEEN 1 AND 60 THEN north END AS north FROM t",
    ),
    "point_to_box": (
        lambda s, d: _trees(s, d).select("ord", *[c.alias(n) for c, n in zip(C.point_box(F.col("x"), F.col("y"), 5000, 4000), ("x1", "y1", "x2", "y2"), strict=True)]),
        f"SELECT ord, greatest(0::DOUBLE, x - 8) AS x1, greatest(0::DOUBLE, y - 8) AS y1, least(5000::DOUBLE, x + 8) AS x2, least(4000::DOUBLE, y + 8) AS y2 FROM ({_TREES})",
    ),
    "local_to_global": (
        lambda s, d: _boxes(s, d).select("ord", *[c.alias(n) for c, n in zip(C.global_box(*[F.col(n) for n in ("x1", "y1", "x2", "y2")], F.lit(64.0), F.lit(-32.0), 4950, 3900), ("gx1", "gy1", "gx2", "gy2"), strict=True)]).where("gx2 > gx1 AND gy2 > gy1"),
        f"SELECT * FROM (SELECT ord, least(greatest(x1 + 64, 0), 4950)::DOUBLE AS gx1, least(greatest(y1 - 32, 0), 3900)::DOUBLE AS gy1, least(greatest(x2 + 64, 0), 4950)::DOUBLE AS gx2, least(greatest(y2 - 32, 0), 3900)::DOUBLE AS gy2 FROM ({_BOXES})) WHERE gx2 > gx1 AND gy2 > gy1",
    ),
    "conf_filter_fallback": (
        lambda s, d: D.confident(_events(s, d), "tile", "conf", 150.0).select("ord", "tile", "conf"),
        "SELECT event_id AS ord, user_id AS tile, value AS conf FROM events QUALIFY value >= 150 OR (max(value) OVER (PARTITION BY user_id) < 150 AND row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1)",
    ),
    "argmax_per_group": (
        lambda s, d: D.argmax_by(_events(s, d), "event_type", "conf").select("event_type", "ord", "conf"),
        "SELECT event_type, event_id AS ord, value AS conf FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) = 1",
    ),
    "detections_per_tile": (
        lambda s, d: D.per_tile(GRID.frame(s), T.boxes_in_tiles(_box_cols(s, d).where("ord % 6 = 0"), GRID).where("x0 < 4000")).select("tile_id", "x0", "y0", "count"),
        f"WITH n AS (SELECT tile_id, count(*) AS n FROM ({_BOXES}) b JOIN ({_tiles_sql(GRID)}) t ON b.x1 < t.x1 AND b.x2 > x0 AND b.y1 < t.y1 AND b.y2 > y0 WHERE ord % 6 = 0 AND x0 < 4000 GROUP BY 1) SELECT tile_id, x0, y0, coalesce(n, 0) AS count FROM ({_tiles_sql(GRID)}) LEFT JOIN n USING (tile_id)",
    ),
    "confidence_summary": (
        lambda s, d: D.confidence_summary(_events(s, d), "conf").select("n", F.round("least", 6).alias("least"), F.round("mean", 6).alias("mean"), F.round("greatest", 6).alias("greatest")),
        "SELECT count(value) AS n, round(min(value), 6) AS least, round(avg(value), 6) AS mean, round(max(value), 6) AS greatest FROM events",
    ),
    "iou_pairs": (lambda s, d: D.overlaps(D.ranked(_boxes(s, d), F.desc("score"), F.asc("ord")), 0.3, 64.0), _IOU.format(_RANKED) + " SELECT hi, lo, iou FROM e"),
    "nms_merge": (
        lambda s, d: D.suppress(_boxes(s, d), 0.3).select("ord", "rank", "score"),
        _IOU.format(_RANKED).replace("WITH r", "WITH RECURSIVE r", 1)
        + """, h AS (SELECT lo, list(hi) AS his, row_number() OVER (ORDER BY lo) AS n FROM e GROUP BY lo),
k(n, gone) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT h.n, CASE WHEN len(list_filter(h.his, lambda z: NOT list_contains(k.gone, z))) > 0 THEN list_append(k.gone, h.lo) ELSE k.gone END FROM k JOIN h ON h.n = k.n + 1)
SELECT ord, rank, score FROM r WHERE NOT list_contains((SELECT gone FROM k ORDER BY n DESC LIMIT 1), rank)""",
    ),
    "greedy_match": (lambda s, d: D.match(_edges(s, d)), _MATCH + " SELECT * FROM m"),
    "match_summary": (
        _match_summary,
        _MATCH.replace("GROUP BY 1, 2)", "GROUP BY 1, 2 HAVING tree_index % 7 <> 0)", 1)
        + f", t AS (SELECT count(*) AS total, count(*) FILTER (i % 7 <> 0) AS covered FROM range(500) x(i)), n AS (SELECT count(*) AS matched FROM m), l AS (SELECT count(DISTINCT label_id) AS labels FROM ({_EDGES}))"
        + " SELECT total, covered, total - covered AS uncovered, matched, total - matched AS unmatched, greatest(labels - matched, 0) AS unmatched_labels, matched * 100.0::DOUBLE / total AS match_rate, matched AS tp, greatest(labels - matched, 0) AS fp, total - matched AS fn FROM t, n, l",
    ),
    "blend_weighted": (_blend, _BLEND),
    "narrowest_interval": (lambda s, d: D.narrowest(*_spans_of_nations(s, d), 256), _NARROW),
    "utm_forward": (_utm, _utm_sql()),
}

ALL |= FILES

QUERIES: dict[str, Query] = {k: v[0] for k, v in ALL.items()}
ORACLES: dict[str, str] = {k: v[1] for k, v in ALL.items()}
