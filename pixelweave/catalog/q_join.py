"""Alignment, resampling, mosaics, neighbours and set operations."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..functions import geo
from ..operators import align as al, merge as mg, resample as rs, stencil as st
from . import fixtures as fx
from .registry import query, r6

_KEY = ["scene_id", "y", "x"]


@query("align_labels", fx.with_(fx.PX) + "SELECT scene_id, y, x, b1, CAST(b2 AS INT) % 2 AS label FROM px")
def _(spark, sf):
    return al.align_labels(fx.pixels(spark, sf).drop("b2"), fx.label_map(spark, sf))


def _images(spark, sf):
    """One image per scene, placed over the whole label raster."""
    s = fx.scenes(spark, sf).select("scene_id", F.lit(20).alias("height"), F.lit(40).alias("width"))
    return s.withColumn("transform", geo.affine(0.2, 0.0, F.lit(500000.0) + 2.0 + F.col("scene_id") * 1.2, 0.0, -0.2,
                                                F.lit(5900000.0) - 6.0 * F.col("scene_id") - 0.4))


def _label_scene(spark, sf):
    return fx.scenes(spark, sf, multi=False).select("epsg", "transform")


@query("crop_to_bounds", fx.with_(fx.PX1, """im AS (SELECT DISTINCT CAST((o_orderkey // 100) // 30 AS BIGINT) AS scene_id FROM orders),
b AS (SELECT scene_id, CAST(10 + 6 * scene_id AS INT) AS c0, CAST(30 * scene_id + 2 AS INT) AS r0 FROM im)""") + """SELECT b.scene_id, y - r0 AS y, x - c0 AS x, CAST(b2 AS INT) % 2 AS label
  FROM b JOIN px ON y >= r0 AND y < r0 + 20 AND x >= c0 AND x < c0 + 40""")
def _(spark, sf):
    return al.crop_to_bounds(fx.label_map(spark, sf, multi=False).drop("scene_id"), _label_scene(spark, sf), _images(spark, sf))


@query("reproject_nearest", fx.with_(fx.PX1, """im AS (SELECT DISTINCT CAST((o_orderkey // 100) // 30 AS BIGINT) AS scene_id FROM orders),
g AS (SELECT scene_id, y, unnest(range(0, 40)) AS x FROM (SELECT scene_id, unnest(range(0, 20)) AS y FROM im)),
c AS (SELECT scene_id, y, x, CAST(floor(((2.0 + scene_id * 1.2) + 0.2 * (x + 0.5)) / 0.2 + 1e-6) AS INT) AS sx,
  CAST(floor(((6.0 * scene_id + 0.4) + 0.2 * (y + 0.5)) / 0.2 + 1e-6) AS INT) AS sy FROM g)""") + """SELECT c.scene_id, CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x,
  coalesce(CAST(b2 AS INT) % 2, 0) AS label FROM c LEFT JOIN px ON px.y = sy AND px.x = sx""")
def _(spark, sf):
    return rs.reproject_nearest(fx.label_map(spark, sf, multi=False).drop("scene_id"), _label_scene(spark, sf),
                                _images(spark, sf).withColumn("epsg", F.lit(25832)))


def _forward_sql(src: str, middle: int) -> str:
    """Add ce, cn: the projected place of lat, lon about a central meridian."""
    r, ecc = fv.UTM_K0 * geo._R, geo._ECC
    east = "eta" + "".join(f" + ({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(geo._FORWARD, 1))
    north = "xi" + "".join(f" + ({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(geo._FORWARD, 1))
    return f"""{src}_s AS (SELECT *, sin(radians(lat)) AS s FROM {src}),
{src}_t AS (SELECT *, sinh(atanh(s) - {ecc!r} * atanh({ecc!r} * s)) AS t, radians(lon - {middle}.0) AS d FROM {src}_s),
{src}_u AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM {src}_t),
{src}_f AS MATERIALIZED (SELECT * EXCLUDE (s, t, d, xi, eta), 500000.0 + {r!r} * ({east}) AS ce, {r!r} * ({north}) AS cn FROM {src}_u)"""


def _inverse_sql(src: str, middle: int, out: str, steps: int = 14) -> str:
    """Add lat, lon of te, tn: the forward projection, corrected until it meets the place."""
    parts = [f"""{out}0 AS (SELECT *, tn / 111000.0 AS lat, {middle}.0 + (te - 500000.0) / (111000.0 * cos(radians(tn / 111000.0))) AS lon FROM {src})"""]
    for k in range(steps):
        parts += [_forward_sql(f"{out}{k}", middle), f"""{out}{k + 1} AS (SELECT * EXCLUDE (ce, cn) REPLACE (
  lat + degrees((tn - cn) / 6380000.0) AS lat, lon + degrees((te - ce) / (6380000.0 * cos(radians(lat)))) AS lon) FROM {out}{k}_f)"""]
    return ", ".join(parts) + f", {out} AS (SELECT * FROM {out}{steps})"


@query("reproject_nearest_across_zones", fx.with_(fx.PX1, """im AS (SELECT DISTINCT CAST((o_orderkey // 100) // 30 AS BIGINT) AS scene_id FROM orders),
o AS (SELECT scene_id, 500002.0 AS te, 5899996.0 - 6.0 * scene_id AS tn FROM im)""", _inverse_sql("o", 9, "oi"), _forward_sql("oi", 3),
    """g AS (SELECT scene_id, y, unnest(range(0, 40)) AS x, ce, cn FROM (SELECT *, unnest(range(0, 20)) AS y FROM oi_f)),
gt AS (SELECT scene_id, y, x, ce + 0.2 * (x + 0.5) AS te, cn - 0.2 * (y + 0.5) AS tn FROM g)""", _inverse_sql("gt", 3, "gi"), _forward_sql("gi", 9),
    "c AS (SELECT scene_id, CAST(floor((ce - 500000.0) / 0.2) AS INT) AS sx, CAST(floor((5900000.0 - cn) / 0.2) AS INT) AS sy FROM gi_f)") +
       """SELECT c.scene_id, coalesce(CAST(b2 AS INT) % 2, -1) AS label, count(*) AS n FROM c LEFT JOIN px ON px.y = sy AND px.x = sx GROUP BY ALL""")
def _(spark, sf):
    """Targets in the neighbouring zone: each image is laid out around the
    place its label pixels have there. The SQL inverts the projection by
    correcting a guess with the forward series."""
    s = fx.scenes(spark, sf).select(
        "scene_id", F.lit(20).alias("height"), F.lit(40).alias("width"), F.lit(500002.0).alias("e0"),
        (F.lit(5899996.0) - 6.0 * F.col("scene_id")).alias("n0"), F.lit(25832).alias("epsg0"), F.lit(32631).alias("epsg"))
    s = geo.add_utm(geo.add_latlon(s, "e0", "n0", "epsg0", "lat", "lon"), "lat", "lon", "epsg", "e", "n")
    targets = s.select("scene_id", "height", "width", "epsg",
                       geo.affine(0.2, 0.0, F.col("e"), 0.0, -0.2, F.col("n")).alias("transform"))
    got = rs.reproject_nearest(fx.label_map(spark, sf, multi=False).drop("scene_id"), _label_scene(spark, sf), targets, fill=-1)
    return got.groupBy("scene_id", "label").agg(F.count("*").alias("n"))


def _sizes(spark, sf, h: int, w: int):
    return fx.scenes(spark, sf).select("scene_id", F.col("height").alias("src_h"), F.col("width").alias("src_w"),
                                       F.lit(h).alias("dst_h"), F.lit(w).alias("dst_w"))


_DST = """d AS (SELECT scene_id, height AS sh, width AS sw, y, unnest(range(0, {w})) AS x FROM (SELECT *, unnest(range(0, {h})) AS y FROM scenes))"""


@query("resize_nearest", fx.with_(fx.PX, fx.SCENES, _DST.format(h=47, w=61)) + """SELECT d.scene_id, CAST(d.y AS INT) AS y, CAST(d.x AS INT) AS x, b2
  FROM d JOIN px ON px.scene_id = d.scene_id AND px.y = (d.y * sh) // 47 AND px.x = (d.x * sw) // 61""")
def _(spark, sf):
    return rs.resize_nearest(fx.pixels(spark, sf).drop("b1"), _sizes(spark, sf, 47, 61))


_BIL = """p AS (SELECT *, greatest(0.0, least((y + 0.5) * sh / {h} - 0.5, sh - 1.0)) AS sy, greatest(0.0, least((x + 0.5) * sw / {w} - 0.5, sw - 1.0)) AS sx FROM d),
k AS (SELECT *, CAST(floor(sy) AS INT) AS y0, CAST(floor(sx) AS INT) AS x0, sy - floor(sy) AS ty, sx - floor(sx) AS tx FROM p)"""


@query("resize_bilinear", fx.with_(fx.PX, fx.SCENES, _DST.format(h=47, w=61), _BIL.format(h=47, w=61)) + """SELECT k.scene_id, CAST(k.y AS INT) AS y, CAST(k.x AS INT) AS x,
  round((1 - ty) * (1 - tx) * a.b2 + (1 - ty) * tx * b.b2 + ty * (1 - tx) * c.b2 + ty * tx * e.b2, 6) AS b2 FROM k
  JOIN px a ON a.scene_id = k.scene_id AND a.y = y0 AND a.x = x0 JOIN px b ON b.scene_id = k.scene_id AND b.y = y0 AND b.x = least(x0 + 1, sw - 1)
  JOIN px c ON c.scene_id = k.scene_id AND c.y = least(y0 + 1, sh - 1) AND c.x = x0
  JOIN px e ON e.scene_id = k.scene_id AND e.y = least(y0 + 1, sh - 1) AND e.x = least(x0 + 1, sw - 1)""")
def _(spark, sf):
    return rs.resize_bilinear(fx.pixels(spark, sf), _sizes(spark, sf, 47, 61), ["b2"]).select(*_KEY, r6("b2"))


_GAPS = fx.PX.replace("CAST(o_custkey AS DOUBLE) AS b2", "CASE WHEN o_custkey % 29 <> 0 THEN CAST(o_custkey AS DOUBLE) END AS b2")
_TERMS = (("(1 - ty) * (1 - tx)", "a"), ("(1 - ty) * tx", "b"), ("ty * (1 - tx)", "c"), ("ty * tx", "e"))


def _gaps(spark, sf):
    """Pixels without a value every so often."""
    return fx.pixels(spark, sf).withColumn("b2", F.when(F.col("b2") % 29 != 0, F.col("b2")))


@query("resize_bilinear_nodata", fx.with_(_GAPS, fx.SCENES, _DST.format(h=47, w=61), _BIL.format(h=47, w=61)) + f"""SELECT k.scene_id, CAST(k.y AS INT) AS y, CAST(k.x AS INT) AS x,
  round({" + ".join(f"CASE WHEN {w} = 0 THEN 0 ELSE {w} * {t}.b2 END" for w, t in _TERMS)}, 6) AS b2 FROM k
  JOIN px a ON a.scene_id = k.scene_id AND a.y = y0 AND a.x = x0 JOIN px b ON b.scene_id = k.scene_id AND b.y = y0 AND b.x = least(x0 + 1, sw - 1)
  JOIN px c ON c.scene_id = k.scene_id AND c.y = least(y0 + 1, sh - 1) AND c.x = x0
  JOIN px e ON e.scene_id = k.scene_id AND e.y = least(y0 + 1, sh - 1) AND e.x = least(x0 + 1, sw - 1)""")
def _(spark, sf):
    return rs.resize_bilinear(_gaps(spark, sf), _sizes(spark, sf, 47, 61), ["b2"]).select(*_KEY, r6("b2"))


_CUB = """CASE WHEN abs({t} - {k}) <= 1 THEN (1.25 * abs({t} - {k}) - 2.25) * abs({t} - {k}) * abs({t} - {k}) + 1
  WHEN abs({t} - {k}) < 2 THEN ((-0.75 * abs({t} - {k}) + 3.75) * abs({t} - {k}) - 6.0) * abs({t} - {k}) + 3.0 ELSE 0 END"""


@query("resize_bicubic", fx.with_(fx.PX, fx.SCENES, _DST.format(h=47, w=61), f"""p AS (SELECT *, (y + 0.5) * sh / 47 - 0.5 AS sy, (x + 0.5) * sw / 61 - 0.5 AS sx FROM d),
q AS (SELECT *, CAST(floor(sy) AS INT) AS iy, CAST(floor(sx) AS INT) AS ix, sy - floor(sy) AS ty, sx - floor(sx) AS tx FROM p),
ky AS (SELECT *, unnest([-1, 0, 1, 2]) AS a FROM q), kx AS (SELECT *, unnest([-1, 0, 1, 2]) AS b FROM ky),
w AS (SELECT scene_id, y, x, greatest(0, least(iy + a, sh - 1)) AS yy, greatest(0, least(ix + b, sw - 1)) AS xx,
  ({_CUB.format(t='ty', k='a')}) * ({_CUB.format(t='tx', k='b')}) AS w FROM kx)""") + """SELECT w.scene_id, CAST(w.y AS INT) AS y, CAST(w.x AS INT) AS x, round(sum(w * b2), 6) AS b2
  FROM w JOIN px ON px.scene_id = w.scene_id AND px.y = yy AND px.x = xx GROUP BY ALL""")
def _(spark, sf):
    return rs.resize_bicubic(fx.pixels(spark, sf), _sizes(spark, sf, 47, 61), ["b2"]).select(*_KEY, r6("b2"))


@query("resize_bicubic_nodata", fx.with_(_GAPS, fx.SCENES, _DST.format(h=47, w=61), f"""p AS (SELECT *, (y + 0.5) * sh / 47 - 0.5 AS sy, (x + 0.5) * sw / 61 - 0.5 AS sx FROM d),
q AS (SELECT *, CAST(floor(sy) AS INT) AS iy, CAST(floor(sx) AS INT) AS ix, sy - floor(sy) AS ty, sx - floor(sx) AS tx FROM p),
ky AS (SELECT *, unnest([-1, 0, 1, 2]) AS a FROM q), kx AS (SELECT *, unnest([-1, 0, 1, 2]) AS b FROM ky),
w AS (SELECT scene_id, y, x, greatest(0, least(iy + a, sh - 1)) AS yy, greatest(0, least(ix + b, sw - 1)) AS xx,
  ({_CUB.format(t='ty', k='a')}) * ({_CUB.format(t='tx', k='b')}) AS w FROM kx)""") + """SELECT w.scene_id, CAST(w.y AS INT) AS y, CAST(w.x AS INT) AS x, CASE WHEN count(b2) = count(*) THEN round(sum(w * b2), 6) END AS b2
  FROM w JOIN px ON px.scene_id = w.scene_id AND px.y = yy AND px.x = xx GROUP BY ALL""")
def _(spark, sf):
    return rs.resize_bicubic(_gaps(spark, sf), _sizes(spark, sf, 47, 61), ["b2"]).select(*_KEY, r6("b2"))


@query("upsample_repeat", fx.with_(fx.PX) + """SELECT scene_id, CAST(y * 3 + dy AS INT) AS y, CAST(x * 3 + dx AS INT) AS x, b2
  FROM px, (SELECT unnest([0, 1, 2]) AS dy) a, (SELECT unnest([0, 1, 2]) AS dx) b""")
def _(spark, sf):
    return rs.upsample_repeat(fx.pixels(spark, sf).drop("b1"), 3)


@query("neighbors", fx.with_(fx.PX, fx.SPARSE, """o AS (SELECT dy, unnest([-1, 0, 1]) AS dx FROM (SELECT unnest([-1, 0, 1]) AS dy))""") +
       """SELECT m.scene_id, m.y, m.x, dy, dx FROM m JOIN o ON NOT (dy = 0 AND dx = 0) JOIN m n ON n.scene_id = m.scene_id AND n.y = m.y + dy AND n.x = m.x + dx""")
def _(spark, sf):
    return st.neighbors(fx.sparse_mask(spark, sf), st.RING)


@query("mosaic", fx.with_(fx.CHIPS) + "SELECT y, x, max_by(value, CASE WHEN value IS NOT NULL THEN source_order END) AS value FROM chips GROUP BY y, x")
def _(spark, sf):
    return mg.mosaic(fx.chips(spark, sf), "value", "source_order")


@query("mosaic_nodata_value", fx.with_(fx.CHIPS) + """SELECT y, x, coalesce(max_by(value, CASE WHEN value IS NOT NULL AND value <> 7 THEN source_order END), 7.0) AS value
  FROM chips GROUP BY y, x""")
def _(spark, sf):
    return mg.mosaic(fx.chips(spark, sf), "value", "source_order", nodata=7.0)


def _placed_sql(method: str) -> str:
    """Weights per axis are worked out from the target side: j takes i with weight w."""
    def axis(name: str, sources: str, targets: str, shift: str) -> str:
        low, high, centre = f"(2 * j - {shift})", f"(2 * j + 2 - {shift})", f"(2 * j + 1 - {shift})"      # in source pixels
        w = {"nearest": f"CASE WHEN i = floor({centre}) THEN 1.0 ELSE 0.0 END",
             "average": f"(least({high}, i + 1.0) - greatest({low}, CAST(i AS DOUBLE))) / 2",
             "bilinear": f"1 - abs({centre} - 0.5 - i)"}[method]
        return (f"{name} AS MATERIALIZED (SELECT k, i, j, w FROM (SELECT k, i, CAST(j AS INT) AS j, {w} AS w FROM range(1, 8) a(k), range({sources}) b(i), range({targets}) c(j) "
                f"WHERE i BETWEEN {low} - 2 AND {high} + 2) WHERE w > 1e-9)")

    rows = "(SELECT max(y) + 1 FROM chips)"
    return fx.with_(fx.CHIPS, axis("wx", "100", "50", "0.3565 * k"), axis("wy", rows, f"{rows} // 2", "0.1585 * k"),
                    "pl AS (SELECT c.source_order, wy.j AS y, wx.j AS x, sum(wy.w * wx.w * value) / sum(wy.w * wx.w) AS value FROM chips c JOIN wy ON wy.k = source_order AND wy.i = c.y "
                    "JOIN wx ON wx.k = source_order AND wx.i = c.x WHERE value IS NOT NULL GROUP BY ALL)") + \
        "SELECT y, x, round(max_by(value, source_order), 5) AS value FROM pl GROUP BY y, x"


def _mosaic_placed(spark, sf, method):
    """Seven chips with origins of their own, on a grid of twice their pixel size."""
    px = fx.chips(spark, sf).withColumnRenamed("source_order", "chip")
    n, rows = F.col("chip"), px.agg((F.floor((F.max("y") + 1) / 2)).cast("int").alias("height"))
    chips = px.select("chip").distinct().select("chip", n.alias("source_order"), geo.affine(
        0.2, 0.0, n * 0.0713, 0.0, -0.2, n * -0.0317).alias("transform"))
    grid = rows.select("height", F.lit(50).alias("width"), geo.affine(0.4, 0.0, 0.0, 0.0, -0.4, 0.0).alias("transform"))
    return mg.mosaic_placed(px, chips, grid, "value", method).select("y", "x", r6("value", digits=5))


for _method in ("nearest", "average", "bilinear"):
    query(f"mosaic_placed_{_method}", _placed_sql(_method))(lambda spark, sf, m=_method: _mosaic_placed(spark, sf, m))


@query("paint_labels", fx.with_(fx.MASKS, fx.MASK_PIXELS, """p AS (SELECT mpx.*, patch_idx, area FROM mpx JOIN masks USING (mask_id)),
w AS (SELECT y, x, mask_id, patch_idx, area, row_number() OVER (PARTITION BY y, x ORDER BY patch_idx, area, mask_id) AS r FROM p),
ids AS (SELECT mask_id, row_number() OVER (ORDER BY patch_idx, area, mask_id) AS label FROM (SELECT DISTINCT mask_id, patch_idx, area FROM w WHERE r = 1))""") +
       "SELECT CAST(0 AS BIGINT) AS scene_id, y, x, CAST(label AS INT) AS label, w.mask_id FROM w JOIN ids USING (mask_id) WHERE r = 1")
def _(spark, sf):
    return mg.paint_labels(fx.masks(spark, sf), fx.mask_pixels(spark, sf))


_SECOND = "m2 AS (SELECT scene_id, y, x FROM px WHERE b2 < 600)"


def _second(spark, sf):
    return fx.pixels(spark, sf).where(F.col("b2") < 600).select(*_KEY)


@query("mask_union", fx.with_(fx.PX, fx.SPARSE, _SECOND) + "SELECT * FROM m UNION SELECT * FROM m2")
def _(spark, sf):
    return mg.mask_union(fx.sparse_mask(spark, sf), _second(spark, sf))


@query("mask_difference", fx.with_(fx.PX, fx.SPARSE, _SECOND) + "SELECT * FROM m EXCEPT SELECT * FROM m2")
def _(spark, sf):
    return mg.mask_difference(fx.sparse_mask(spark, sf), _second(spark, sf))


@query("mask_intersection", fx.with_(fx.PX, fx.SPARSE, _SECOND) + "SELECT * FROM m INTERSECT SELECT * FROM m2")
def _(spark, sf):
    return mg.mask_intersection(fx.sparse_mask(spark, sf), _second(spark, sf))


@query("merge_or", fx.with_(fx.MASK_PIXELS) + "SELECT DISTINCT CAST(0 AS BIGINT) AS scene_id, y, x FROM mpx")
def _(spark, sf):
    return mg.merge_or(fx.mask_pixels(spark, sf).withColumn("scene_id", F.lit(0).cast("bigint")))


@query("stack_features", fx.with_(fx.EMB) + """SELECT 'tokens' AS source, vec_id AS id, round(list_sum(feature), 6) AS total FROM emb
  UNION ALL SELECT 'pixels', o_orderkey, round(o_totalprice + o_custkey, 6) FROM orders""")
def _(spark, sf):
    e = fx.embeddings(spark, sf).select(F.col("vec_id").alias("id"), "feature")
    o = fx.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.array("o_totalprice", F.col("o_custkey").cast("double")).alias("feature"))
    both = mg.stack_features({"tokens": e, "pixels": o}, ["id", "feature"])
    return both.select("source", "id", r6(F.aggregate("feature", F.lit(0.0), lambda a, v: a + v), "total"))


@query("block_shift", fx.with_(fx.PX1, """o AS (SELECT dy, unnest(range(-3, 4)) AS dx FROM (SELECT unnest(range(-3, 4)) AS dy)),
c AS (SELECT CAST(r.y // 50 AS INT) AS block_y, CAST(r.x // 50 AS INT) AS block_x, dx, dy, corr(r.b1, t.b1) AS c, count(*) AS n FROM px r JOIN o ON true
  JOIN px t ON t.y + 2 = r.y + dy AND t.x - 1 = r.x + dx GROUP BY ALL)""") + """SELECT CAST(0 AS BIGINT) AS scene_id, block_y, block_x, CAST(dx AS INT) AS dx, CAST(dy AS INT) AS dy, round(c, 6) AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY block_y, block_x ORDER BY round(c, 9) DESC, dx * dx + dy * dy, dy, dx) AS r FROM c WHERE n >= 3 AND c IS NOT NULL) WHERE r = 1""")
def _(spark, sf):
    """The scene against itself moved by (-1, 2)."""
    px = fx.pixels(spark, sf, multi=False)
    return al.block_shift(px, al.shift_scene(px, -1, 2), "b1", block=50, max_shift=3).withColumn("score", r6("score"))


@query("shift_summary", """SELECT round(avg(value), 6) AS mean_dx, round(avg(user_id), 6) AS mean_dy, count(*) AS points FROM events""")
def _(spark, sf):
    from ..operators.masks import shift_summary

    pts = fx.table(spark, sf, "events").select(F.col("value").alias("dx"), F.col("user_id").alias("dy"))
    return shift_summary(pts).select(r6("mean_dx"), r6("mean_dy"), "points")
