"""Scaling, indices and scalar functions."""

from pyspark.sql import functions as F

from ..functions import geo, scalar as sc, vectors as vec
from ..operators import pixels as po
from ..session import cut_lineage
from . import fixtures as fx
from .registry import query, r6

_B3 = ["b1", "b2", "b3"]
_KEY = ["scene_id", "y", "x"]


def _stretch(b: str) -> str:
    return (f"CASE WHEN {b} IS NULL THEN NULL WHEN {b}h <= {b}l THEN greatest(0.0, least(1.0, {b} / CASE WHEN {b}m = 0 THEN 1.0 ELSE {b}m END)) "
            f"ELSE greatest(0.0, least(1.0, ({b} - {b}l) / ({b}h - {b}l))) END")


_STATS3 = "st AS (SELECT scene_id, " + ", ".join(
    f"quantile_cont({b}, 0.02) AS {b}l, quantile_cont({b}, 0.98) AS {b}h, max({b}) AS {b}m" for b in _B3) + " FROM px GROUP BY scene_id)"
_STRETCHED = "s3 AS (SELECT px.scene_id, y, x, " + ", ".join(f"{_stretch(b)} AS {b}" for b in _B3) + " FROM px JOIN st USING (scene_id))"


def _stretched(spark, sf):
    return po.stretch_2_98(fx.pixels(spark, sf, lines=True).select(*_KEY, *_B3), _B3)


@query("normalize_robust", fx.with_(fx.PX8, """st AS (SELECT scene_id, quantile_cont(b1, 0.01) AS l1, quantile_cont(b1, 0.99) AS h1,
  quantile_cont(b3, 0.01) AS l3, quantile_cont(b3, 0.99) AS h3 FROM px GROUP BY scene_id)""") + """SELECT px.scene_id, y, x,
  round(greatest(0.0, least(1.0, (b1 - l1) / (h1 - l1 + 1e-6))), 6) AS b1,
  CASE WHEN b3 IS NOT NULL THEN round(greatest(0.0, least(1.0, (b3 - l3) / (h3 - l3 + 1e-6))), 6) END AS b3
  FROM px JOIN st USING (scene_id)""")
def _(spark, sf):
    px = fx.pixels(spark, sf, lines=True).select(*_KEY, "b1", "b3")
    return po.normalize_robust(px, ["b1", "b3"]).select(*_KEY, r6("b1"), r6("b3"))


@query("stretch_2_98", fx.with_(fx.PX8, _STATS3, _STRETCHED) +
       "SELECT scene_id, y, x, round(b1, 6) AS b1, round(b2, 6) AS b2, round(b3, 6) AS b3 FROM s3")
def _(spark, sf):
    return _stretched(spark, sf).select(*_KEY, *[r6(b) for b in _B3])


@query("rgb_composite", fx.with_(fx.PX8, _STATS3, _STRETCHED) +
       "SELECT scene_id, y, x, round(b3, 6) AS c1, round(b2, 6) AS c2, round(b1, 6) AS c3 FROM s3")
def _(spark, sf):
    px = fx.band_array(fx.pixels(spark, sf, lines=True))
    return po.rgb_composite(px, [3, 2, 1]).select(*_KEY, r6("c1"), r6("c2"), r6("c3"))


@query("rgb_from_order", fx.with_(fx.PX8) + "SELECT scene_id, y, x, round(b6, 6) AS r, round(b4, 4) AS g, b2 AS b FROM px")
def _(spark, sf):
    return po.rgb_from_order(fx.band_array(fx.pixels(spark, sf, lines=True))).select(*_KEY, r6("r"), r6("g", digits=4), "b")


@query("to_uint8", fx.with_(fx.PX, """v AS (SELECT scene_id, b1 AS v FROM px UNION ALL SELECT scene_id, b2 FROM px),
  st AS (SELECT scene_id, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM v GROUP BY scene_id)""") +
       """SELECT px.scene_id, y, x, CAST(floor(greatest(0.0, least(255.0, (b1 - lo) / (hi - lo) * 255.0))) AS INT) AS b1,
  CAST(floor(greatest(0.0, least(255.0, (b2 - lo) / (hi - lo) * 255.0))) AS INT) AS b2 FROM px JOIN st USING (scene_id)""")
def _(spark, sf):
    return po.to_uint8(fx.pixels(spark, sf), ["b1", "b2"])


@query("to_uint8_minmax", fx.with_(fx.PX, """st AS (SELECT scene_id, min(b1) AS lo, max(b1) AS hi FROM px GROUP BY scene_id)""") +
       """SELECT px.scene_id, y, x, CAST(floor(greatest(0.0, least(255.0, (b1 - lo) / (hi - lo) * 255.0))) AS INT) AS b1
  FROM px JOIN st USING (scene_id)""")
def _(spark, sf):
    return po.to_uint8(fx.pixels(spark, sf).drop("b2"), ["b1"], use_percentile=False)


@query("quantize8", fx.with_(fx.PX8, _STATS3, _STRETCHED) + """SELECT scene_id, y, x, CAST(floor(b1 * 255.0) AS INT) AS q1,
  CAST(floor(b2 * 255.0) AS INT) AS q2, CAST(floor(b3 * 255.0) AS INT) AS q3 FROM s3""")
def _(spark, sf):
    return _stretched(spark, sf).select(*_KEY, *[sc.quantize8(F.col(b)).alias(f"q{i}") for i, b in enumerate(_B3, 1)])


_EXG = """e AS (SELECT *, 2.0 * b2 - b3 - b1 AS exg FROM s3), er AS (SELECT scene_id, min(exg) AS mn, max(exg) AS mx FROM e GROUP BY scene_id),
idx AS (SELECT e.scene_id, y, x, coalesce((exg - mn) / (mx - mn + 1e-6), 0.0) AS v FROM e JOIN er USING (scene_id))"""


def _index(spark, sf):
    return po.excess_green(cut_lineage(_stretched(spark, sf)), "b1", "b2", "b3").select(*_KEY, "index")


@query("excess_green", fx.with_(fx.PX8, _STATS3, _STRETCHED, _EXG) +
       'SELECT scene_id, y, x, round(v, 6) AS "index" FROM idx')
def _(spark, sf):
    return _index(spark, sf).select(*_KEY, r6("index"))


@query("ndwi", fx.with_(fx.PX8) + "SELECT scene_id, y, x, round((b4 - b8) / (b4 + b8 + 1e-6), 6) AS ndwi FROM px")
def _(spark, sf):
    return fx.pixels(spark, sf, lines=True).select(*_KEY, r6(sc.ndwi(F.col("b4"), F.col("b8")), "ndwi"))


@query("suppress_water", fx.with_(fx.PX8) + """SELECT scene_id, y, x, CASE WHEN (b8 - b3) / (b8 + b3 + 1e-6) > -0.6 THEN -1.0 ELSE b1 END AS v FROM px""")
def _(spark, sf):
    water = sc.ndwi(F.col("b8"), F.col("b3"))
    return fx.pixels(spark, sf, lines=True).select(*_KEY, sc.suppress_water(F.col("b1"), water, -0.6).alias("v"))


@query("field_index_summary", fx.with_(fx.PX8, _STATS3, _STRETCHED, _EXG, """q AS (SELECT scene_id, quantile_cont(v, 0.75) AS q, count(*) AS total FROM idx GROUP BY scene_id)""") +
       """SELECT idx.scene_id, count(*) AS pixels, round(count(*) * 100.0 / any_value(total), 6) AS coverage_pct
  FROM idx JOIN q USING (scene_id) WHERE v > q GROUP BY idx.scene_id""")
def _(spark, sf):
    """Stretch, index, percentile threshold and coverage in one flow."""
    return field_index_summary(spark, sf)


def field_index_summary(spark, sf):
    from ..operators.masks import coverage_pct

    # each statistic reads its input more than once, so stages are kept
    stretched = cut_lineage(_stretched(spark, sf))
    index = cut_lineage(po.excess_green(stretched, "b1", "b2", "b3").select(*_KEY, "index"))
    mask = po.above_percentile(index, "index", 75.0)
    cover = coverage_pct(mask, fx.scenes(spark, sf))
    return mask.groupBy("scene_id").agg(F.count("*").alias("pixels")).join(cover, "scene_id").select(
        "scene_id", "pixels", r6("coverage_pct"))


@query("l2_normalize", fx.with_(fx.EMB, fx.FLAT, """n AS (SELECT vec_id, sqrt(sum((v * (label + 1)) * (v * (label + 1)))) + 1e-8 AS n FROM flat GROUP BY vec_id)""") +
       "SELECT vec_id, CAST(pos - 1 AS INT) AS pos, round(v * (label + 1) / n, 6) AS v FROM flat JOIN n USING (vec_id)")
def _(spark, sf):
    e = fx.embeddings(spark, sf).withColumn("f", F.transform("feature", lambda v: v * (F.col("label") + 1)))
    return e.select("vec_id", F.posexplode(vec.l2_normalize(F.col("f"))).alias("pos", "v")).select("vec_id", "pos", r6("v"))


_MEAN, _STD = [0.25 + 0.001 * i for i in range(8)], [0.5 + 0.01 * i for i in range(8)]


@query("standardize_bands", fx.with_(fx.PX8) + "SELECT scene_id, y, x, " + ", ".join(
    f"round((b{i + 1} - {m!r}) / {s!r}, 4) AS s{i + 1}" for i, (m, s) in enumerate(zip(_MEAN, _STD))) + " FROM px")
def _(spark, sf):
    px = fx.band_array(fx.pixels(spark, sf, lines=True)).withColumn("s", vec.standardize_bands(F.col("bands"), _MEAN, _STD))
    return px.select(*_KEY, *[r6(F.col("s")[i], f"s{i + 1}", 4) for i in range(8)])


@query("unstandardize_bands", fx.with_(fx.PX8) + "SELECT scene_id, y, x, " + ", ".join(
    f"CASE WHEN b{i + 1} IS NOT NULL THEN round(greatest(0.0, least(1.0, (b{i + 1} * {s!r} + {m!r}))), 6) END AS s{i + 1}"
    for i, (m, s) in enumerate(zip(_MEAN, _STD))) + " FROM px")
def _(spark, sf):
    px = fx.band_array(fx.pixels(spark, sf, lines=True)).withColumn("s", vec.unstandardize_bands(F.col("bands"), _MEAN, _STD))
    return px.select(*_KEY, *[r6(F.when(F.col("bands")[i].isNotNull(), F.col("s")[i]), f"s{i + 1}") for i in range(8)])


@query("scale_reflectance", fx.with_(fx.PX8, "st AS (SELECT scene_id, greatest(max(b5), max(b6)) AS top FROM px GROUP BY scene_id)") +
       """SELECT px.scene_id, y, x, CAST(trunc(CASE WHEN b5 IS NULL THEN NULL WHEN top <= 1.1 THEN greatest(0.0, least(10000.0, b5 * 10000.0)) ELSE b5 END) AS INT) AS b5,
  CAST(trunc(CASE WHEN b6 IS NULL THEN NULL WHEN top <= 1.1 THEN greatest(0.0, least(10000.0, b6 * 10000.0)) ELSE b6 END) AS INT) AS b6
  FROM px JOIN st USING (scene_id)""")
def _(spark, sf):
    px = fx.pixels(spark, sf, lines=True).select(*_KEY, "b5", "b6")
    return po.scale_reflectance(px, ["b5", "b6"])


@query("pad_to_multiple", fx.with_(fx.PX, fx.SCENES, """g AS (SELECT scene_id, unnest(range(0, CAST(ceil(height / 16.0) * 16 AS BIGINT))) AS y,
  CAST(ceil(width / 16.0) * 16 AS BIGINT) AS w FROM scenes), c AS (SELECT scene_id, y, unnest(range(0, w)) AS x FROM g)""") +
       """SELECT c.scene_id, CAST(c.y AS INT) AS y, CAST(c.x AS INT) AS x, coalesce(b1, 0.0) AS b1 FROM c LEFT JOIN px
  ON px.scene_id = c.scene_id AND px.y = c.y AND px.x = c.x""")
def _(spark, sf):
    return po.pad_to_multiple(fx.pixels(spark, sf), fx.scenes(spark, sf), 16, ["b1"])


@query("blend_overlay", fx.with_(fx.PX, fx.SPARSE, "v AS (SELECT scene_id, y, x, floor(b2 % 256) AS r, floor(b1 % 256) AS g FROM px)") + """SELECT v.scene_id, v.y, v.x,
  CAST(CASE WHEN m.y IS NULL THEN r ELSE floor(CAST(0.6 AS DOUBLE) * r + CAST(0.4 AS DOUBLE) * 46) END AS INT) AS r,
  CAST(CASE WHEN m.y IS NULL THEN g ELSE floor(CAST(0.6 AS DOUBLE) * g + CAST(0.4 AS DOUBLE) * 204) END AS INT) AS g
  FROM v LEFT JOIN m ON m.scene_id = v.scene_id AND m.y = v.y AND m.x = v.x""")
def _(spark, sf):
    px = fx.pixels(spark, sf).select(*_KEY, (F.col("b2") % 256).cast("int").alias("r"), F.floor(F.col("b1") % 256).cast("int").alias("g"))
    return po.blend_overlay(px, fx.sparse_mask(spark, sf), ["r", "g"], 0.4)


@query("colorize_labels", fx.with_(fx.PX, """lut AS (SELECT CAST(s_suppkey AS BIGINT) AS label, CAST(s_suppkey * 7 % 255 AS INT) AS r,
  CAST(s_suppkey * 31 % 255 AS INT) AS g, CAST(s_suppkey * 101 % 255 AS INT) AS b FROM supplier),
  lb AS (SELECT scene_id, y, x, CAST(b2 AS BIGINT) % 128 AS label FROM px)""") + """SELECT scene_id, y, x, lb.label,
  CASE WHEN lb.label = 0 THEN 0 ELSE coalesce(r, 0) END AS r, CASE WHEN lb.label = 0 THEN 0 ELSE coalesce(g, 0) END AS g,
  CASE WHEN lb.label = 0 THEN 0 ELSE coalesce(b, 0) END AS b FROM lb LEFT JOIN lut ON lut.label = lb.label""")
def _(spark, sf):
    k = F.col("s_suppkey")
    lut = fx.table(spark, sf, "supplier").select(k.alias("label"), *[
        (k * m % 255).cast("int").alias(c) for m, c in ((7, "r"), (31, "g"), (101, "b"))])
    labels = fx.pixels(spark, sf).select(*_KEY, (F.col("b2").cast("bigint") % 128).alias("label"))
    return po.colorize_labels(labels, lut)


@query("colorize_labels_hashed", fx.with_(fx.PX, "lb AS (SELECT scene_id, y, x, CAST(b2 AS BIGINT) AS label, md5(CAST(CAST(b2 AS BIGINT) AS VARCHAR)) AS h FROM px)") +
       "SELECT scene_id, y, x, label, " + ", ".join(f"CASE WHEN label = 0 THEN 0 ELSE CAST('0x' || substr(h, {2 * i + 1}, 2) AS INT) % 255 END AS {c}" for i, c in enumerate("rgb")) + " FROM lb")
def _(spark, sf):
    return po.colorize_labels(fx.pixels(spark, sf).select(*_KEY, F.col("b2").cast("bigint").alias("label")))


@query("pixel_to_map", fx.with_(fx.PX) + """SELECT scene_id, y, x, round(0.2 * x + 500000.0 + 1000.0 * scene_id, 4) AS mx,
  round(-0.2 * y + 5900000.0, 4) AS my, round(0.2 * 2 * x + 500000.0 + 1000.0 * scene_id, 4) AS sx, round(-0.2 * y + 5900000.0 + 3.5, 4) AS ty FROM px""")
def _(spark, sf):
    px = fx.pixels(spark, sf).join(fx.scenes(spark, sf).select("scene_id", "transform"), "scene_id")
    t, x, y = F.col("transform"), F.col("x"), F.col("y")
    scaled, moved = geo.affine_scaled(t, F.lit(2.0), F.lit(1.0)), geo.affine_shifted(t, F.lit(0.0), F.lit(3.5))
    return px.select(*_KEY, r6(geo.map_x(t, x, y), "mx", 4), r6(geo.map_y(t, x, y), "my", 4),
                     r6(geo.map_x(scaled, x, y), "sx", 4), r6(geo.map_y(moved, x, y), "ty", 4))


@query("affine_from_bounds", fx.with_(fx.SITES) + """SELECT site_id, round((lon + 2.0 - lon) / 500, 9) AS a, lon AS c,
  round((lat - (lat + 1.0)) / 250, 9) AS e, lat + 1.0 AS f FROM sites""")
def _(spark, sf):
    lat, lon = F.col("lat"), F.col("lon")
    t = geo.affine_from_bounds(lon, lat, lon + 2.0, lat + 1.0, F.lit(500), F.lit(250))
    return fx.sites(spark, sf).withColumn("t", t).select("site_id", r6("t.a", "a", 9), F.col("t.c").alias("c"), r6("t.e", "e", 9), F.col("t.f").alias("f"))


@query("meters_to_degrees", fx.with_(fx.SITES) + """SELECT site_id, round(5120.0 / 111320.0, 9) AS lat_deg,
  round(5120.0 / (111320.0 * cos(radians(lat))), 9) AS lon_deg FROM sites""")
def _(spark, sf):
    return fx.sites(spark, sf).select("site_id", r6(geo.meters_to_lat_deg(F.lit(5120.0)), "lat_deg", 9),
                                      r6(geo.meters_to_lon_deg(F.lit(5120.0), F.col("lat")), "lon_deg", 9))


_EPSG = "CAST(CASE WHEN greatest(-80.0, least(84.0, lat)) >= 0 THEN 32600 ELSE 32700 END + floor((lon + 180.0) / 6.0) + 1 AS INT)"


@query("utm_epsg", fx.with_(fx.SITES) + f"SELECT site_id, {_EPSG} AS epsg FROM sites")
def _(spark, sf):
    return fx.sites(spark, sf).select("site_id", geo.utm_epsg(F.col("lat"), F.col("lon")).alias("epsg"))


def _krueger_sql() -> str:
    n, r, ecc, fwd = geo._N, geo._R, geo._ECC, geo._FORWARD
    east = "eta" + "".join(f" + ({c!r}) * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, c in enumerate(fwd, 1))
    north = "xi" + "".join(f" + ({c!r}) * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, c in enumerate(fwd, 1))
    return fx.with_(fx.SITES, f"e AS (SELECT *, {_EPSG} AS epsg, sin(radians(lat)) AS s FROM sites)",
                    f"t AS (SELECT *, sinh(atanh(s) - {ecc!r} * atanh({ecc!r} * s)) AS t, radians(lon) - radians((epsg % 100) * 6.0 - 183.0) AS d FROM e)",
                    "u AS (SELECT *, atan2(t, cos(d)) AS xi, atanh(sin(d) / sqrt(1 + t * t)) AS eta FROM t)") + f"""SELECT site_id, epsg,
  round(500000.0 + {0.9996 * r!r} * ({east}), 3) AS east, round(CASE WHEN epsg // 100 = 327 THEN 10000000.0 ELSE 0.0 END + {0.9996 * r!r} * ({north}), 3) AS north FROM u"""


@query("to_utm", _krueger_sql())
def _(spark, sf):
    s = fx.sites(spark, sf).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon")))
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    return s.select("site_id", "epsg", r6(e, "east", 3), r6(n, "north", 3))


@query("utm_round_trip", fx.with_(fx.SITES) + "SELECT site_id, lat, lon FROM sites")
def _(spark, sf):
    """Forward and inverse projection return the place."""
    s = fx.sites(spark, sf).withColumn("epsg", geo.utm_epsg(F.col("lat"), F.col("lon")))
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    lat, lon = geo.from_utm(e, n, F.col("epsg"))
    return s.select("site_id", r6(lat + 0.0, "lat"), r6(lon + 0.0, "lon"))


@query("centroid_lonlat", fx.with_(fx.PX, fx.SCENES) + """SELECT scene_id, round(500000.0 + 1000.0 * scene_id + 0.2 * width / 2.0, 3) AS east,
  round(5900000.0 - 0.2 * height / 2.0, 3) AS north FROM scenes""")
def _(spark, sf):
    """Projected again, the place is the middle of the scene."""
    s = fx.scenes(spark, sf)
    lon, lat = geo.centroid_lonlat(F.col("transform"), F.col("width"), F.col("height"), F.col("epsg"))
    s = s.select("scene_id", "epsg", lon.alias("lon"), lat.alias("lat"))
    e, n = geo.to_utm(F.col("lat"), F.col("lon"), F.col("epsg"))
    return s.select("scene_id", r6(e, "east", 3), r6(n, "north", 3))


@query("parse_epsg", fx.with_(fx.SITES) + f"""SELECT site_id, CASE WHEN s_acctbal > 5000 THEN 20000 + CAST(site_id AS INT) ELSE {_EPSG} END AS epsg
  FROM sites JOIN supplier ON s_suppkey = site_id""")
def _(spark, sf):
    s = fx.sites(spark, sf).join(fx.table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("site_id"))
    text = F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("epsg:"), 20000 + F.col("site_id"))).otherwise("unknown")
    return s.select("site_id", geo.parse_epsg(text, F.col("lat"), F.col("lon")).alias("epsg"))


@query("clean_nan", fx.with_(fx.PX8) + "SELECT scene_id, y, x, CASE WHEN b8 > 40 OR b8 < 10 THEN 0.0 ELSE coalesce(b8, 0.0) END AS v FROM px")
def _(spark, sf):
    b = F.col("b8")
    v = F.when(b > 40, float("nan")).when(b < 10, float("inf")).otherwise(b)
    return fx.pixels(spark, sf, lines=True).select(*_KEY, sc.clean_nan(v).alias("v"))


@query("infer_layout", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'HW' WHEN p_size < 20 THEN 'CHW' ELSE 'HWC' END AS layout FROM part""")
def _(spark, sf):
    s = F.col("p_size")
    shape = F.when(s % 5 == 0, F.array(s, s)).otherwise(F.array(s, F.lit(512), F.lit(20)))
    return fx.table(spark, sf, "part").select("p_partkey", sc.infer_layout(shape).alias("layout"))


@query("infer_layout_strict", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'HW' WHEN p_size > 3 AND p_size < 20 THEN 'CHW' ELSE 'HWC' END AS layout FROM part""")
def _(spark, sf):
    s = F.col("p_size")
    shape = F.when(s % 5 == 0, F.array(s, s)).when((s > 3) & (s < 20), F.array(s, F.lit(512), F.lit(600))).otherwise(
        F.array(F.lit(512), F.lit(600), F.lit(3)))
    return fx.table(spark, sf, "part").select("p_partkey", sc.infer_layout_strict(shape).alias("layout"))


@query("complement", fx.with_(fx.PX, fx.SPARSE) + """SELECT px.scene_id, px.y, px.x FROM px ANTI JOIN m
  ON m.scene_id = px.scene_id AND m.y = px.y AND m.x = px.x""")
def _(spark, sf):
    return po.complement(fx.sparse_mask(spark, sf), fx.scenes(spark, sf))


@query("display_scale", fx.with_(fx.PX8) + "SELECT scene_id, y, x, round(greatest(0.001, least(0.9999, coalesce(b5, 0.0) * 3.5)), 6) AS v FROM px")
def _(spark, sf):
    return fx.pixels(spark, sf, lines=True).select(*_KEY, r6(sc.display_scale(sc.clean_nan(F.col("b5"))), "v"))


@query("unscale_reflectance", fx.with_(fx.PX) + "SELECT scene_id, y, x, round(b2 / 10000.0, 6) AS v FROM px")
def _(spark, sf):
    return fx.pixels(spark, sf).select(*_KEY, r6(sc.unscale_reflectance(F.col("b2")), "v"))


@query("fit_max_edge", fx.with_(fx.PX, fx.SCENES, "k AS (SELECT *, CASE WHEN greatest(height, width) > 64 THEN 64.0 / greatest(height, width) ELSE 1.0 END AS s FROM scenes)") +
       """SELECT scene_id, CAST(floor(height * s) AS INT) AS out_height, CAST(floor(width * s) AS INT) AS out_width,
  round(0.2 * width / floor(width * s), 9) AS a, round(-0.2 * height / floor(height * s), 9) AS e FROM k""")
def _(spark, sf):
    return po.fit_max_edge(fx.scenes(spark, sf), 64).select(
        "scene_id", "out_height", "out_width", r6("transform.a", "a", 9), r6("transform.e", "e", 9))


@query("minmax_scale_global", fx.with_(fx.PX, "st AS (SELECT scene_id, least(min(b1), min(b2)) AS lo, greatest(max(b1), max(b2)) AS hi FROM px GROUP BY scene_id)") +
       "SELECT px.scene_id, y, x, round((b1 - lo) / (hi - lo), 6) AS b1, round((b2 - lo) / (hi - lo), 6) AS b2 FROM px JOIN st USING (scene_id)")
def _(spark, sf):
    return po.minmax_scale(fx.pixels(spark, sf), ["b1", "b2"], "global", ["scene_id"]).select(*_KEY, r6("b1"), r6("b2"))


@query("minmax_scale_component", fx.with_(fx.PX, "st AS (SELECT min(b1) AS l1, max(b1) AS h1, min(b2) AS l2, max(b2) AS h2 FROM px)") +
       "SELECT scene_id, y, x, round((b1 - l1) / (h1 - l1), 6) AS b1, round((b2 - l2) / (h2 - l2), 6) AS b2 FROM px, st")
def _(spark, sf):
    return po.minmax_scale(fx.pixels(spark, sf), ["b1", "b2"], "component", eps=1e-6).select(*_KEY, r6("b1"), r6("b2"))


@query("above_percentile", fx.with_(fx.PX, fx.SPARSE) + "SELECT scene_id, y, x FROM m")
def _(spark, sf):
    return fx.sparse_mask(spark, sf)


@query("threshold_mask", fx.with_(fx.PX8) + "SELECT scene_id, y, x FROM px WHERE b3 - 4 * b8 > 0")
def _(spark, sf):
    return po.threshold_mask(fx.pixels(spark, sf, lines=True), F.col("b3") - 4 * F.col("b8"))


@query("mask_nodata", fx.with_(fx.PX8) + "SELECT scene_id, y, x, nullif(b8, 50.0) AS v FROM px")
def _(spark, sf):
    return fx.pixels(spark, sf, lines=True).select(*_KEY, sc.mask_nodata(F.col("b8"), 50.0).alias("v"))


@query("acquired_between", """SELECT user_id AS pixel, event_id, value FROM events
  WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""")
def _(spark, sf):
    return po.acquired_between(fx.time_cube(spark, sf), "ts", "2024-01-05", "2024-01-20").drop("ts")


@query("nth_acquisition", """SELECT pixel, event_id, value FROM (SELECT user_id AS pixel, event_id, value,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 4""")
def _(spark, sf):
    return po.nth_acquisition(fx.time_cube(spark, sf), ["pixel"], [F.col("ts"), F.col("event_id")], 3).drop("ts")


@query("temporal_median", "SELECT user_id AS pixel, round(quantile_cont(value, 0.5), 6) AS median FROM events GROUP BY user_id")
def _(spark, sf):
    return po.temporal_median(fx.time_cube(spark, sf), ["pixel"], "value").select("pixel", r6("median"))


@query("ensemble_spread", """SELECT CAST(o // 100 AS INT) AS y, CAST(o % 100 AS INT) AS x, round(avg(v), 4) AS mean, round(stddev_samp(v), 4) AS spread, count(v) AS runs
  FROM (SELECT l_orderkey AS o, l_linenumber, max(l_extendedprice) AS v FROM lineitem GROUP BY ALL) GROUP BY o""")
def _(spark, sf):
    runs = fx.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_extendedprice").alias("v"))
    runs = runs.select(F.floor(F.col("l_orderkey") / 100).cast("int").alias("y"), (F.col("l_orderkey") % 100).cast("int").alias("x"), "v")
    return po.ensemble_spread(runs, ["y", "x"], "v").select("y", "x", r6("mean", digits=4), r6("spread", digits=4), "runs")
