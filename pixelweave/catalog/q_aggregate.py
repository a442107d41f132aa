"""Aggregations, filters, region properties and prompts assembly."""

from pyspark.sql import functions as F

from .. import fixed_values as fv
from ..operators import boxes as bx, masks as mk, merge as mg, outlines as ol, prompts as pr, regions as rg, stencil as st
from ..operators.tiles import assign_tiles, tile_stride
from . import fixtures as fx
from .registry import query, r6

_KEY = ["scene_id", "y", "x"]
_REG = fx.with_(fx.PX, fx.REGIONS)


@query("stitch_mean", fx.with_(fx.PX, fx.SCENES, """sy AS (SELECT scene_id, unnest(range(0, greatest(1, height - 23), 10)) AS y0 FROM scenes),
sx AS (SELECT scene_id, unnest(range(0, greatest(1, width - 23), 10)) AS x0 FROM scenes),
c AS (SELECT px.scene_id, y, x, b2 + y0 + 2 * x0 AS v FROM px JOIN sy ON sy.scene_id = px.scene_id AND y >= y0 AND y < y0 + 24
  JOIN sx ON sx.scene_id = px.scene_id AND x >= x0 AND x < x0 + 24), a AS (SELECT scene_id, y, x, avg(v) AS v FROM c GROUP BY ALL)""") +
       "SELECT px.scene_id, px.y, px.x, round(coalesce(v, 0.0), 6) AS v FROM px LEFT JOIN a USING (scene_id, y, x)")
def _(spark, sf):
    """Tile values depend on the tile; overlaps are averaged, the uncovered rest is 0."""
    sc = fx.scenes(spark, sf)
    t = assign_tiles(fx.pixels(spark, sf), sc, tile_stride(24, 10))
    return mg.stitch_mean(t.withColumn("v", F.col("b2") + F.col("y0") + 2 * F.col("x0")), "v", sc).select(*_KEY, r6("v"))


@query("stitch_mean_vectors", fx.with_(fx.PX, fx.SCENES, """sy AS (SELECT scene_id, unnest(range(0, greatest(1, height - 23), 10)) AS y0 FROM scenes),
sx AS (SELECT scene_id, unnest(range(0, greatest(1, width - 23), 10)) AS x0 FROM scenes)""") + """SELECT px.scene_id, y, x, round(avg(b2 + y0), 6) AS v1, round(avg(b1 * x0), 4) AS v2
  FROM px JOIN sy ON sy.scene_id = px.scene_id AND y >= y0 AND y < y0 + 24 JOIN sx ON sx.scene_id = px.scene_id AND x >= x0 AND x < x0 + 24 GROUP BY ALL""")
def _(spark, sf):
    t = assign_tiles(fx.pixels(spark, sf), fx.scenes(spark, sf), tile_stride(24, 10))
    v = t.withColumn("f", F.array(F.col("b2") + F.col("y0"), F.col("b1") * F.col("x0")))
    return mg.stitch_mean_vectors(v, "f").select(*_KEY, r6(F.col("f")[0], "v1"), r6(F.col("f")[1], "v2", 4))


@query("block_majority", fx.with_(fx.PX, fx.SCENES) + """SELECT scene_id, CAST(y // 7 AS INT) AS by, CAST(x // 7 AS INT) AS bx,
  CAST(avg(CAST(b2 AS BIGINT) % 2) > 0.5 AS INT) AS label FROM px JOIN scenes USING (scene_id) WHERE y < (height // 7) * 7 AND x < (width // 7) * 7 GROUP BY ALL""")
def _(spark, sf):
    return mk.block_majority(fx.label_map(spark, sf), 7, fx.scenes(spark, sf))


@query("component_stats", _REG + """SELECT scene_id, label, count(*) AS area, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM lab GROUP BY ALL""")
def _(spark, sf):
    return mk.component_stats(fx.block_regions(spark, sf))


_PROPS = """pr AS (SELECT scene_id, label, count(*) AS area, min(y) AS min_row, min(x) AS min_col, max(y) + 1 AS max_row, max(x) + 1 AS max_col,
  avg(y) AS cr, avg(x) AS cc, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS vxy FROM lab GROUP BY ALL),
pe AS (SELECT *, (vy + vx + sqrt((vy - vx) ** 2 + 4 * vxy ** 2)) / 2 AS l1, (vy + vx - sqrt((vy - vx) ** 2 + 4 * vxy ** 2)) / 2 AS l2 FROM pr)"""


@query("region_props", fx.with_(fx.PX, fx.REGIONS, _PROPS) + """SELECT scene_id, label, area, min_row, min_col, max_row, max_col, round(cr, 6) AS centroid_row,
  round(cc, 6) AS centroid_col, round(CASE WHEN l1 > 0 THEN sqrt(greatest(0.0, 1 - l2 / l1)) ELSE 0.0 END, 5) AS eccentricity FROM pe""")
def _(spark, sf):
    p = rg.region_props(fx.block_regions(spark, sf))
    return p.select("scene_id", "label", "area", "min_row", "min_col", "max_row", "max_col", r6("centroid_row"),
                    r6("centroid_col"), r6("eccentricity", digits=5))


@query("bbox_polygons", fx.with_(fx.PX, fx.REGIONS, _PROPS, "t AS (SELECT *, 500000.0 + 1000.0 * scene_id AS ox FROM pr)") + """SELECT scene_id, label, area,
  round(ox + 0.2 * min_col, 4) AS x1, round(5900000.0 - 0.2 * min_row, 4) AS y1, round(ox + 0.2 * min_col, 4) AS x2, round(5900000.0 - 0.2 * max_row, 4) AS y2,
  round(ox + 0.2 * max_col, 4) AS x3, round(5900000.0 - 0.2 * max_row, 4) AS y3, round(ox + 0.2 * max_col, 4) AS x4, round(5900000.0 - 0.2 * min_row, 4) AS y4 FROM t""")
def _(spark, sf):
    b = rg.bbox_polygons(rg.region_props(fx.block_regions(spark, sf)), fx.scenes(spark, sf))
    return b.select("scene_id", "label", "area", *[r6(f"{a}{i}", digits=4) for i in range(1, 5) for a in "xy"])


@query("region_points", fx.with_(fx.PX, fx.REGIONS, _PROPS) + """SELECT scene_id, label, area, round(500000.0 + 1000.0 * scene_id + 0.2 * cc, 4) AS px, round(5900000.0 - 0.2 * cr, 4) AS py FROM pr""")
def _(spark, sf):
    p = rg.region_points(rg.region_props(fx.block_regions(spark, sf)), fx.scenes(spark, sf))
    return p.select("scene_id", "label", "area", r6("px", digits=4), r6("py", digits=4))


def _perimeter_sql() -> str:
    case = " ".join(f"WHEN code = {c} THEN CAST({w!r} AS DOUBLE)" for c, w in fv.PERIMETER_WEIGHTS.items())
    return fx.with_(fx.PX, fx.REGIONS, """n4 AS (SELECT a.scene_id, a.label, a.y, a.x, count(*) AS n FROM lab a JOIN lab b ON b.scene_id = a.scene_id AND b.label = a.label
  AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL),
e AS (SELECT scene_id, label, y, x FROM n4 WHERE n < 5),
k AS (SELECT a.scene_id, a.label, a.y, a.x, CAST(sum(CASE abs(a.y - b.y) + abs(a.x - b.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS INT) AS code FROM e a JOIN e b
  ON b.scene_id = a.scene_id AND b.label = a.label AND b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL)""") + \
        f"SELECT scene_id, label, round(sum(CASE {case} ELSE CAST(0 AS DOUBLE) END), 5) AS perimeter FROM k GROUP BY ALL"


@query("region_perimeter", _perimeter_sql())
def _(spark, sf):
    return rg.region_perimeter(fx.block_regions(spark, sf)).select("scene_id", "label", r6("perimeter", digits=5))


_HULL = """sp AS (SELECT scene_id, label, y, min(x) AS lo, max(x) AS hi, count(*) AS n FROM lab GROUP BY ALL),
pt AS (SELECT scene_id, label, y + dy AS py, lo - 0.5 + abs(dy) AS px FROM sp JOIN (SELECT unnest([-0.5, 0.0, 0.5]) AS dy) ON true
  UNION ALL SELECT scene_id, label, y + dy, hi + 0.5 - abs(dy) FROM sp JOIN (SELECT unnest([-0.5, 0.0, 0.5]) AS dy) ON true),
cut AS (SELECT a.scene_id, a.label, s.y, CASE WHEN a.py = b.py THEN a.px ELSE a.px + (s.y - a.py) / (b.py - a.py) * (b.px - a.px) END AS x
  FROM pt a JOIN pt b ON a.scene_id = b.scene_id AND a.label = b.label AND a.py <= b.py
  JOIN (SELECT scene_id, label, unnest(range(low, high + 1)) AS y FROM (SELECT scene_id, label, min(y) AS low, max(y) AS high FROM sp GROUP BY ALL)) s ON s.scene_id = a.scene_id AND s.label = a.label AND s.y BETWEEN a.py AND b.py),
cv AS (SELECT scene_id, label, y, CAST(floor(max(x) + 1e-9) - ceil(min(x) - 1e-9) + 1 AS BIGINT) AS n FROM cut GROUP BY ALL),
ar AS (SELECT scene_id, label, CAST(sum(n) AS BIGINT) AS area FROM sp GROUP BY ALL)"""


@query("region_solidity", fx.with_(fx.PX, fx.REGIONS, _HULL) + """SELECT scene_id, label, any_value(area) AS area, CAST(sum(n) AS BIGINT) AS convex_area,
  round(any_value(area) / sum(n), 6) AS solidity FROM cv JOIN ar USING (scene_id, label) GROUP BY ALL""")
def _(spark, sf):
    """SQL: a hull's row is what pairs of its points span there."""
    return rg.region_solidity(fx.block_regions(spark, sf)).withColumn("solidity", r6("solidity"))


@query("polygonize", fx.with_(fx.PX, fx.REGIONS) + """SELECT scene_id, label, count(*) AS area, true AS on_region, true AS wkt_matches FROM lab
  GROUP BY ALL HAVING count(*) >= 10""")
def _(spark, sf):
    """Every corner of a ring is a pixel of its region, and the text has the ring's corners and the first again."""
    labels, sc = fx.block_regions(spark, sf), fx.scenes(spark, sf)
    p = rg.polygonize(labels, sc, min_area=10)
    at = p.select("scene_id", "label", F.explode("ring").alias("c")).select(
        "scene_id", "label", F.round((5900000.0 - F.col("c.y")) / 0.2).cast("int").alias("y"),
        F.round((F.col("c.x") - 500000.0 - 1000.0 * F.col("scene_id")) / 0.2).cast("int").alias("x"))
    on = at.join(labels.withColumn("hit", F.lit(True)), ["scene_id", "label", "y", "x"], "left").groupBy("scene_id", "label").agg(
        F.bool_and(F.coalesce("hit", F.lit(False))).alias("on_region"))
    return p.join(on, ["scene_id", "label"]).select(
        "scene_id", "label", "area", "on_region", (F.size(F.split("wkt", ",")) == F.size("ring") + 1).alias("wkt_matches"))


_WALK = """o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 1), (2, 1, 0), (3, 1, -1), (4, 0, -1), (5, -1, -1), (6, -1, 0), (7, -1, 1)) t(d, dy, dx)),
bd AS MATERIALIZED (SELECT a.scene_id, a.label, a.y, a.x FROM lab a LEFT JOIN lab t ON t.scene_id = a.scene_id AND t.label = a.label AND abs(t.y - a.y) + abs(t.x - a.x) = 1
  GROUP BY ALL HAVING count(t.y) < 4),
oc AS MATERIALIZED (SELECT a.scene_id, a.label, a.y, a.x, list(d) AS ds FROM bd a JOIN bd t ON t.scene_id = a.scene_id AND t.label = a.label
  JOIN o ON t.y = a.y + dy AND t.x = a.x + dx GROUP BY ALL),
nx AS MATERIALIZED (SELECT *, (came + list_min(list_filter(range(1, 9), lambda t: list_contains(ds, (came + t) % 8)))) % 8 AS dir
  FROM (SELECT *, unnest(range(0, 8)) AS came FROM oc)),
wk AS (SELECT scene_id, label, y AS sy, x AS sx, 0 AS rank, y, x, CAST(4 AS BIGINT) AS came FROM oc WHERE list_max(ds) < 4
  UNION ALL SELECT w.scene_id, w.label, sy, sx, rank + 1, w.y + dy, w.x + dx, (dir + 4) % 8 FROM wk w
  JOIN nx n ON n.scene_id = w.scene_id AND n.label = w.label AND n.y = w.y AND n.x = w.x AND n.came = w.came JOIN o ON o.d = n.dir
  WHERE NOT (rank > 0 AND w.y = sy AND w.x = sx AND w.came = list_max(n.ds))),
st AS (SELECT *, lead(y) OVER w AS y2, lead(x) OVER w AS x2 FROM wk WINDOW w AS (PARTITION BY scene_id, label, sy, sx ORDER BY rank)),
cy AS (SELECT scene_id, label, sy, sx, max(rank) AS n, abs(sum(x * y2 - x2 * y)) AS a FROM st GROUP BY ALL HAVING min((y, x)) = (sy, sx)),
top AS (SELECT scene_id, label, arg_min((sy, sx), (-a, sy, sx)) AS s FROM cy GROUP BY ALL)"""


@query("outline_rings", fx.with_(fx.PX, fx.REGIONS, _WALK, recursive=True) + """SELECT scene_id, label, CAST(rank AS BIGINT) AS rank, CAST(y AS INT) AS y, CAST(x AS INT) AS x
  FROM st JOIN cy USING (scene_id, label, sy, sx) JOIN top USING (scene_id, label) WHERE (sy, sx) = s AND rank < n""")
def _(spark, sf):
    """Every border pixel of each region's largest outline, in walking order; the SQL walks each border."""
    labels = fx.block_regions(spark, sf)
    return ol.outer_rings(rg.border(labels), fx.scenes(spark, sf), 16).select("scene_id", "label", "rank", "y", "x")


@query("label_boundaries", fx.with_(fx.PX, fx.REGIONS, fx.SCENES, """o AS (SELECT * FROM (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)) t(dy, dx)),
nb AS (SELECT lab.*, height, width, dy, dx FROM lab JOIN scenes USING (scene_id) JOIN o ON lab.y + dy BETWEEN 0 AND height - 1 AND lab.x + dx BETWEEN 0 AND width - 1)""") +
       """SELECT DISTINCT nb.scene_id, nb.y, nb.x, nb.label FROM nb LEFT JOIN lab t ON t.scene_id = nb.scene_id AND t.y = nb.y + dy AND t.x = nb.x + dx
  WHERE t.label IS NULL OR t.label <> nb.label""")
def _(spark, sf):
    return st.label_boundaries(fx.block_regions(spark, sf), fx.scenes(spark, sf))


@query("coverage_pct", fx.with_(fx.PX, fx.SPARSE, fx.SCENES) + """SELECT scene_id, round(count(m.y) * 100.0 / any_value(height * width), 6) AS coverage_pct
  FROM scenes LEFT JOIN m USING (scene_id) GROUP BY scene_id""")
def _(spark, sf):
    return mk.coverage_pct(fx.sparse_mask(spark, sf), fx.scenes(spark, sf)).select("scene_id", r6("coverage_pct"))


@query("count_segments", _REG + "SELECT scene_id, count(DISTINCT label) AS segments FROM lab WHERE label <> 0 GROUP BY scene_id")
def _(spark, sf):
    return mk.count_segments(fx.block_regions(spark, sf))


@query("keep_min_area", _REG + "SELECT lab.* FROM lab JOIN (SELECT scene_id, label FROM lab GROUP BY ALL HAVING count(*) >= 19) k USING (scene_id, label)")
def _(spark, sf):
    return mk.keep_min_area(fx.block_regions(spark, sf), 19)


@query("keep_area_range", _REG + "SELECT lab.* FROM lab JOIN (SELECT scene_id, label FROM lab GROUP BY ALL HAVING count(*) BETWEEN 15 AND 20) k USING (scene_id, label)")
def _(spark, sf):
    return mk.keep_area_range(fx.block_regions(spark, sf), 15, 20)


@query("filter_regions", _REG + "SELECT scene_id, label, count(*) AS area FROM lab GROUP BY ALL HAVING count(*) >= 20")
def _(spark, sf):
    return mk.filter_regions(mk.component_stats(fx.block_regions(spark, sf)), 20).select("scene_id", "label", "area")


@query("filter_masks", fx.with_(fx.MASKS) + """SELECT mask_id, area, patch_idx, round(predicted_iou, 9) AS predicted_iou, round(stability_score, 9) AS stability_score
  FROM masks WHERE predicted_iou >= 0.5 AND stability_score >= 0.96 AND area >= 28""")
def _(spark, sf):
    return mk.filter_masks(fx.masks(spark, sf), 0.5, 0.96, 28).select(
        "mask_id", "area", "patch_idx", r6("predicted_iou", digits=9), r6("stability_score", digits=9))


@query("drop_blank_tiles", fx.with_(fx.PX, "t AS (SELECT *, CAST(y // 2 AS INT) AS ty, CAST(x // 2 AS INT) AS tx, CASE WHEN b1 > 150000 THEN b1 ELSE 0.0 END AS v FROM px)") +
       """SELECT scene_id, y, x, ty, tx, v FROM t JOIN (SELECT scene_id, ty, tx FROM t GROUP BY ALL HAVING max(v) <> 0) k USING (scene_id, ty, tx)""")
def _(spark, sf):
    t = fx.pixels(spark, sf).select(*_KEY, F.floor(F.col("y") / 2).cast("int").alias("ty"), F.floor(F.col("x") / 2).cast("int").alias("tx"),
                                    F.when(F.col("b1") > 150000, F.col("b1")).otherwise(0.0).alias("v"))
    return mk.drop_blank_tiles(t, ["scene_id", "ty", "tx"], ["v"])


@query("best_masks", fx.with_("""mp AS (SELECT DISTINCT l_suppkey AS obj_id, l_linenumber AS mask_idx, l_orderkey AS o FROM lineitem),
b AS (SELECT l_suppkey AS obj_id, l_linenumber AS mask_idx, sum(l_quantity) AS score FROM lineitem GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY obj_id ORDER BY score DESC, mask_idx) AS r FROM b)""") + """SELECT DISTINCT CAST(0 AS BIGINT) AS scene_id, CAST(o // 100 AS INT) AS y, CAST(o % 100 AS INT) AS x
  FROM mp JOIN w USING (obj_id, mask_idx) WHERE r = 1""")
def _(spark, sf):
    li = fx.table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "obj_id").withColumnRenamed("l_linenumber", "mask_idx")
    masks = li.groupBy("obj_id", "mask_idx").agg(F.sum("l_quantity").alias("score"))
    px = li.select("obj_id", "mask_idx", F.lit(0).cast("bigint").alias("scene_id"), F.floor(F.col("l_orderkey") / 100).cast("int").alias("y"),
                   (F.col("l_orderkey") % 100).cast("int").alias("x")).distinct()
    return mk.best_masks(masks, px)


@query("choose_polarity", fx.with_(fx.PX, fx.REGIONS, """l2 AS (SELECT scene_id, CAST(1 + (y // 6) * 20 + (x // 5) AS BIGINT) AS label FROM px WHERE (scene_id, y, x) NOT IN (SELECT scene_id, y, x FROM m0)),
a AS (SELECT scene_id, count(*) AS pixels, count(DISTINCT label) AS components FROM lab GROUP BY 1), b AS (SELECT scene_id, count(*) AS alt_pixels, count(DISTINCT label) AS alt_components FROM l2 GROUP BY 1)""") +
       "SELECT scene_id, pixels, components, alt_pixels, alt_components, (alt_pixels > pixels OR alt_components > components) AS use_complement FROM a JOIN b USING (scene_id)")
def _(spark, sf):
    from ..operators.pixels import complement

    lab, sc = fx.block_regions(spark, sf), fx.scenes(spark, sf)
    other = complement(lab, sc).withColumn("label", (1 + F.floor(F.col("y") / 6) * 20 + F.floor(F.col("x") / 5)).cast("bigint"))
    return mk.choose_polarity(lab, other, sc)


@query("timing_summary", "SELECT event_type AS name, round(sum(value), 4) AS total, count(*) AS calls, round(avg(value), 6) AS mean FROM events GROUP BY event_type")
def _(spark, sf):
    t = fx.table(spark, sf, "events").select(F.col("event_type").alias("name"), F.col("value").alias("seconds"))
    return mk.timing_summary(t).select("name", r6("total", digits=4), "calls", r6("mean"))


@query("topk_prompts", fx.with_(fx.PX, """u AS (SELECT scene_id, y, x, row_number() OVER (PARTITION BY scene_id ORDER BY b2 DESC, y, x) AS up,
  row_number() OVER (PARTITION BY scene_id ORDER BY b2, y, x) AS dn FROM px)""") + """SELECT scene_id, 1 AS label, CAST(up AS INT) AS rank, y, x FROM u WHERE up <= 16
  UNION ALL SELECT scene_id, 0, CAST(dn AS INT), y, x FROM u WHERE dn <= 8""")
def _(spark, sf):
    return pr.topk_prompts(fx.pixels(spark, sf), 16, 8, "b2")


_PROMPTS = """pt AS (SELECT event_id // 4 AS obj_id, event_id AS seq, value AS x, CAST(user_id AS DOUBLE) AS y, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS label
  FROM events WHERE event_type IN ('click', 'error')),
bo AS (SELECT event_id // 4 AS obj_id, min(value) AS x0, min(user_id) * 1.0 AS y0, max(value) AS x1, max(user_id) * 1.0 AS y1 FROM events WHERE event_type NOT IN ('click', 'error') GROUP BY 1),
al AS (SELECT * FROM pt UNION ALL SELECT obj_id, 0, (x0 + x1) * 0.5, (y0 + y1) * 0.5, 1 FROM bo WHERE obj_id NOT IN (SELECT obj_id FROM pt))"""


@query("assemble_prompts", fx.with_(_PROMPTS) + """SELECT al.obj_id, row_number() OVER (PARTITION BY al.obj_id ORDER BY seq) AS position, round(x, 6) AS x, round(y, 6) AS y, label,
  coalesce(x0, 0.0) AS x0, coalesce(y0, 0.0) AS y0, coalesce(x1, 0.0) AS x1, coalesce(y1, 0.0) AS y1 FROM al LEFT JOIN bo USING (obj_id)""")
def _(spark, sf):
    """Objects of four events each: clicks and errors are points, the others span the box."""
    e = fx.table(spark, sf, "events").withColumn("obj_id", F.floor(F.col("event_id") / 4))
    point = F.col("event_type").isin("click", "error")
    pts = e.where(point).select("obj_id", F.col("event_id").alias("seq"), F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"),
                                (F.col("event_type") != "error").cast("int").alias("label"))
    box = e.where(~point).groupBy("obj_id").agg(
        F.min("value").alias("x0"), F.min(F.col("user_id").cast("double")).alias("y0"), F.max("value").alias("x1"), F.max(F.col("user_id").cast("double")).alias("y1"))
    return pr.assemble_prompts(pts, box).select("obj_id", "position", r6("x"), r6("y"), "label", "x0", "y0", "x1", "y1")


_BOXES = fx.MASK_PIXELS + """, bx AS (SELECT mask_id, CAST(mask_id % 8 AS INT) AS patch_idx, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM mpx GROUP BY ALL)"""


_NMS = """rk AS MATERIALIZED (SELECT mask_id, bx.patch_idx, CAST(area AS DOUBLE) AS score, x0, y0, x1, y1, row_number() OVER (PARTITION BY bx.patch_idx ORDER BY area DESC, mask_id) AS r
  FROM bx JOIN masks USING (mask_id)),
g(patch_idx, r, kept) AS (SELECT DISTINCT patch_idx, CAST(0 AS BIGINT), CAST([] AS STRUCT(m BIGINT, x0 INT, y0 INT, x1 INT, y1 INT)[]) FROM rk
  UNION ALL SELECT g.patch_idx, k.r, CASE WHEN len(list_filter(kept, lambda b: CAST(greatest(0, least(b.x1, k.x1) - greatest(b.x0, k.x0)) * greatest(0, least(b.y1, k.y1) - greatest(b.y0, k.y0)) AS DOUBLE)
      / ((b.x1 - b.x0) * (b.y1 - b.y0) + (k.x1 - k.x0) * (k.y1 - k.y0) - greatest(0, least(b.x1, k.x1) - greatest(b.x0, k.x0)) * greatest(0, least(b.y1, k.y1) - greatest(b.y0, k.y0))) > 0.7)) > 0
    THEN kept ELSE list_append(kept, {'m': k.mask_id, 'x0': k.x0, 'y0': k.y0, 'x1': k.x1, 'y1': k.y1}) END
  FROM g JOIN rk k ON k.patch_idx = g.patch_idx AND k.r = g.r + 1),
kp AS (SELECT patch_idx, unnest(max_by(kept, r)) AS b FROM g GROUP BY patch_idx)"""


@query("box_nms", fx.with_(_BOXES, fx.MASKS, _NMS, recursive=True) + "SELECT mask_id, x0, y0, x1, y1, patch_idx, score FROM rk WHERE (patch_idx, mask_id) IN (SELECT (patch_idx, b.m) FROM kp)")
def _(spark, sf):
    """Boxes of the line item masks per patch, scored by mask size."""
    m = fx.masks(spark, sf).select("mask_id", "patch_idx", F.col("area").cast("double").alias("score"))
    return bx.box_nms(fx.mask_boxes(spark, sf).join(m, "mask_id"), 0.7)


@query("box_iou", fx.with_(_BOXES, """p AS (SELECT a.mask_id, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS i,
  (a.x1 - a.x0) * (a.y1 - a.y0) AS aa, (b.x1 - b.x0) * (b.y1 - b.y0) AS ab FROM bx a JOIN bx b ON b.mask_id = a.mask_id + 8)""") +
       "SELECT mask_id, round(CAST(i AS DOUBLE) / (aa + ab - i), 6) AS iou FROM p")
def _(spark, sf):
    """Overlap of each mask's box with the next one of its patch."""
    b = fx.mask_boxes(spark, sf).select("mask_id", F.struct("x0", "y0", "x1", "y1").alias("a"))
    nxt = b.select((F.col("mask_id") - 8).alias("mask_id"), F.col("a").alias("b"))
    return b.join(nxt, "mask_id").select("mask_id", r6(bx.iou("a", "b"), "iou"))
