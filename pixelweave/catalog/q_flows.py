"""End-to-end flows."""

from pyspark.sql import functions as F

from ..operators import components as cp, instances as ins, masks as mk, pixels as po, regions as rg, resample as rs
from ..operators.tiles import tile_shifted, tile_snapped
from ..plans import flows
from ..session import cut_lineage
from . import fixtures as fx, q_aggregate  # noqa: F401  (its SQL is composed here)
from .q_iterative import _N4, _N8, _PEAKS, _TREE, _parts, _scenes
from .registry import ORACLES, query, r6

_KEY = ["scene_id", "y", "x"]
_TILE = 32


def _dense_features(spark, sf):
    """(features, scenes): a coarse token grid of each scene brought to pixels
    by bilinear resizing, as dense features are."""
    base = _scenes(spark, sf)

    def sizes(from_h, from_w, to_h, to_w):
        return base.select("scene_id", from_h.alias("src_h"), from_w.alias("src_w"), F.lit(to_h).alias("dst_h"), F.lit(to_w).alias("dst_w"))

    px = po.normalize_robust(fx.pixels(spark, sf), ["b1", "b2"])
    coarse = rs.resize_bilinear(px, sizes(F.col("height"), F.col("width"), 10, 34), ["b1", "b2"])
    fine = rs.resize_bilinear(cut_lineage(coarse), sizes(F.lit(10), F.lit(34), 60, 204), ["b1", "b2"])
    feats = fine.select(*_KEY, (F.col("scene_id") * 10000000 + F.col("y") * 1000 + F.col("x")).alias("pixel_id"),
                        F.array("b1", "b2").alias("feature"), F.col("b1").alias("g"), F.col("b2").alias("r"))
    return cut_lineage(feats), cut_lineage(base.withColumn("height", F.lit(60)).withColumn("width", F.lit(204)))


@query("crown_flow")
def _(spark, sf):
    """Dense features, clustered into crowns, cleaned, split and measured."""
    feats, sc = _dense_features(spark, sf)
    raw, clean = flows.crown_mask(feats, sc, green="g", red="r", min_area=9, tile=64)
    got = flows.crown_regions(raw, clean, sc, min_area=9, min_distance=3, tile=64)
    return got.select("scene_id", "label", "area", r6("perimeter", digits=4), r6("eccentricity", digits=4), r6("solidity"), "wkt")


_PROBED = "m AS (SELECT scene_id, y, x FROM px WHERE b1 / 500000.0 - 0.76 > 0)"


@query("crown_flow_linear", fx.with_(fx.PX, fx.SCENES, _PROBED, *_TREE, _parts("s4", "p4", _N4),
    "k4 AS MATERIALIZED (SELECT scene_id, y, x FROM p4 WHERE (scene_id, label) IN (SELECT (scene_id, label) FROM p4 GROUP BY ALL HAVING count(*) >= 12))",
    _parts("k4", "p8", _N8), recursive=True) + """SELECT scene_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM p8 JOIN
  (SELECT scene_id, label FROM p8 GROUP BY ALL HAVING count(*) <= 60) USING (scene_id, label)""")
def _(spark, sf):
    """Crown mask from a linear probe on two features; polarity is not in question."""
    feats = fx.pixels(spark, sf).select(*_KEY, F.array(F.col("b1") / 500000.0, F.col("b2") / 1500.0).alias("feature"))
    _, clean = flows.crown_mask(feats, _scenes(spark, sf), min_area=12, max_area=60,
                                probe=([[0.0, 0.0], [1.0, 0.0]], [0.0, -0.76]), tile=_TILE)
    return clean


@query("field_flow")
def _(spark, sf):
    """Index per scene, prompts per tile, union of tile masks, clean-up."""
    sc = cut_lineage(fx.scenes(spark, sf))
    idx = cut_lineage(flows.field_index(fx.pixels(spark, sf, lines=True), ["b1", "b2", "b3"], "b4", "b8").select(*_KEY, "index"))
    _, cover = flows.field_mask(idx, sc, tile_snapped(24, 6), [40.0, 30.0], flows.box_segmenter, 12, floor_area=9, tile=_TILE)
    return cover.select("scene_id", r6("coverage_pct"))


@query("tiled_label_flow", fx.with_(fx.MASKS, fx.MASK_PIXELS, """p AS (SELECT mpx.*, patch_idx, area FROM mpx JOIN masks USING (mask_id)
  WHERE predicted_iou >= 0.4 AND stability_score >= 0.955 AND area >= 20),
w AS (SELECT y, x, mask_id, patch_idx, area, row_number() OVER (PARTITION BY y, x ORDER BY patch_idx, area, mask_id) AS r FROM p),
ids AS (SELECT mask_id, row_number() OVER (ORDER BY patch_idx, area, mask_id) AS label FROM (SELECT DISTINCT mask_id, patch_idx, area FROM w WHERE r = 1))""") +
       "SELECT y, x, CAST(label AS INT) AS label FROM w JOIN ids USING (mask_id) WHERE r = 1")
def _(spark, sf):
    got = flows.tiled_label_map(fx.masks(spark, sf), fx.mask_pixels(spark, sf), fx.scenes(spark, sf, multi=False), 0.4, 0.955, 20)
    return got.select("y", "x", "label")


_TRAIN = """lab AS (SELECT CAST(y // 30 AS BIGINT) AS scene_id, CAST(y % 30 AS INT) AS y, x, max_by(value, CASE WHEN value IS NOT NULL THEN source_order END) AS label FROM chips GROUP BY ALL),
both_ AS (SELECT px.scene_id, px.y, px.x, b1, b2 FROM px JOIN lab USING (scene_id, y, x)),
tl AS (SELECT b.*, CAST(least((b.y // 16) * 16, greatest(0, height - 16)) AS INT) AS ya, CAST(greatest(0, height - 16) AS INT) AS yb,
  CAST((b.x // 16) * 16 AS INT) AS xa, CAST(width - 16 AS INT) AS xb FROM both_ b JOIN scenes USING (scene_id)),
ty AS (SELECT scene_id, y, x, xa, xb, unnest(list_distinct(list_filter([ya, yb], lambda s: s <= y AND y < s + 16))) AS y0 FROM tl),
tp AS (SELECT scene_id, y, x, y0, unnest(list_distinct(list_filter([least(xa, xb), xb], lambda s: s <= x AND x < s + 16))) AS x0 FROM ty),
tt AS (SELECT 'scene' || scene_id || '_y' || y0 || '_x' || x0 AS tile_name, min({'y': y, 'x': x}) AS a, max({'y': y, 'x': x}) AS b, CAST(count(*) AS INT) AS n FROM tp GROUP BY scene_id, y0, x0)"""


@query("training_flow", fx.with_(fx.PX, fx.SCENES, fx.CHIPS, _TRAIN) + f"""SELECT tile_name, b.y - a.y + 1 AS height, b.x - a.x + 1 AS width, n,
  CASE WHEN {fx.hash_sql('tile_name')} % 100 < 80 THEN 'train' ELSE 'val' END AS part FROM tt""")
def _(spark, sf):
    chips = fx.chips(spark, sf).withColumn("scene_id", F.floor(F.col("y") / 30)).withColumn("y", F.col("y") % 30)
    t = flows.training_set(fx.pixels(spark, sf), chips, fx.scenes(spark, sf), tile_shifted(16), ["b1", "b2"])
    return t.select("tile_name", "height", "width", F.size("label").alias("n"), "part")


_RELAX = """st AS MATERIALIZED (SELECT scene_id, label, count(*) AS area FROM c GROUP BY ALL),
n AS (SELECT scene_id, count(*) FILTER (WHERE area >= 22) AS a, count(*) FILTER (WHERE area >= 11) AS b FROM st GROUP BY scene_id)"""


@query("relax_if_few", fx.with_(fx.PX, fx.SCENES, fx.SPARSE, _parts("m", "c", _N8), _RELAX, recursive=True) +
       "SELECT scene_id, label, area FROM st JOIN n USING (scene_id) WHERE area >= CASE WHEN a < 5 AND b > a THEN 11 ELSE 22 END")
def _(spark, sf):
    """Regions of the sparse mask under limits that are halved when fewer than
    five regions pass."""
    sc = cut_lineage(fx.scenes(spark, sf))
    labels = cut_lineage(cp.connected_components(fx.sparse_mask(spark, sf), sc, 8, _TILE))
    stats = mk.component_stats(labels)
    return rg.relax_if_few(lambda some, area, dist: stats.join(some.select("scene_id"), "scene_id", "left_semi").where(F.col("area") >= area), sc, 22, 10).select("scene_id", "label", "area")


_TABLE = " JOIN ".join(f"({ORACLES[n]}) t{i}" + (" USING (scene_id, label)" if i else "") for i, n in enumerate(
    ("region_props", "region_points", "region_perimeter", "region_solidity", "polygonize")))


@query("region_table", f"SELECT scene_id, label, t0.area AS area, px, py, perimeter, eccentricity, solidity, true AS outlined FROM {_TABLE} WHERE t0.area >= 10")
def _(spark, sf):
    """All region measures side by side; the SQL joins those of the single queries."""
    got = rg.region_table(fx.block_regions(spark, sf), fx.scenes(spark, sf), 10)
    return got.select("scene_id", "label", "area", r6("px", digits=4), r6("py", digits=4), r6("perimeter", digits=5),
                      r6("eccentricity", digits=5), r6("solidity"), (F.size("ring") >= 3).alias("outlined"))


@query("marker_watershed", fx.with_(fx.PX, fx.SCENES, "v AS MATERIALIZED (SELECT scene_id, y, x, CAST(b2 AS BIGINT) + 1 AS v FROM px)", _PEAKS, recursive=True) +
       """SELECT scene_id, count(*) AS pixels, any_value(n) AS markers, any_value(n) AS kept, any_value(n) AS labels, true AS downhill FROM px
  JOIN (SELECT scene_id, count(*) AS n FROM pk GROUP BY scene_id) USING (scene_id) GROUP BY scene_id""")
def _(spark, sf):
    """Band 2 as heights, its peaks as markers, over the whole scene: every
    pixel is labelled, every marker keeps its label, and a pixel below a higher
    neighbour shares the label of its highest one."""
    from ..operators.stats import number_rows
    from ..operators.stencil import CROSS, local_peaks, neighbors

    sc = cut_lineage(fx.scenes(spark, sf))
    h = cut_lineage(fx.pixels(spark, sf).select(*_KEY, (F.col("b2").cast("bigint") + 1).alias("d2")))
    markers = number_rows(local_peaks(h, sc, 3, tile=_TILE), ["y", "x"], "label", keys=["scene_id"])
    got = cut_lineage(ins.marker_watershed(h, markers, sc))
    per = got.groupBy("scene_id").agg(F.count("*").alias("pixels"), F.count_distinct("label").alias("labels"))
    kept = markers.withColumnRenamed("label", "own").join(got, _KEY, "left").groupBy("scene_id").agg(
        F.count("*").alias("markers"), F.count_if(F.col("own") == F.col("label")).alias("kept"))
    both = got.join(h, _KEY).withColumn("s", F.struct("d2", (-(F.col("y") * 100 + F.col("x"))).alias("k"), "label"))
    up = neighbors(both, CROSS, "s").groupBy(*_KEY).agg(F.max("neighbor").alias("up"))
    down = up.join(both, _KEY).join(markers.select(*_KEY), _KEY, "left_anti").groupBy("scene_id").agg(
        F.bool_and((F.col("up.d2") <= F.col("d2")) | (F.col("up.label") == F.col("label"))).alias("downhill"))
    return per.join(kept, "scene_id").join(down, "scene_id").select("scene_id", "pixels", "markers", "kept", "labels", "downhill")
