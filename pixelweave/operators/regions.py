"""Region properties, outlines and point layers.

Properties are aggregates. Hulls are merged in levels from hulls of bounded
strips, and outlines are ranked as distributed lists, so no task holds a region.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import geo
from ..session import cut_lineage
from .outlines import outer_rings, simplified
from .packing import spread
from .stencil import CROSS, RING, TILE, find_cells, label_cells, on_tiles, own_cells

REGION = ["scene_id", "label"]
_FAN = 16       # hulls merged into one


def region_props(labels: DataFrame) -> DataFrame:
    """Area, half-open bounds, centroid and eccentricity per region."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    r = labels.groupBy(*REGION).agg(
        F.count("*").alias("area"), F.min("y").alias("min_row"), F.min("x").alias("min_col"),
        (F.max("y") + 1).alias("max_row"), (F.max("x") + 1).alias("max_col"),
        F.avg("y").alias("centroid_row"), F.avg("x").alias("centroid_col"),
        F.var_pop(y).alias("_vy"), F.var_pop(x).alias("_vx"), F.covar_pop(y, x).alias("_vxy"))
    half = F.sqrt((F.col("_vy") - F.col("_vx")) ** 2 + 4 * F.col("_vxy") ** 2)
    major, minor = (F.col("_vy") + F.col("_vx") + half) / 2, (F.col("_vy") + F.col("_vx") - half) / 2
    ecc = F.when(major > 0, F.sqrt(F.greatest(F.lit(0.0), 1 - minor / major))).otherwise(0.0)
    return r.withColumn("eccentricity", ecc).drop("_vy", "_vx", "_vxy")


_NO_LABEL = -(1 << 63)      # stands for NULL inside tiles


def _by_label(px: DataFrame, fn, schema: str) -> DataFrame:
    """``fn`` on tiles of labelled pixels with a ring of one pixel, NULL as a label of its own."""
    kind = dict(px.dtypes)["label"]
    label = F.coalesce(F.col("label").cast("bigint"), F.lit(_NO_LABEL)).alias("label")
    got = on_tiles(px.select("scene_id", "y", "x", label), None, ["label"], 1, fn, f"label bigint, {schema}")
    return got.withColumn("label", F.when(F.col("label") != _NO_LABEL, F.col("label")).cast(kind))


def border(labels: DataFrame) -> DataFrame:
    """Region pixels with a 4-neighbour outside their region; the scene's
    outside counts as such."""
    def fn(pdf, y_low, x_low, height, width, sides):
        names, code, count, area, span = label_cells(pdf, y_low, x_low, sides)
        n = count.copy()
        own = own_cells(code, area, span, sides)
        for dy, dx in CROSS:
            at = find_cells(code, code + dy * span + dx)
            n += np.where(at >= 0, count[at], 0)
        edge = code[own & (n < 5)]
        return pd.DataFrame({"label": names[edge // area], "y": edge % area // span + y_low - 1, "x": edge % span + x_low - 1})

    return _by_label(labels, fn, "y int, x int").select("scene_id", "label", "y", "x")


def region_perimeter(labels: DataFrame, edge: DataFrame | None = None) -> DataFrame:
    """Perimeter: border pixels weighted by the pattern of their border
    neighbours (1 for itself, 2 per side, 10 per corner). ``edge`` is the
    regions' border where it is known."""
    weight = np.zeros(1 + 2 * 4 + 10 * 4 + 1)
    weight[list(fv.PERIMETER_WEIGHTS)] = list(fv.PERIMETER_WEIGHTS.values())

    def fn(pdf, y_low, x_low, height, width, sides):
        names, code, _, area, span = label_cells(pdf, y_low, x_low, sides)
        own = code[own_cells(code, area, span, sides)]
        pattern = np.ones(len(own), np.int64)
        for dy, dx in RING:
            pattern += np.where(find_cells(code, own + dy * span + dx) >= 0, 10 if dy and dx else 2, 0)
        total = np.bincount(own // area, weight[pattern], len(names))
        some = np.unique(own // area)
        return pd.DataFrame({"label": names[some], "perimeter": total[some]})

    parts = _by_label(border(labels) if edge is None else edge, fn, "perimeter double")
    return parts.groupBy(*REGION).agg(F.sum("perimeter").alias("perimeter"))


def _cross(o, a, b) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Monotone chain; counter-clockwise, without collinear points."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts)
    chains = []
    for seq in (pts, pts[::-1]):
        chain: list = []
        for p in seq:
            while len(chain) > 1 and _cross(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def diamond_points(rows: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Corners of the pixel diamonds at the ends of rows."""
    return np.concatenate([
        np.stack([lows - 0.5, rows], 1), np.stack([highs + 0.5, rows], 1),
        np.stack([lows, rows - 0.5], 1), np.stack([lows, rows + 0.5], 1),
        np.stack([highs, rows - 0.5], 1), np.stack([highs, rows + 0.5], 1)])


def hull_row_pixels(hull: np.ndarray, low: int, high: int) -> int:
    """Whole positions in a hull (x, y) on the rows low to high."""
    if high < low:
        return 0
    nxt, y = np.roll(hull, -1, axis=0), np.arange(low, high + 1)[:, None]
    y0, y1, a, b = hull[:, 1], nxt[:, 1], hull[:, 0], nxt[:, 0]
    hit, flat = (np.minimum(y0, y1) <= y) & (np.maximum(y0, y1) >= y), y0 == y1
    at = np.where(flat, a, a + (y - y0) / np.where(flat, 1.0, y1 - y0) * (b - a))
    left = np.where(hit, np.where(flat, np.minimum(a, b), at), np.inf).min(1)
    right = np.where(hit, np.where(flat, np.maximum(a, b), at), -np.inf).max(1)
    return int((np.floor(right + 1e-9) - np.ceil(left - 1e-9) + 1).sum())


def region_solidity(labels: DataFrame, strip: int = 256) -> DataFrame:
    """Area over convex area, by merged hulls.

    Only the row ends of a region decide its hull. Strips of ``strip`` rows give
    a hull each; hulls of ``_FAN`` neighbouring strips become one, level by level,
    so a task holds the ends of a strip's rows or the corners of a few hulls
    (few, as corners lie on a grid). The positions inside are counted strip by
    strip from the corners.
    """
    kinds = dict(labels.dtypes)
    spans = labels.groupBy(*REGION, "y").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    kind = f"scene_id {kinds['scene_id']}, label {kinds['label']}, strip bigint, area bigint, xs array<double>, ys array<double>"

    def hulls_of(points):
        """A hull per row of point lists."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = [convex_hull(points(*(np.asarray(v, float) for v in row)))
                       for row in zip(*(b.column(c).to_pylist() for c in b.schema.names[4:]), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array([h[:, i] for h in got], pa.list_(pa.float64())) for i in (0, 1))],
                                                 names=[*REGION, "strip", "area", "xs", "ys"])
        return run

    # the row ends of a strip; the corners of _FAN strips
    rows = spans.groupBy(*REGION, F.floor(F.col("y") / strip).alias("strip")).agg(
        F.sum("n").alias("area"), F.collect_list(F.struct("y", "lo", "hi")).alias("r")).select(
        *REGION, "strip", "area", *[F.col(f"r.{c}").alias(c) for c in ("y", "lo", "hi")])
    hulls = cut_lineage(spread(rows, *REGION, "strip").mapInArrow(hulls_of(diamond_points), kind))
    high, low = hulls.agg(F.max("strip"), F.min("strip")).first()
    while high is not None and (high > 0 or low < 0):
        met = hulls.groupBy(*REGION, F.floor(F.col("strip") / _FAN).alias("strip")).agg(
            F.sum("area").alias("area"), F.collect_list(F.struct("xs", "ys")).alias("h")).select(
            *REGION, "strip", "area", *[F.flatten(f"h.{c}").alias(c) for c in ("xs", "ys")])
        hulls = cut_lineage(spread(met, *REGION, "strip").mapInArrow(hulls_of(lambda x, y: np.stack([x, y], 1)), kind), hulls)
        high, low = high // _FAN, (low // _FAN if low < -1 else 0)

    def count(batches):
        for pdf in batches:
            n = [hull_row_pixels(np.stack([x, y], 1), max(int(math.ceil(min(y))), a), min(int(math.floor(max(y))), a + strip - 1))
                 for x, y, a in zip(pdf["xs"], pdf["ys"], pdf["from"], strict=True)]
            yield pd.DataFrame({"scene_id": pdf["scene_id"], "label": pdf["label"], "n": n})

    low, high = F.ceil(F.array_min("ys")), F.floor(F.array_max("ys"))
    strips = hulls.select(*REGION, "xs", "ys", F.explode(F.sequence(low, high, F.lit(strip).cast("bigint"))).alias("from"))
    convex = strips.mapInPandas(
        count, f"scene_id {kinds['scene_id']}, label {kinds['label']}, n bigint").groupBy(*REGION).agg(F.sum("n").alias("convex_area"))
    return hulls.select(*REGION, "area").join(convex, REGION).withColumn("solidity", F.col("area") / F.col("convex_area"))


def polygonize(labels: DataFrame, scenes: DataFrame, min_area: int = 25, tile: int = TILE, edge: DataFrame | None = None) -> DataFrame:
    """Simplified outer outline per region in map coordinates.

    The outer border of largest area, of the region's 8-neighbour parts, is
    simplified to 1 % of its length; rings under three points are dropped.
    Columns: scene_id, label, area, ring, wkt. Borders are ranked and simplified
    as distributed lists; only a region's kept points meet in a row. ``edge`` is
    the regions' border where it is known.
    """
    area = labels.groupBy(*REGION).agg(F.count("*").alias("area")).where(F.col("area") >= min_area)
    if edge is None:
        edge = border(labels.join(area.select(*REGION), REGION, "left_semi"))
    else:
        edge = edge.join(area.select(*REGION), REGION, "left_semi")

    kept = simplified(outer_rings(edge, scenes, tile), fv.OUTLINE_TOLERANCE)
    # the kept points are the result's own row
    rings = kept.groupBy(*REGION).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("rank", "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("_ring")).where(
        F.size("_ring") >= 3)
    placed = rings.join(area, REGION).join(scenes.select("scene_id", "transform"), "scene_id")
    t = F.struct("transform", "_ring")
    ring = F.transform(F.array(t), lambda s: F.transform(s["_ring"], lambda p: F.struct(
        geo.map_x(s["transform"], p["x"], p["y"]).alias("x"),
        geo.map_y(s["transform"], p["x"], p["y"]).alias("y"))))[0]
    out = placed.withColumn("ring", ring)
    text = F.transform(F.concat("ring", F.slice("ring", 1, 1)), lambda p: F.concat_ws(" ", p["x"], p["y"]))
    return out.select("scene_id", "label", "area", "ring",
                      F.concat(F.lit("POLYGON (("), F.array_join(text, ", "), F.lit("))")).alias("wkt"))


def bbox_polygons(regions: DataFrame, scenes: DataFrame) -> DataFrame:
    """Corner coordinates of the bounding boxes as one row per region."""
    t = F.col("transform")
    r = regions.join(scenes.select("scene_id", "transform"), "scene_id")
    cols: list[Column] = []
    corners = (("min_col", "min_row"), ("min_col", "max_row"), ("max_col", "max_row"), ("max_col", "min_row"))
    for i, (c, w) in enumerate(corners, 1):
        cols += [geo.map_x(t, F.col(c), F.col(w)).alias(f"x{i}"), geo.map_y(t, F.col(c), F.col(w)).alias(f"y{i}")]
    return r.select("scene_id", "label", "area", *cols)


def region_points(regions: DataFrame, scenes: DataFrame) -> DataFrame:
    """Centroids in map coordinates."""
    t = F.col("transform")
    r = regions.join(scenes.select("scene_id", "transform"), "scene_id")
    return r.select("scene_id", "label", "area",
                    geo.map_x(t, F.col("centroid_col"), F.col("centroid_row")).alias("px"),
                    geo.map_y(t, F.col("centroid_col"), F.col("centroid_row")).alias("py"))


def region_table(labels: DataFrame, scenes: DataFrame, min_area: int = 25) -> DataFrame:
    """The full region table: properties, perimeter, solidity, outline."""
    props = region_props(labels).where(F.col("area") >= min_area)
    pts = region_points(props, scenes).drop("area")
    edge = cut_lineage(border(labels))
    return (
        props.join(pts, REGION).join(region_perimeter(labels, edge), REGION)
        .join(region_solidity(labels).select(*REGION, "solidity"), REGION)
        .join(polygonize(labels, scenes, min_area, edge=edge).select(*REGION, "ring", "wkt"), REGION)
    )


def relax_if_few(build, scenes: DataFrame, min_area: int, min_distance: int) -> DataFrame:
    """Retry the scenes with fewer than five regions under half the limits.

    ``build(scenes, min_area, min_distance)`` returns the region table of the
    given scenes. A limit is halved down to its floor. Per scene the retry is
    kept only if it finds more regions; the decision is a join of counts.
    """
    def counted(table: DataFrame, name: str) -> DataFrame:
        n = table.groupBy("scene_id").agg(F.count("*").alias(name))
        return scenes.select("scene_id").join(n, "scene_id", "left").select("scene_id", F.coalesce(name, F.lit(0)).alias(name))

    first = cut_lineage(build(scenes, min_area, min_distance))
    few = cut_lineage(counted(first, "n").where(F.col("n") < fv.FEW_REGIONS))
    second = cut_lineage(build(scenes.join(few, "scene_id", "left_semi"), max(fv.RELAXED_AREA_FLOOR, min_area // 2),
                               max(fv.RELAXED_DISTANCE_FLOOR, min_distance // 2)))
    better = few.join(counted(second, "more"), "scene_id").where(F.col("more") > F.col("n")).select("scene_id")
    return first.join(better, "scene_id", "left_anti").unionByName(second.join(better, "scene_id", "left_semi"))
