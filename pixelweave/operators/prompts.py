"""Prompt seeding from an index and assembly of prompt groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..functions.scalar import clean_nan
from ..session import cut_lineage
from .components import connected_components
from .masks import component_stats
from .pixels import above_percentile
from .stats import number_rows, top_per_group
from .stencil import TILE, opening


def topk_prompts(index: DataFrame, positives: int, negatives: int, col: str = "index") -> DataFrame:
    """Points at the highest (label 1) and lowest (label 0) index values per
    scene; equal values by (y, x). Counts are capped by the pixel count."""
    v = index.select("scene_id", "y", "x", F.col(col).alias("v"))
    up = top_per_group(v, ["scene_id"], [F.col("v").desc(), F.col("y"), F.col("x")], positives)
    down = top_per_group(v, ["scene_id"], [F.col("v").asc(), F.col("y"), F.col("x")], negatives)
    return up.withColumn("label", F.lit(1)).unionByName(down.withColumn("label", F.lit(0))).select(
        "scene_id", "label", "rank", "y", "x")


def _objects(candidate: DataFrame, scenes: DataFrame, tile: int) -> DataFrame:
    parts = connected_components(candidate, scenes, 4, tile)
    s = component_stats(parts).join(scenes.select("scene_id", "height", "width"), "scene_id")
    return s.withColumn("cy", (F.col("y0") + F.col("y1") - 1) / 2.0).withColumn(
        "cx", (F.col("x0") + F.col("x1") - 1) / 2.0)


def seed_prompts(index: DataFrame, scenes: DataFrame, percentiles: Sequence[float], max_objects: int,
                 min_area: int, fallback_pos: int = 5, fallback_neg: int = 5, col: str = "index",
                 floor_area: int = fv.MIN_PROMPT_AREA, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(objects, fallback points).

    Percentiles are taken from high to low. At each level the pixels above the
    scene's percentile are opened 3x3, pixels inside boxes of earlier levels
    are removed, and 4-neighbour components become objects, largest first
    (lower label on ties), until a scene has ``max_objects``. Scenes without
    any object get fallback points. Treat tiles as scenes for per-tile
    percentiles.
    """
    base = cut_lineage(index.select("scene_id", "y", "x", clean_nan(F.col(col)).alias("v")))
    floor = max(min_area // fv.PROMPT_AREA_DIVISOR, floor_area)
    margin = F.greatest(F.floor(F.least("height", "width") * fv.BOX_MARGIN_SHARE), F.lit(fv.BOX_MARGIN_MIN)).cast("int")
    out = None
    for level in sorted(percentiles, reverse=True):
        cand = opening(above_percentile(base, "v", level).select("scene_id", "y", "x"), scenes, tile=tile)
        if out is not None:
            # at most max_objects boxes per scene ride along as one array
            seen = out.groupBy("scene_id").agg(
                F.collect_list(F.struct("box_y0", "box_x0", "box_y1", "box_x1")).alias("_b"))
            y, x = F.col("y"), F.col("x")
            cand = cand.join(seen, "scene_id", "left").where(~F.coalesce(F.exists(
                "_b", lambda b: (y >= b["box_y0"]) & (y < b["box_y1"]) & (x >= b["box_x0"]) & (x < b["box_x1"])),
                F.lit(False))).drop("_b")
        found = _objects(cand, scenes, tile).where(F.col("area") >= floor).select(
            "scene_id", F.lit(float(level)).alias("level"), "label", "area", "cx", "cy",
            F.greatest(F.lit(0), F.col("y0") - margin).alias("box_y0"),
            F.greatest(F.lit(0), F.col("x0") - margin).alias("box_x0"),
            F.least(F.col("height"), F.col("y1") + margin).alias("box_y1"),
            F.least(F.col("width"), F.col("x1") + margin).alias("box_x1"))
        found = top_per_group(found, ["scene_id"], [F.col("area").desc(), F.col("label")], max_objects)
        if out is not None:
            taken = out.groupBy("scene_id").agg(F.count("*").cast("int").alias("_t"))
            found = found.join(taken, "scene_id", "left").withColumn(
                "rank", F.col("rank") + F.coalesce("_t", F.lit(0))).where(F.col("rank") <= max_objects).drop("_t")
            found = out.unionByName(found)
        out = cut_lineage(found)
    without = base.join(out.select("scene_id").distinct(), "scene_id", "left_anti")
    return out, topk_prompts(without, fallback_pos, fallback_neg, "v")


def seed_prompts_simple(index: DataFrame, scenes: DataFrame, percentile: float = 92.0,
                        max_objects: int = 50, min_area: int = 250, col: str = "index",
                        tile: int = TILE) -> DataFrame:
    """The interactive variant: one level, area of the bounding box, boxes
    padded by 1 % of the longer side without clipping."""
    base = index.select("scene_id", "y", "x", clean_nan(F.col(col)).alias("v"))
    cand = opening(above_percentile(base, "v", percentile).select("scene_id", "y", "x"), scenes, tile=tile)
    pad = F.greatest(F.floor(F.greatest("height", "width") * fv.BOX_MARGIN_SHARE), F.lit(fv.BOX_MARGIN_MIN)).cast("int")
    boxes = _objects(cand, scenes, tile).where(
        (F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0")) >= min_area).select(
        "scene_id", "label", "area", "cx", "cy", (F.col("x0") - pad).alias("box_x0"), (F.col("y0") - pad).alias("box_y0"),
        (F.col("x1") + pad).alias("box_x1"), (F.col("y1") + pad).alias("box_y1"))
    return top_per_group(boxes, ["scene_id"], [F.col("area").desc(), F.col("label")], max_objects)


def assemble_prompts(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """Ordered prompts per object: (obj_id, position, x, y, label, x0, y0, x1, y1).

    An object with a box but no point gets the box centre as positive point.
    Objects without a box get a zero box if any object has one, else no box.
    One row per point, so an object with very many points is never one value;
    ``pack_prompts`` makes arrays.
    """
    b = boxes.select("obj_id", F.least("x0", "x1").alias("x0"), F.least("y0", "y1").alias("y0"),
                     F.greatest("x0", "x1").alias("x1"), F.greatest("y0", "y1").alias("y1"))
    dummy = b.join(points.select("obj_id").distinct(), "obj_id", "left_anti").select(
        "obj_id", F.lit(0).cast("bigint").alias("seq"), ((F.col("x0") + F.col("x1")) * 0.5).alias("x"),
        ((F.col("y0") + F.col("y1")) * 0.5).alias("y"), F.lit(1).alias("label"))
    pts = points.select("obj_id", F.col("seq").cast("bigint").alias("seq"), F.col("x").cast("double").alias("x"),
                        F.col("y").cast("double").alias("y"), F.col("label").cast("int").alias("label"))
    laid = number_rows(pts.unionByName(dummy), ["seq"], "position", keys=["obj_id"]).drop("seq")
    any_box = b.agg((F.count("*") > 0).alias("_any")).withColumn("_one", F.lit(1))
    full = laid.join(b, "obj_id", "left").withColumn("_one", F.lit(1)).join(F.broadcast(any_box), "_one")
    return full.select("obj_id", "position", "x", "y", "label", *[
        F.coalesce(F.col(c), F.when(F.col("_any"), 0.0)).alias(c) for c in ("x0", "y0", "x1", "y1")])


def pack_prompts(rows: DataFrame) -> DataFrame:
    """Point, label and box arrays per object, for objects of ordinary size."""
    return rows.groupBy("obj_id").agg(
        F.sort_array(F.collect_list(F.struct("position", "x", "y", "label"))).alias("_p"),
        F.first(F.when(F.col("x0").isNotNull(), F.array("x0", "y0", "x1", "y1"))).alias("box")).select(
        "obj_id", F.transform("_p", lambda p: F.array(p["x"], p["y"])).alias("points"),
        F.transform("_p", lambda p: p["label"]).alias("labels"), "box")
