"""Filters and counts over masks, label maps and mask tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .. import fixed_values as fv
from ..session import cut_lineage

REGION = ["scene_id", "label"]


def _sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy(*REGION).agg(F.count("*").alias("area"))


def keep_min_area(labels: DataFrame, min_area: int) -> DataFrame:
    """Pixels of components with at least ``min_area`` pixels."""
    keep = cut_lineage(_sizes(labels).where(F.col("area") >= min_area).select(*REGION))      # seen small by the join
    return labels.join(keep, REGION, "left_semi")


def keep_area_range(labels: DataFrame, min_area: int, max_area: int) -> DataFrame:
    """Drop components below ``min_area`` or above ``max_area``."""
    keep = cut_lineage(_sizes(labels).where(F.col("area").between(min_area, max_area)).select(*REGION))
    return labels.join(keep, REGION, "left_semi")


def filter_regions(regions: DataFrame, min_area: int, ring: str | None = None) -> DataFrame:
    out = regions.where(F.col("area") >= min_area)
    return out.where(F.size(ring) >= 3) if ring else out


def filter_masks(masks: DataFrame, min_iou: float = 0.5, min_stability: float = 0.92,
                 min_area: int = 1000) -> DataFrame:
    return masks.where((F.col("predicted_iou") >= min_iou) & (F.col("stability_score") >= min_stability)
                       & (F.col("area") >= min_area))


def drop_blank_tiles(tile_pixels: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Drop tiles whose maximum is 0. NaN sorts above all numbers, so a tile
    with NaN is kept."""
    top = F.greatest(*[F.max(b) for b in bands]) if len(bands) > 1 else F.max(bands[0])
    keep = tile_pixels.groupBy(*keys).agg(top.alias("_top")).where(F.col("_top") != 0).select(*keys)
    return tile_pixels.join(keep, list(keys), "left_semi")


def component_stats(labels: DataFrame) -> DataFrame:
    """Area and half-open bounds per component."""
    return labels.groupBy(*REGION).agg(
        F.count("*").alias("area"), F.min("y").alias("y0"), F.min("x").alias("x0"),
        (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1"))


def coverage_pct(mask: DataFrame, scenes: DataFrame) -> DataFrame:
    n = mask.groupBy("scene_id").agg(F.count("*").alias("_n"))
    total = F.col("height").cast("double") * F.col("width")
    return scenes.select("scene_id", "height", "width").join(n, "scene_id", "left").select(
        "scene_id", (F.coalesce(F.col("_n"), F.lit(0)) / total * 100.0).alias("coverage_pct"))


def count_segments(labels: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct labels per scene without background."""
    fn = F.approx_count_distinct if approximate else F.count_distinct
    return labels.where(F.col("label") != 0).groupBy("scene_id").agg(fn("label").alias("segments"))


def best_masks(masks: DataFrame, mask_pixels: DataFrame, object_key: str = "obj_id",
               score: str = "score", index: str = "mask_idx") -> DataFrame:
    """Per object the mask with the best score (lowest index on ties), united."""
    best = masks.groupBy(object_key).agg(
        F.max_by(F.col(index), F.struct(F.col(score), -F.col(index))).alias(index))
    hit = mask_pixels.join(best, [object_key, index], "left_semi")
    return hit.select("scene_id", "y", "x").distinct()


def block_majority(labels: DataFrame, size: int, scenes: DataFrame, label: str = "label") -> DataFrame:
    """0/1 label per size x size block, strictly more than half; a remainder
    at the right and bottom is cut off. ``labels`` holds every pixel."""
    sized = labels.join(scenes.select("scene_id", "height", "width"), "scene_id")
    inside = sized.where((F.col("y") < F.floor(F.col("height") / size) * size)
                         & (F.col("x") < F.floor(F.col("width") / size) * size))
    return inside.groupBy(
        "scene_id", F.floor(F.col("y") / size).cast("int").alias("by"),
        F.floor(F.col("x") / size).cast("int").alias("bx"),
    ).agg((F.avg(label) > fv.BLOCK_MAJORITY).cast("int").alias("label"))


def region_stats_total(labels: DataFrame) -> DataFrame:
    """Pixels and components per scene."""
    return labels.groupBy("scene_id").agg(
        F.count("*").alias("pixels"), F.count_distinct("label").alias("components"))


def choose_polarity(mask_labels: DataFrame, alternative_labels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Per scene whether the complement wins: more pixels or more components."""
    a = region_stats_total(mask_labels).select("scene_id", F.col("pixels").alias("pixels"),
                                               F.col("components").alias("components"))
    b = region_stats_total(alternative_labels).select(
        "scene_id", F.col("pixels").alias("alt_pixels"), F.col("components").alias("alt_components"))
    cols = ["pixels", "components", "alt_pixels", "alt_components"]
    joined = scenes.select("scene_id").join(a, "scene_id", "left").join(b, "scene_id", "left").na.fill(0, cols)
    return joined.withColumn("use_complement", (F.col("alt_pixels") > F.col("pixels"))
                             | (F.col("alt_components") > F.col("components")))


def timing_summary(timings: DataFrame) -> DataFrame:
    return timings.groupBy("name").agg(
        F.sum("seconds").alias("total"), F.count("*").alias("calls"), F.avg("seconds").alias("mean"))


def shift_summary(points: DataFrame) -> DataFrame:
    return points.agg(F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"),
                      F.count("*").alias("points"))
