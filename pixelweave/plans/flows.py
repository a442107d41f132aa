"""End-to-end flows: crowns, fields, tiled label maps, mosaics and training tiles.

The pretrained networks of such flows are user functions here: a feature or
mask scorer is passed in and runs over tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import scalar as sc
from ..operators import components as cp, features as ft, instances as ins, masks as mk, merge as mg, pixels as po
from ..operators import prompts as pr, regions as rg
from ..operators.stats import number_rows
from ..operators.stencil import TILE
from ..operators.tiles import Grid, assign_tiles, list_tiles
from ..session import cut_lineage

_KEY = ["scene_id", "y", "x"]


def crown_mask(features: DataFrame, scenes: DataFrame, key: str = "pixel_id", feature: str = "feature",
               green: str | None = None, red: str | None = None, min_area: int = 25, max_area: int = 10000,
               probe: tuple[Sequence[Sequence[float]], Sequence[float]] | None = None,
               tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(raw mask, clean mask) from dense features.

    Unsupervised: cluster and pick per scene, clean, and take the complement
    in the scenes where it is the better mask. With ``probe`` (weights and bias
    of a linear probe) class 1 is the mask, and polarity is not in question.
    """
    if probe is not None:
        raw = cut_lineage(ft.linear_probe_predict(features, feature, *probe).where("prediction = 1").select(*_KEY))
        return raw, cut_lineage(cp.clean_tree_mask(raw, scenes, min_area, max_area, tile))
    picked = cut_lineage(ft.segment_unsupervised(features, feature, key, 2, green, red).select(*_KEY))
    other = po.complement(picked, scenes)
    clean = cut_lineage(cp.clean_tree_mask(picked, scenes, min_area, max_area, tile))
    clean_other = cut_lineage(cp.clean_tree_mask(other, scenes, min_area, max_area, tile))
    choice = mk.choose_polarity(cp.connected_components(clean, scenes, 8, tile),
                                cp.connected_components(clean_other, scenes, 8, tile), scenes)
    flip = cut_lineage(choice.where("use_complement").select("scene_id"))
    keep = choice.where(~F.col("use_complement")).select("scene_id")

    def choose(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.join(keep, "scene_id", "left_semi").unionByName(b.join(flip, "scene_id", "left_semi"))

    return cut_lineage(choose(picked, other)), cut_lineage(choose(clean, clean_other))


def crown_regions(raw: DataFrame, clean: DataFrame, scenes: DataFrame, min_area: int = 25,
                  max_area: int = 10000, min_distance: int = 10, tile: int = TILE) -> DataFrame:
    """Region table of split crowns; scenes in which too few are found are relaxed once."""
    def build(some: DataFrame, area: int, dist: int) -> DataFrame:
        mask = clean if area == min_area else cp.clean_tree_mask(raw.join(some, "scene_id", "left_semi"), some, area, max_area, tile)
        labels = cut_lineage(ins.split_instances(mask.join(some.select("scene_id"), "scene_id", "left_semi"), some, dist, tile))
        return rg.region_table(labels, some, area)

    return rg.relax_if_few(build, scenes, min_area, min_distance)


def field_index(px: DataFrame, rgb: Sequence[str], green: str, nir: str) -> DataFrame:
    """Stretched composite, vegetation index and water rule per pixel."""
    raw = px.select(*_KEY, *rgb, F.col(green).alias("_g"), F.col(nir).alias("_n"))
    # the statistics read their input more than once, so stages are kept
    indexed = po.excess_green(cut_lineage(po.stretch_2_98(cut_lineage(raw), rgb)), *rgb)
    water = sc.suppress_water(F.col("index"), sc.ndwi(F.col("_g"), F.col("_n")))
    return indexed.withColumn("index", water).drop("_g", "_n")


def tiles_as_scenes(df: DataFrame, scenes: DataFrame, grid: Grid) -> tuple[DataFrame, DataFrame]:
    """(rows, scenes) with each tile as a scene of its own; the scenes keep the
    way back as scene_id0, y0, x0. Tiles are numbered through all scenes, so ids
    cannot collide however many tiles a scene has."""
    tiles = number_rows(list_tiles(scenes, grid), ["scene_id", "tile_id"], "_sid")
    rows = assign_tiles(df, scenes, grid).join(tiles.select("scene_id", "y0", "x0", "_sid"), ["scene_id", "y0", "x0"])
    keep = [c for c in df.columns if c not in _KEY]
    own = rows.select(F.col("_sid").alias("scene_id"), (F.col("y") - F.col("y0")).alias("y"),
                      (F.col("x") - F.col("x0")).alias("x"), *keep)
    sized = tiles.select(F.col("_sid").alias("scene_id"), (F.col("y1") - F.col("y0")).alias("height"),
                         (F.col("x1") - F.col("x0")).alias("width"), F.col("scene_id").alias("scene_id0"), "y0", "x0")
    return own, sized


def field_mask(index: DataFrame, scenes: DataFrame, grid: Grid | None, percentiles: Sequence[float],
               segment: Callable[[DataFrame, DataFrame, DataFrame], DataFrame], min_area: int,
               max_objects: int = 50, floor_area: int = 250, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(clean mask, coverage). Percentiles and prompts are per tile when a grid
    is given. ``segment(index, objects, fallback)`` returns mask pixels of the
    tiles; overlapping tile masks are united."""
    if grid is None:
        parts, sized = index, scenes.withColumn("scene_id0", F.col("scene_id")).withColumn("y0", F.lit(0)).withColumn("x0", F.lit(0))
    else:
        parts, sized = tiles_as_scenes(index.select(*_KEY, "index"), scenes, grid)
        parts, sized = cut_lineage(parts), cut_lineage(sized)
    objects, fallback = pr.seed_prompts(parts, sized, percentiles, max_objects, min_area, floor_area=floor_area, tile=tile)
    hit = segment(parts, objects, fallback).select(*_KEY)
    back = hit.join(sized.select("scene_id", "scene_id0", "y0", "x0"), "scene_id").select(
        F.col("scene_id0").alias("scene_id"), (F.col("y") + F.col("y0")).cast("int").alias("y"),
        (F.col("x") + F.col("x0")).cast("int").alias("x"))
    clean = cut_lineage(cp.clean_field_mask(cut_lineage(mg.merge_or(back)), scenes, min_area, tile))
    return clean, mk.coverage_pct(clean, scenes)


def box_segmenter(index: DataFrame, objects: DataFrame, fallback: DataFrame) -> DataFrame:
    """A stand-in scorer without a model: index pixels above their scene's mean
    inside prompt boxes; scenes without boxes take all such pixels."""
    mean = index.groupBy("scene_id").agg(F.avg("index").alias("_m"))
    # at most max_objects boxes per scene ride along as one array
    boxes = objects.groupBy("scene_id").agg(
        F.collect_list(F.struct("box_y0", "box_x0", "box_y1", "box_x1")).alias("_b"))
    y, x = F.col("y"), F.col("x")
    inside = F.coalesce(F.exists("_b", lambda b: (y >= b["box_y0"]) & (y < b["box_y1"]) & (x >= b["box_x0"]) & (x < b["box_x1"])), F.lit(True))
    return index.join(mean, "scene_id").join(boxes, "scene_id", "left").where((F.col("index") > F.col("_m")) & inside).select(*_KEY)


def tiled_label_map(masks: DataFrame, mask_pixels: DataFrame, scenes: DataFrame, min_iou: float,
                    min_stability: float, min_area: int) -> DataFrame:
    """Filter proposed masks, paint them, and give colours."""
    kept = mk.filter_masks(masks, min_iou, min_stability, min_area)
    return po.colorize_labels(mg.paint_labels(kept, mask_pixels, scenes))


def training_set(px: DataFrame, chips: DataFrame, scenes: DataFrame, grid: Grid, bands: Sequence[str]) -> DataFrame:
    """Mosaic label chips, align them, cut non-blank tiles, and split."""
    from ..sources.io import training_tiles

    labels = mg.mosaic(chips, "value", "source_order", ["scene_id", "y", "x"]).select(
        *_KEY, F.coalesce(F.col("value"), F.lit(0.0)).cast("bigint").alias("label"))
    both = px.join(labels, _KEY)
    clean = both.select(*_KEY, "label", *[sc.clean_nan(F.col(b)).alias(b) for b in bands])
    tiles = mk.drop_blank_tiles(assign_tiles(clean, scenes, grid), ["scene_id", "y0", "x0"], bands)
    return ft.split_80_20(training_tiles(tiles, bands), "tile_name")
