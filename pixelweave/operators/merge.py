"""Merging tiles, masks and chips into one map."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.vectors import mean_layers
from ..session import cut_lineage
from .stats import number_rows
from .tiles import pixel_grid

PIXEL = ["scene_id", "y", "x"]


def stitch_mean(chunks: DataFrame, value: str, scenes: DataFrame | None = None) -> DataFrame:
    """Mean of overlapping tile values per pixel; with ``scenes`` given,
    uncovered pixels are added as 0."""
    out = chunks.groupBy(*PIXEL).agg(F.avg(value).alias(value))
    if scenes is None:
        return out
    return pixel_grid(scenes).join(out, PIXEL, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0.0)))


def stitch_mean_vectors(chunks: DataFrame, feature: str) -> DataFrame:
    """Mean feature vector per pixel. A pixel collects one vector per covering
    tile, a number fixed by the tiling, so the list is small by construction."""
    return chunks.groupBy(*PIXEL).agg(F.collect_list(feature).alias("_layers")).select(
        *PIXEL, mean_layers(F.col("_layers")).alias(feature))


def merge_or(chunks: DataFrame) -> DataFrame:
    """Union of tile masks."""
    return chunks.select(*PIXEL).distinct()


def mask_union(*masks: DataFrame) -> DataFrame:
    out = masks[0].select(*PIXEL)
    for m in masks[1:]:
        out = out.unionByName(m.select(*PIXEL))
    return out.distinct()


def mask_difference(mask: DataFrame, other: DataFrame) -> DataFrame:
    return mask.select(*PIXEL).join(other.select(*PIXEL), PIXEL, "left_anti")


def mask_intersection(mask: DataFrame, other: DataFrame) -> DataFrame:
    return mask.select(*PIXEL).join(other.select(*PIXEL), PIXEL, "left_semi")


def stack_features(named: dict[str, DataFrame], cols: Sequence[str]) -> DataFrame:
    """Feature tables under each other with their source name."""
    out = None
    for name, df in named.items():
        part = df.select(F.lit(name).alias("source"), *cols)
        out = part if out is None else out.unionByName(part)
    return out


def mosaic(chips: DataFrame, value: str, order: str, keys: Sequence[str] = ("y", "x"),
           nodata: float | None = None) -> DataFrame:
    """Per pixel the value of the last source in order that has data; NULL (or
    ``nodata``) where none has."""
    valid = F.col(value).isNotNull()
    if nodata is not None:
        valid = valid & (F.col(value) != nodata)
    best = F.max_by(F.col(value), F.when(valid, F.col(order)))
    if nodata is not None:
        best = F.coalesce(best, F.lit(nodata))
    return chips.groupBy(*keys).agg(best.alias(value))


def place_chips(pixels: DataFrame, chips: DataFrame, grid: DataFrame, value: str, method: str = "nearest") -> DataFrame:
    """(chip, y, x, value) of georeferenced chips on one common grid.

    ``chips`` has (chip, transform) and ``grid`` one row (transform, height,
    width); transforms are axis-parallel. ``nearest`` takes the source pixel
    under a target centre, ``average`` weighs source pixels by the area they
    share with the target, ``bilinear`` by their distance to its centre; weights
    of missing pixels are left out. Every source pixel knows the targets it
    feeds, so this is one aggregation, and for ``nearest`` none.
    """
    if method not in ("nearest", "average", "bilinear"):
        raise ValueError(method)
    def scaled(axis: str, start: str, step: str) -> list[Column]:
        return [(F.col(f"_s.{step}") / F.col(f"_t.{step}")).alias(f"_r{axis}"),
                ((F.col(f"_s.{start}") - F.col(f"_t.{start}")) / F.col(f"_t.{step}")).alias(f"_o{axis}")]

    to = grid.select(F.col("transform").alias("_t"), "height", "width")
    laid = chips.select("chip", F.col("transform").alias("_s")).join(F.broadcast(to)).select(      # one row
        "chip", "height", "width", *scaled("y", "f", "e"), *scaled("x", "c", "a"))
    px = pixels.where(F.col(value).isNotNull()).join(laid, "chip")

    def targets(pos: str, size: str) -> Column:
        scale, origin = F.col(f"_r{pos}"), F.col(f"_o{pos}")
        low, high = origin + F.col(pos) * scale, origin + (F.col(pos) + 1) * scale
        if method == "nearest":
            first, last = F.ceil(low - 0.5), F.ceil(high - 0.5) - 1
        elif method == "average":
            first, last = F.floor(low), F.ceil(high) - 1
        else:
            first, last = F.floor(low - scale / 2 - 0.5), F.ceil(high + scale / 2 - 0.5)
        first, last = F.greatest(first, F.lit(0)).cast("int"), F.least(last, F.col(size) - 1).cast("int")

        def weight(j: Column) -> Column:
            if method == "average":
                return F.least(high, j + 1.0) - F.greatest(low, j.cast("double"))
            if method == "bilinear":
                return 1 - F.abs((j + 0.5 - origin) / scale - 0.5 - F.col(pos))
            return F.lit(1.0)

        pairs = F.when(first <= last, F.transform(F.sequence(first, last), lambda j: F.struct(j.alias("j"), weight(j).alias("w"))))
        return F.explode(F.filter(pairs, lambda p: p["w"] > 1e-9))

    fed = px.withColumn("_y", targets("y", "height")).withColumn("_x", targets("x", "width"))
    out = fed.select("chip", F.col("_y.j").alias("y"), F.col("_x.j").alias("x"), (F.col("_y.w") * F.col("_x.w")).alias("_w"), value)
    if method == "nearest":
        return out.drop("_w")
    return out.groupBy("chip", "y", "x").agg((F.sum(F.col("_w") * F.col(value)) / F.sum("_w")).alias(value))


def mosaic_placed(pixels: DataFrame, chips: DataFrame, grid: DataFrame, value: str, method: str = "nearest") -> DataFrame:
    """Mosaic of chips with transforms of their own: (y, x, value), the last
    chip in ``source_order`` with data wins."""
    placed = place_chips(pixels, chips, grid, value, method).join(chips.select("chip", "source_order"), "chip")
    return mosaic(placed, value, "source_order")


def paint_labels(masks: DataFrame, mask_pixels: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """Paint masks in the order (patch, area, mask_id); the first mask to reach
    a pixel keeps it, and only masks that win a pixel get a number from 1.

    A pixel's winner is the least mask in that order, so painting is one
    map-side-combined ``min`` per pixel. Numbering uses the distributed row
    numbering, since one patch may hold most masks. ``bounds`` (scene_id,
    height, width) drops pixels outside the scene.
    """
    scene = [F.lit(0).cast("bigint").alias("scene_id")] if "scene_id" not in mask_pixels.columns else ["scene_id"]
    px = mask_pixels.select(*scene, "mask_id", "y", "x")
    if bounds is not None:
        px = px.join(bounds.select("scene_id", "height", "width"), "scene_id").where(
            (F.col("y") >= 0) & (F.col("x") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") < F.col("width"))
        ).drop("height", "width")
    order = ["patch_idx", "area", "mask_id"]
    ranked = px.join(masks.select(*order), "mask_id")
    # used for numbering and for the result: kept, rather than joined twice
    won = cut_lineage(ranked.groupBy(*PIXEL).agg(F.min(F.struct(*order)).alias("_w")).select(*PIXEL, "_w.*"))
    winners = number_rows(won.select("scene_id", *order).distinct(), order, "label", keys=["scene_id"])
    return won.join(winners.select("scene_id", "mask_id", F.col("label").cast("int").alias("label")),
                    ["scene_id", "mask_id"]).select(*PIXEL, "label", "mask_id")
