"""Resizing. Every source pixel knows which output pixels it feeds, so nearest
and repeat are explodes without any shuffle, and the interpolating kernels are
an aggregation of weighted contributions along each axis; no output grid is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo
from ..session import cut_lineage
from .tiles import pixel_grid

CUBIC_A = -0.75   # fixed value: cubic convolution parameter

# input tables carry src_h, src_w, dst_h, dst_w: scenes with target sizes


def _sized(df: DataFrame, sizes: DataFrame) -> DataFrame:
    return df.join(sizes.select("scene_id", "src_h", "src_w", "dst_h", "dst_w"), "scene_id")


def _range(lo: Column, hi: Column) -> Column:
    lo, hi = lo.cast("int"), hi.cast("int")
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def resize_nearest(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """Output d shows source floor(d * src / dst)."""
    def fed(pos: str, src: str, dst: str) -> Column:
        p, s, d = F.col(pos), F.col(src), F.col(dst)
        lo = F.ceil(p * d / s)
        hi = F.ceil((p + 1) * d / s) - 1
        return _range(lo, hi)

    keep = [c for c in df.columns if c not in ("y", "x")]
    return (
        _sized(df, sizes)
        .withColumn("_dy", F.explode(fed("y", "src_h", "dst_h")))
        .withColumn("_dx", F.explode(fed("x", "src_w", "dst_w")))
        .select(*keep, F.col("_dy").alias("y"), F.col("_dx").alias("x"))
    )


def _weights(pos: Column, src: Column, dst: Column, kernel: str) -> Column:
    """array<struct<d:int, w:double>> of the outputs fed by a source position."""
    reach = 1 if kernel == "bilinear" else 3
    ratio = dst / src
    lo = F.greatest(F.lit(0), F.floor((pos - reach + 0.5) * ratio - 0.5).cast("int"))
    hi = F.least(dst - 1, F.ceil((pos + reach + 0.5) * ratio - 0.5).cast("int"))
    # an edge source also serves all outputs beyond it
    lo = F.when(pos <= reach - 1, 0).otherwise(lo)
    hi = F.when(pos >= src - reach, dst - 1).otherwise(hi)

    def bilinear(d: Column) -> Column:
        s = F.greatest(F.lit(0.0), F.least((d + 0.5) * src / dst - 0.5, (src - 1).cast("double")))
        return F.greatest(F.lit(0.0), 1.0 - F.abs(s - pos))

    def cubic(d: Column) -> Column:
        s = (d + 0.5) * src / dst - 0.5
        base = F.floor(s)
        t = s - base
        out = F.lit(0.0)
        for k in (-1, 0, 1, 2):
            tap = F.greatest(F.lit(0), F.least(base + k, src - 1))
            u = F.abs(t - k)
            near = ((CUBIC_A + 2) * u - (CUBIC_A + 3)) * u * u + 1
            far = ((CUBIC_A * u - 5 * CUBIC_A) * u + 8 * CUBIC_A) * u - 4 * CUBIC_A
            w = F.when(u <= 1, near).when(u < 2, far).otherwise(0.0)
            out = out + F.when(tap == pos, w).otherwise(0.0)
        return out

    fn = bilinear if kernel == "bilinear" else cubic
    pairs = F.transform(_range(lo, hi), lambda d: F.struct(d.alias("d"), fn(d).alias("w")))
    return F.filter(pairs, lambda p: p["w"] != 0)


def _resize(df: DataFrame, sizes: DataFrame, cols: Sequence[str], kernel: str) -> DataFrame:
    def blend(px: DataFrame, pos: str, src: str, dst: str, keys: Sequence[str]) -> DataFrame:
        """The weighted sums along one axis; NULL unless all weights are there and each has a value."""
        lines = sizes.select(src, dst).where(F.col(src) > 0).distinct().withColumn(pos, F.explode(F.sequence(F.lit(0), (F.col(src) - 1).cast("int"))))
        # a row per position of a line and output that it feeds, not per pixel
        lines = cut_lineage(lines.withColumn("_p", F.explode(_weights(F.col(pos), F.col(src), F.col(dst), kernel))).select(src, dst, pos, "_p.*"))
        w = F.col("w")
        return px.join(lines, [src, dst, pos]).select(*[F.col("d").alias(pos) if k == pos else k for k in keys], w.alias("_w"), *[(w * F.col(c)).alias(c) for c in cols]).groupBy(*keys).agg(*[
            F.when((F.count(c) == F.count("*")) & (F.abs(F.sum("_w") - 1) < 1e-6), F.sum(c)).alias(c) for c in cols])

    down = blend(_sized(df, sizes), "y", "src_h", "dst_h", ["scene_id", "y", "x", "src_w", "dst_w"])
    # the wide table is made where its rows lie, and laid out for work on tiles
    laid = down.repartitionByRange("scene_id", "y")
    return blend(laid, "x", "src_w", "dst_w", ["scene_id", "y", "x"]).sortWithinPartitions("scene_id", "y", "x")


def resize_bilinear(df: DataFrame, sizes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Half-pixel centres, edges clamped. An output is NULL if a source that it
    draws on is NULL or missing."""
    return _resize(df, sizes, cols, "bilinear")


def resize_bicubic(df: DataFrame, sizes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Half-pixel centres, 16 neighbours, edge pixels repeated. An output is NULL
    if a source that it draws on is NULL or missing."""
    return _resize(df, sizes, cols, "bicubic")


def upsample_repeat(df: DataFrame, factor: int) -> DataFrame:
    keep = [c for c in df.columns if c not in ("y", "x")]
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    return df.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps)).select(
        *keep, (F.col("y") * factor + F.col("_dy")).cast("int").alias("y"),
        (F.col("x") * factor + F.col("_dx")).cast("int").alias("x"))


def reproject_nearest(labels: DataFrame, label_scene: DataFrame, target_scenes: DataFrame,
                      value: str = "label", fill=0) -> DataFrame:
    """Labels on the pixel grid of each target scene, nearest source cell.

    ``label_scene`` is the georeference of the label raster (one row: epsg,
    transform); target pixel centres go through longitude and latitude into
    the label raster's projection. Targets outside the raster get ``fill``.
    """
    # the scene list is used twice and may carry long georeference expressions
    target_scenes = cut_lineage(target_scenes.select("scene_id", "height", "width", "epsg", "transform"))
    label_scene = cut_lineage(label_scene.select("epsg", "transform"))
    src = label_scene.select(F.col("epsg").alias("_se"), geo.affine_inverse(F.col("transform")).alias("_inv"),
                             F.lit(1).alias("_one"))
    g = pixel_grid(target_scenes).join(
        target_scenes.select("scene_id", F.col("epsg").alias("_te"), "transform"), "scene_id")
    g = g.withColumn("_one", F.lit(1)).join(F.broadcast(src), "_one")   # one georeference row
    t = F.col("transform")
    g = g.select("scene_id", "y", "x", "_se", "_te", "_inv",
                 geo.map_x(t, F.col("x") + 0.5, F.col("y") + 0.5).alias("_e0"),
                 geo.map_y(t, F.col("x") + 0.5, F.col("y") + 0.5).alias("_n0"))
    g = geo.add_utm(geo.add_latlon(g, "_e0", "_n0", "_te", "_lat", "_lon"), "_lat", "_lon", "_se", "_e1", "_n1")
    same = F.col("_se") == F.col("_te")
    g = g.withColumn("_e", F.when(same, F.col("_e0")).otherwise(F.col("_e1"))) \
        .withColumn("_n", F.when(same, F.col("_n0")).otherwise(F.col("_n1")))
    # The added zero is not deterministic to the optimizer, so join filters stay
    # above this projection; pushed below, each would repeat its whole formula.
    zero = F.monotonically_increasing_id() * 0
    cells = g.select(
        "scene_id", "y", "x",
        (F.floor(geo.map_y(F.col("_inv"), F.col("_e"), F.col("_n"))) + zero).cast("int").alias("_sy"),
        (F.floor(geo.map_x(F.col("_inv"), F.col("_e"), F.col("_n"))) + zero).cast("int").alias("_sx"),
    )
    source = labels.select(F.col("y").alias("_sy"), F.col("x").alias("_sx"), value)
    return cells.join(source, ["_sy", "_sx"], "left").select(
        "scene_id", "y", "x", F.coalesce(F.col(value), F.lit(fill)).alias(value))
