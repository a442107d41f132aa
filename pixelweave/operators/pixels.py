"""Scaling, composites and indices over pixel tables.

Bands are plain columns here (``sources.read_pixels`` widens the ``bands``
array right after the scan), so unused bands are pruned.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import scalar as sc
from .stats import exact_quantiles, finite, with_group_stats
from .stencil import TILE, is_whole, on_tiles

KEYS = ("scene_id",)


def normalize_robust(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """clip((v-p1)/(p99-p1+eps), 0, 1) per band and scene; NULL stays NULL."""
    q = exact_quantiles(df, keys, bands, [fv.ROBUST_LOW, fv.ROBUST_HIGH])
    out = with_group_stats(df, q, keys)
    for b in bands:
        lo, hi = F.col(f"{b}_q0"), F.col(f"{b}_q1")
        out = out.withColumn(b, _clip_null((F.col(b) - lo) / (hi - lo + fv.RANGE_EPS), F.col(b)))
    return out.select(*df.columns)


def _clip_null(scaled: Column, source: Column) -> Column:
    # least/greatest skip NULL, so nodata is kept by an explicit test
    return F.when(source.isNotNull(), sc.clip(scaled, 0.0, 1.0))


def stretch_2_98(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """Contrast stretch between the 2nd and 98th percentile. A band without
    spread is divided by its maximum (by 1 when that is 0)."""
    q = exact_quantiles(df, keys, bands, [fv.STRETCH_LOW, fv.STRETCH_HIGH, 1.0])
    out = with_group_stats(df, q, keys)
    for b in bands:
        lo, hi, top = (F.col(f"{b}_q{i}") for i in range(3))
        flat = F.col(b) / F.when(top == 0, 1.0).otherwise(top)
        scaled = F.when(hi <= lo, flat).otherwise((F.col(b) - lo) / F.when(hi > lo, hi - lo))
        out = out.withColumn(b, _clip_null(scaled, F.col(b)))
    return out.select(*df.columns)


def pick_bands(df: DataFrame, indices: Sequence[int], names: Sequence[str]) -> DataFrame:
    """Name 1-based elements of ``bands`` as columns; out of range is an error."""
    keep = [c for c in df.columns if c != "bands"]
    cols = [
        F.when(F.size("bands") >= i, F.try_element_at("bands", F.lit(i)))
        .otherwise(F.raise_error(F.lit(f"band index {i} is out of range")).cast("double")).alias(n)
        if i >= 1 else F.raise_error(F.lit(f"band index {i} is out of range")).cast("double").alias(n)
        for i, n in zip(indices, names)
    ]
    return df.select(*keep, *cols)


def rgb_composite(df: DataFrame, indices: Sequence[int], keys: Sequence[str] = KEYS) -> DataFrame:
    """Three stretched bands c1, c2, c3 from 1-based indices."""
    if len(indices) != 3:
        raise ValueError("a composite needs three band indices")
    return stretch_2_98(pick_bands(df, indices, ["c1", "c2", "c3"]), ["c1", "c2", "c3"], keys)


def rgb_from_order(df: DataFrame, order: Sequence[int] = fv.COMPOSITE_ORDER) -> DataFrame:
    """r, g, b from 0-based positions; one band is repeated, two are refused."""
    keep = [c for c in df.columns if c != "bands"]
    n = F.size("bands")
    return df.select(*keep, *[
        F.when(n >= 3, F.get("bands", F.lit(i))).when(n == 1, F.get("bands", F.lit(0)))
        .otherwise(F.raise_error(F.lit("cannot compose two bands")).cast("double")).alias(c)
        for i, c in zip(order, ("r", "g", "b"))
    ])


def to_uint8(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = KEYS,
             use_percentile: bool = True, is_byte: bool = False) -> DataFrame:
    """Bytes 0..255. Byte data pass through; a scene with maximum <= 1 is
    multiplied by 255; else the 2nd..98th percentile (or min..max) over all
    its bands is spread to 0..255. A scene without spread becomes 0."""
    if is_byte:
        return df
    pooled = df.select(*keys, F.explode(F.array(*[F.col(b).cast("double") for b in bands])).alias("v"))
    if use_percentile:
        stats = exact_quantiles(pooled, keys, ["v"], [fv.STRETCH_LOW, fv.STRETCH_HIGH, 1.0]) \
            .select(*keys, F.col("v_q0").alias("_lo"), F.col("v_q1").alias("_hi"), F.col("v_q2").alias("_top"))
    else:
        v = finite(F.col("v"))
        stats = pooled.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")) \
            .withColumn("_top", F.col("_hi"))
    out = with_group_stats(df, stats, keys)
    lo, hi, top = F.col("_lo"), F.col("_hi"), F.col("_top")
    for b in bands:
        v = F.col(b)
        spread = F.when(hi > lo, sc.clip((v - lo) / F.when(hi > lo, hi - lo) * 255.0, 0.0, 255.0)).otherwise(0.0)
        out = out.withColumn(b, F.when(v.isNotNull(), F.floor(
            F.when(top <= 1.0, v * 255.0).otherwise(spread)).cast("int")))
    return out.select(*df.columns)


def minmax_index(df: DataFrame, raw: Column, name: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Spread a raw index over its scene's range; missing values become 0."""
    tmp = df.withColumn("_raw", raw)
    v = finite(F.col("_raw"))
    stats = tmp.groupBy(*keys).agg(F.min(v).alias("_mn"), F.max(v).alias("_mx"))
    scaled = (F.col("_raw") - F.col("_mn")) / (F.col("_mx") - F.col("_mn") + fv.RANGE_EPS)
    return with_group_stats(tmp, stats, keys).withColumn(name, sc.clean_nan(scaled)) \
        .drop("_raw", "_mn", "_mx")


def excess_green(df: DataFrame, b: str, g: str, r: str, keys: Sequence[str] = KEYS,
                 name: str = "index") -> DataFrame:
    return minmax_index(df, sc.raw_excess_green(F.col(b), F.col(g), F.col(r)), name, keys)


def scale_reflectance(df: DataFrame, bands: Sequence[str], keys: Sequence[str] = KEYS,
                      is_float: bool = True) -> DataFrame:
    """Integer reflectance: unit data times 10000 clipped, other data truncated."""
    def whole(v: Column) -> Column:
        return F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("int")

    if not is_float:
        return df.select(*[whole(F.col(c)).alias(c) if c in bands else F.col(c) for c in df.columns])
    top = F.greatest(*[F.max(finite(F.col(b))) for b in bands]) if len(bands) > 1 \
        else F.max(finite(F.col(bands[0])))
    out = with_group_stats(df, df.groupBy(*keys).agg(top.alias("_top")), keys)
    unit = F.col("_top") <= fv.REFLECTANCE_FLOAT_MAX
    for b in bands:
        v = F.col(b)
        scaled = sc.clip(v * fv.REFLECTANCE_SCALE, 0.0, fv.REFLECTANCE_SCALE)
        out = out.withColumn(b, F.when(v.isNotNull(), whole(F.when(unit, scaled).otherwise(v))))
    return out.select(*df.columns)


def minmax_scale(df: DataFrame, cols: Sequence[str], mode: str = "global",
                 keys: Sequence[str] = (), eps: float = 0.0) -> DataFrame:
    """Spread columns over one common range ('global') or each over its own
    ('component'); ``eps`` is added to the range, or is its least value in
    component mode."""
    lows = {c: F.min(finite(F.col(c))) for c in cols}
    highs = {c: F.max(finite(F.col(c))) for c in cols}
    if mode == "global":
        lo = F.least(*lows.values()) if len(cols) > 1 else lows[cols[0]]
        hi = F.greatest(*highs.values()) if len(cols) > 1 else highs[cols[0]]
        aggs = [lo.alias("_lo"), hi.alias("_hi")]
    elif mode == "component":
        aggs = [a.alias(f"_lo_{c}") for c, a in lows.items()] + [a.alias(f"_hi_{c}") for c, a in highs.items()]
    else:
        raise ValueError(mode)
    if keys:
        out = with_group_stats(df, df.groupBy(*keys).agg(*aggs), keys)
    else:
        # an aggregate without keys is one row
        out = df.withColumn("_one", F.lit(1)).join(
            F.broadcast(df.agg(*aggs).withColumn("_one", F.lit(1))), "_one").drop("_one")
    for c in cols:
        if mode == "global":
            lo, rng = F.col("_lo"), F.col("_hi") - F.col("_lo") + eps
        else:
            lo, rng = F.col(f"_lo_{c}"), F.greatest(F.col(f"_hi_{c}") - F.col(f"_lo_{c}"), F.lit(eps))
        out = out.withColumn(c, (F.col(c) - lo) / F.when(rng > 0, rng))
    return out.select(*df.columns)


def pad_to_multiple(df: DataFrame, scenes: DataFrame, patch: int, bands: Sequence[str]) -> DataFrame:
    """Zero rows at the right and bottom up to the next multiple of ``patch``.
    Only the missing strips are generated; existing rows pass through."""
    h, w = F.col("height"), F.col("width")
    padded = scenes.select("scene_id", "height", "width") \
        .withColumn("_h", (F.ceil(h / patch) * patch).cast("int")) \
        .withColumn("_w", (F.ceil(w / patch) * patch).cast("int"))
    right = padded.where(F.col("_w") > w).withColumn("y", F.explode(F.sequence(F.lit(0), h - 1))) \
        .withColumn("x", F.explode(F.sequence(w, F.col("_w") - 1)))
    below = padded.where(F.col("_h") > h).withColumn("y", F.explode(F.sequence(h, F.col("_h") - 1))) \
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("_w") - 1)))
    zeros = right.unionByName(below).select(
        "scene_id", "y", "x", *[F.lit(0.0).alias(b) for b in bands])
    return df.select("scene_id", "y", "x", *bands).unionByName(zeros)


def blend_overlay(df: DataFrame, mask: DataFrame, bands: Sequence[str], alpha: float,
                  colour: Sequence[int] = fv.OVERLAY_COLOUR) -> DataFrame:
    """Blend a colour into byte bands where the mask has a pixel."""
    hit = mask.select("scene_id", "y", "x", F.lit(True).alias("_hit"))
    out = df.join(hit, ["scene_id", "y", "x"], "left")
    for b, c in zip(bands, colour):
        mixed = F.floor(sc.clip((1.0 - alpha) * F.col(b) + alpha * float(c), 0.0, 255.0)).cast("int")
        out = out.withColumn(b, F.when(F.col("_hit"), mixed).otherwise(F.col(b).cast("int")))
    return out.drop("_hit")


def _hash_colour() -> list[Column]:
    """r, g, b of ``label`` from the first bytes of its md5; label 0 is black."""
    h = F.md5(F.col("label").cast("bigint").cast("string").cast("binary"))
    return [F.when(F.col("label") == 0, 0).otherwise(F.conv(F.substring(h, 2 * i + 1, 2), 16, 10).cast("int") % 255).cast("int").alias(c)
            for i, c in enumerate(("r", "g", "b"))]


def label_colours(labels: DataFrame) -> DataFrame:
    """A colour per label from its hash; label 0 is black."""
    return labels.select("label").distinct().select("label", *_hash_colour())


def colorize_labels(labels: DataFrame, lut: DataFrame | None = None) -> DataFrame:
    """r, g, b per labelled pixel, from a lookup table or, without one, from
    the label's hash (no join at all). Labels missing from the table are black."""
    if lut is None:
        return labels.select("*", *_hash_colour())
    black = [F.coalesce(F.when(F.col("label") != 0, F.col(c)), F.lit(0)).cast("int").alias(c) for c in "rgb"]
    return labels.join(lut.select("label", "r", "g", "b"), "label", "left").select(
        *labels.columns, *black)


def fit_max_edge(scenes: DataFrame, max_edge: int) -> DataFrame:
    """Output size and transform of scenes held under ``max_edge`` pixels."""
    from ..functions.geo import affine_scaled

    longest = F.greatest("width", "height")
    scale = F.when(longest > max_edge, F.lit(float(max_edge)) / longest).otherwise(1.0)
    out = scenes.withColumn("out_height", F.floor(F.col("height") * scale).cast("int")) \
        .withColumn("out_width", F.floor(F.col("width") * scale).cast("int"))
    return out.withColumn("transform", affine_scaled(
        F.col("transform"), F.col("width") / F.col("out_width"), F.col("height") / F.col("out_height")))


def complement(mask: DataFrame, scenes: DataFrame, tile: int = TILE) -> DataFrame:
    """All scene pixels that are not in the mask. Every tile takes part by a mark
    in its corner, so that empty tiles are filled too."""
    def corners(size: str) -> Column:
        return F.explode(F.when(is_whole(tile), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.col(size) - 1).cast("int"), F.lit(tile))))

    sized = scenes.select("scene_id", "height", "width").where((F.col("height") > 0) & (F.col("width") > 0))
    marks = sized.withColumn("y", corners("height")).withColumn("x", corners("width")).select("scene_id", "y", "x", F.lit(False).alias("own"))
    kinds = dict(marks.dtypes)
    own = mask.where((F.col("y") >= 0) & (F.col("x") >= 0)).select(
        F.col("scene_id").cast(kinds["scene_id"]).alias("scene_id"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(True).alias("own"))

    def fn(pdf, y_low, x_low, height, width, sides):
        a = np.zeros(sides, bool)
        set_ = pdf[pdf["own"].to_numpy(bool)]
        a[set_["y"].to_numpy() - y_low, set_["x"].to_numpy() - x_low] = True
        ys, xs = np.nonzero(~a[:height - y_low, :width - x_low])
        return pd.DataFrame({"y": ys + y_low, "x": xs + x_low})

    return on_tiles(marks.unionByName(own), sized, ["own"], 0, fn, "y int, x int", tile)


def above_percentile(df: DataFrame, col: str, percentile: float,
                     keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows strictly above their group's percentile (0..100)."""
    q = exact_quantiles(df, keys, [col], [percentile / 100.0])
    return with_group_stats(df, q, keys).where(F.col(col) > F.col(f"{col}_q0")).select(*df.columns)


def threshold_mask(df: DataFrame, score: Column, threshold: float = 0.0) -> DataFrame:
    return df.where(score > threshold).select("scene_id", "y", "x")


def acquired_between(df: DataFrame, ts: str, start: str, end: str) -> DataFrame:
    """Acquisitions from start to end day, both included."""
    return df.where((F.col(ts) >= F.to_timestamp(F.lit(start)))
                    & (F.col(ts) < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp")))


def nth_acquisition(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The n-th (0-based) acquisition per location."""
    from .stats import top_per_group

    return top_per_group(df, keys, order, n + 1, "_rank").where(F.col("_rank") == n + 1).drop("_rank")


def temporal_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Median over time per location, missing values ignored.

    A location holds one value per acquisition date, so its values fit one
    aggregation buffer: one shuffle.
    """
    v = finite(F.col(value))
    return df.where(v.isNotNull()).groupBy(*keys).agg(F.percentile(v, 0.5).alias("median"))


def ensemble_spread(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("spread"),
                                 F.count(value).alias("runs"))
