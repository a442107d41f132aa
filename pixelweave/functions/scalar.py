"""Per-pixel scalar expressions. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv


def clip(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def clean_nan(v: Column) -> Column:
    """NULL, NaN and infinities become 0."""
    d = v.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (F.abs(d) == float("inf")), 0.0).otherwise(d)


def mask_nodata(v: Column, nodata) -> Column:
    """NULL where the value equals the scene's nodata value."""
    nd = nodata if isinstance(nodata, Column) else F.lit(nodata)
    return F.when(v == nd, None).otherwise(v)


def quantize8(v: Column) -> Column:
    """A [0,1] value as byte 0..255 by truncation."""
    return F.floor(v * 255.0).cast("int")


def raw_excess_green(b: Column, g: Column, r: Column) -> Column:
    return 2.0 * g - r - b


def ndwi(green: Column, nir: Column) -> Column:
    return (green - nir) / (green + nir + F.lit(fv.RANGE_EPS))


def suppress_water(index: Column, water: Column, threshold: float = fv.WATER_THRESHOLD) -> Column:
    """The index, or the water value where the water index is above the threshold."""
    return F.when(water > threshold, F.lit(fv.WATER_VALUE)).otherwise(index)


def display_scale(v: Column) -> Column:
    return clip(v * fv.DISPLAY_GAIN, fv.DISPLAY_MIN, fv.DISPLAY_MAX)


def unscale_reflectance(v: Column) -> Column:
    return v / fv.REFLECTANCE_SCALE


def infer_layout(shape: Column) -> Column:
    """'HW', 'CHW' or 'HWC' from a shape array: channels come first when the
    first length is below the last."""
    return (
        F.when(F.size(shape) == 2, "HW")
        .when((F.size(shape) == 3) & (shape[0] < shape[2]), "CHW")
        .when(F.size(shape) == 3, "HWC")
        .otherwise(F.raise_error(F.lit("expected two or three dimensions")))
    )


def infer_layout_strict(shape: Column) -> Column:
    """The stricter rule of the large-scene loader: more than three channels
    last, more than three and fewer than twenty first, at most three last."""
    h, w, c = shape[0], shape[1], shape[2]
    return (
        F.when(F.size(shape) == 2, "HW")
        .when((F.size(shape) == 3) & (c > 3) & (c < h), "HWC")
        .when((F.size(shape) == 3) & (h > 3) & (h < 20) & (h < w), "CHW")
        .when((F.size(shape) == 3) & (c <= 3), "HWC")
        .otherwise(F.raise_error(F.lit("unexpected image shape")))
    )


def fetch_ok(msg: Column) -> Column:
    return msg.contains("DONE") | msg.contains("SKIP")


def response_ok(status: Column, content_type: Column) -> Column:
    """A map response counts only with status 200 and an image body."""
    return (status == 200) & F.coalesce(content_type.startswith("image/"), F.lit(False))
