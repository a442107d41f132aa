"""Array expressions over feature vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv
from .scalar import clip


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: p * q))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e * e))


def l2_normalize(v: Column, eps: float = fv.NORM_EPS) -> Column:
    v = doubles(v)
    # the norm is computed once and carried into the lambda as a struct field
    pair = F.struct(v.alias("v"), (norm(v) + eps).alias("n"))
    return F.transform(F.array(pair), lambda p: F.transform(p["v"], lambda e: e / p["n"]))[0]


def literal_vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def standardize_bands(v: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    centred = F.zip_with(doubles(v), literal_vector(mean), lambda p, m: p - m)
    return F.zip_with(centred, literal_vector(std), lambda p, s: p / s)


def unstandardize_bands(v: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    scaled = F.zip_with(doubles(v), literal_vector(std), lambda p, s: p * s)
    back = F.zip_with(scaled, literal_vector(mean), lambda p, m: p + m)
    return F.transform(back, lambda p: clip(p, 0.0, 1.0))


def mean_layers(layers: Column) -> Column:
    """Element-wise mean of an array of equally long vectors."""
    first = F.transform(doubles(layers[0]), lambda e: F.lit(0.0))
    summed = F.aggregate(
        layers.cast("array<array<double>>"), first,
        lambda acc, layer: F.zip_with(acc, layer, lambda p, q: p + q),
    )
    return F.transform(summed, lambda e: e / F.size(layers))
