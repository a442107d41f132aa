"""Affine transforms, degree conversion, UTM projection and product names."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from .. import fixed_values as fv

TRANSFORM = "struct<a:double,b:double,c:double,d:double,e:double,f:double>"


def affine(a, b, c, d, e, f) -> Column:
    names = "abcdef"
    return F.struct(*[
        (v if isinstance(v, Column) else F.lit(float(v))).cast("double").alias(n)
        for n, v in zip(names, (a, b, c, d, e, f))
    ])


def map_x(t: Column, col: Column, row: Column) -> Column:
    return t["a"] * col + t["b"] * row + t["c"]


def map_y(t: Column, col: Column, row: Column) -> Column:
    return t["d"] * col + t["e"] * row + t["f"]


def affine_scaled(t: Column, sx: Column, sy: Column) -> Column:
    """The transform after the pixel axes are stretched by ``sx`` and ``sy``."""
    return affine(t["a"] * sx, t["b"] * sy, t["c"], t["d"] * sx, t["e"] * sy, t["f"])


def affine_shifted(t: Column, dx: Column, dy: Column) -> Column:
    """The transform moved by a map offset."""
    return affine(t["a"], t["b"], t["c"] + dx, t["d"], t["e"], t["f"] + dy)


def affine_inverse(t: Column) -> Column:
    det = t["a"] * t["e"] - t["b"] * t["d"]
    ia, ib, id_, ie = t["e"] / det, -t["b"] / det, -t["d"] / det, t["a"] / det
    return affine(ia, ib, -(ia * t["c"] + ib * t["f"]), id_, ie, -(id_ * t["c"] + ie * t["f"]))


def affine_from_bounds(west: Column, south: Column, east: Column, north: Column,
                       width: Column, height: Column) -> Column:
    zero = F.lit(0.0)
    return affine((east - west) / width, zero, west, zero, (south - north) / height, north)


def meters_to_lat_deg(distance: Column) -> Column:
    return distance / fv.METRES_PER_DEGREE


def meters_to_lon_deg(distance: Column, lat: Column) -> Column:
    per_degree = F.lit(fv.METRES_PER_DEGREE) * F.cos(F.radians(lat))
    return F.when(per_degree > 0, distance / per_degree).otherwise(
        F.raise_error(F.lit("no degree length at this latitude")).cast("double")
    )


def utm_epsg(lat: Column, lon: Column) -> Column:
    lat = F.greatest(F.least(lat, F.lit(fv.UTM_LAT_MAX)), F.lit(fv.UTM_LAT_MIN))
    zone = F.floor((lon + 180.0) / 6.0) + 1
    base = F.when(lat >= 0, fv.UTM_NORTH_BASE).otherwise(fv.UTM_SOUTH_BASE)
    return (base + zone).cast("int")


def parse_epsg(text: Column, lat: Column, lon: Column) -> Column:
    """The first run of four or five digits, else the UTM code of the place."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d{4,5})", 1)
    return F.coalesce(F.nullif(found, F.lit("")).cast("int"), utm_epsg(lat, lon))


# Transverse Mercator after Krüger, third flattening series to fourth order.
_N = fv.WGS84_F / (2 - fv.WGS84_F)
_R = fv.WGS84_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_FORWARD = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
)
_BACK = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
)
_LATITUDE = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _central(epsg: Column) -> Column:
    # UTM zone number is the last two digits, for 326xx, 327xx and 258xx alike
    return F.radians((epsg % 100) * 6.0 - 183.0)


def _false_northing(epsg: Column) -> Column:
    return F.when(F.floor(epsg / 100) == 327, fv.UTM_FALSE_NORTHING).otherwise(0.0)


def to_utm(lat: Column, lon: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - _ECC * F.atanh(_ECC * s))
    dlon = F.radians(lon) - _central(epsg)
    xi = F.atan2(t, F.cos(dlon))
    eta = F.atanh(F.sin(dlon) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(_FORWARD, 1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = fv.UTM_K0 * _R
    return fv.UTM_FALSE_EASTING + scale * east, _false_northing(epsg) + scale * north


def from_utm(east: Column, north: Column, epsg: Column) -> tuple[Column, Column]:
    """Latitude and longitude in degrees."""
    scale = fv.UTM_K0 * _R
    xi = (north - _false_northing(epsg)) / scale
    eta = (east - fv.UTM_FALSE_EASTING) / scale
    xi1, eta1 = xi, eta
    for j, c in enumerate(_BACK, 1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi
    for j, c in enumerate(_LATITUDE, 1):
        lat = lat + c * F.sin(2 * j * chi)
    lon = _central(epsg) + F.atan2(F.sinh(eta1), F.cos(xi1))
    return F.degrees(lat), F.degrees(lon)


def add_latlon(df, east: str, north: str, epsg: str, lat: str, lon: str):
    """``from_utm`` as staged columns: each intermediate is evaluated once per
    row instead of being repeated inside one large expression."""
    scale = fv.UTM_K0 * _R
    xi, eta = F.col("_xi"), F.col("_eta")
    df = df.withColumn("_xi", (F.col(north) - _false_northing(F.col(epsg))) / scale) \
        .withColumn("_eta", (F.col(east) - fv.UTM_FALSE_EASTING) / scale)
    xi1, eta1 = xi, eta
    for j, c in enumerate(_BACK, 1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    df = df.withColumn("_xi1", xi1).withColumn("_eta1", eta1)
    df = df.withColumn("_chi", F.asin(F.sin("_xi1") / F.cosh("_eta1")))
    chi = F.col("_chi")
    phi = chi
    for j, c in enumerate(_LATITUDE, 1):
        phi = phi + c * F.sin(2 * j * chi)
    return df.withColumn(lat, F.degrees(phi)).withColumn(
        lon, F.degrees(_central(F.col(epsg)) + F.atan2(F.sinh("_eta1"), F.cos("_xi1")))
    ).drop("_xi", "_eta", "_xi1", "_eta1", "_chi")


def add_utm(df, lat: str, lon: str, epsg: str, east: str, north: str):
    """``to_utm`` as staged columns."""
    df = df.withColumn("_s", F.sin(F.radians(lat))).withColumn(
        "_t", F.sinh(F.atanh("_s") - _ECC * F.atanh(_ECC * F.col("_s"))))
    df = df.withColumn("_d", F.radians(lon) - _central(F.col(epsg)))
    df = df.withColumn("_xi", F.atan2("_t", F.cos("_d"))).withColumn(
        "_eta", F.atanh(F.sin("_d") / F.sqrt(1 + F.col("_t") * F.col("_t"))))
    xi, eta = F.col("_xi"), F.col("_eta")
    e, n = eta, xi
    for j, c in enumerate(_FORWARD, 1):
        e = e + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        n = n + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    scale = fv.UTM_K0 * _R
    return df.withColumn(east, fv.UTM_FALSE_EASTING + scale * e).withColumn(
        north, _false_northing(F.col(epsg)) + scale * n).drop("_s", "_t", "_d", "_xi", "_eta")


def centroid_lonlat(transform: Column, width: Column, height: Column,
                    epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the middle of a scene."""
    east = map_x(transform, width / 2.0, height / 2.0)
    north = map_y(transform, width / 2.0, height / 2.0)
    lat, lon = from_utm(east, north, epsg)
    return lon, lat


# --- product names ----------------------------------------------------------

def sr_name(lat: Column, lon: Column) -> Column:
    return F.format_string("output_SR_image_%.6f_%.6f.tif", lat, lon)


def cell_name(x: Column, y: Column) -> Column:
    return F.format_string("dop20_%d_%d_1km_20cm.tif", x.cast("bigint"), y.cast("bigint"))


def tile_name(base: Column, y: Column, x: Column) -> Column:
    return F.format_string("%s_y%d_x%d", base, y.cast("bigint"), x.cast("bigint"))


def parse_sr_name(name: Column) -> Column:
    pattern = r"output_SR_image_(-?\d+\.\d+)_(-?\d+\.\d+)\.tif$"
    return F.struct(
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("double").alias("lat"),
        F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).cast("double").alias("lon"),
    )


def parse_tile_name(name: Column) -> Column:
    pattern = r"^(.*)_y(-?\d+)_x(-?\d+)(?:\.\w+)?$"
    return F.struct(
        F.regexp_extract(name, pattern, 1).alias("base"),
        F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).cast("bigint").alias("y"),
        F.nullif(F.regexp_extract(name, pattern, 3), F.lit("")).cast("bigint").alias("x"),
    )


def parse_cell_name(name: Column) -> Column:
    pattern = r"dop20_(-?\d+)_(-?\d+)_1km_20cm\.tif$"
    return F.struct(
        F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("bigint").alias("x"),
        F.nullif(F.regexp_extract(name, pattern, 2), F.lit("")).cast("bigint").alias("y"),
    )


def bands_for_product(name: Column) -> Column:
    upper = F.upper(name)
    out = F.when(F.lit(False), F.array(F.lit(0)))
    for marker, bands in fv.PRODUCT_BANDS.items():
        out = out.when(upper.contains(marker), F.array(*[F.lit(b) for b in bands]))
    return out


def getmap_url(base_url: str, layer: str, x0: Column, y0: Column, cell: float,
               width: int, height: int, epsg: int) -> Column:
    """The map request for one grid cell."""
    def whole(v: Column) -> Column:
        return F.format_string("%.1f", v.cast("double"))

    return F.concat(
        F.lit(f"{base_url}?SERVICE=WMS&VERSION=1.3.0&REQUEST=GetMap&LAYERS={layer}"
              f"&STYLES=&CRS=EPSG:{epsg}&BBOX="),
        F.concat_ws(",", whole(x0), whole(y0), whole(x0 + cell), whole(y0 + cell)),
        F.lit(f"&WIDTH={width}&HEIGHT={height}&FORMAT=image/png"),
    )
