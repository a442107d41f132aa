"""Tile grids as column expressions over scene sizes, and pixel-to-tile assignment.

A ``Grid`` states a rule once; ``starts`` lists the tile starts along an axis
and ``covering`` lists the starts of the tiles that contain a position, so
"pixel in tile" is an explode on the pixel row and never a range join.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fv
from ..functions import geo

I = "int"


@dataclass(frozen=True)
class Grid:
    """kind: 'stride' | 'snapped' | 'padded' | 'shifted'.

    stride   starts 0, step, ... while a whole tile fits; ``cover_edges`` adds
             a last tile at the far edge.
    snapped  as stride, and the last tile always ends at the edge.
    padded   starts 0, step, ... over the whole extent; tiles keep full size.
    shifted  non-overlapping, the last tile is moved back to fit.
    """

    kind: str
    size: int
    step: int
    cover_edges: bool = False

    def _whole(self, length: Column) -> Column:
        return (F.lit(self.size) <= 0) | (F.lit(self.size) >= length)

    def _limit(self, length: Column) -> Column:
        """Largest regular start."""
        room = length - self.size
        if self.kind == "stride":
            return F.greatest(F.lit(0), room)
        if self.kind == "snapped":
            return F.greatest(F.lit(1), room) - 1
        if self.kind == "padded":
            return length - 1
        return F.greatest(F.lit(0), room)

    def _has_last(self) -> bool:
        return self.kind in ("snapped", "shifted") or (self.kind == "stride" and self.cover_edges)

    def starts(self, length: Column) -> Column:
        regular = F.sequence(F.lit(0), self._limit(length).cast(I), F.lit(self.step))
        if self._has_last():
            last = F.greatest(F.lit(0), length - self.size).cast(I)
            regular = F.array_distinct(F.concat(regular, F.array(last)))
        if self.kind == "padded":
            return regular
        return F.when(self._whole(length), F.array(F.lit(0))).otherwise(regular)

    def end(self, start: Column, length: Column) -> Column:
        if self.kind == "padded":
            return start + self.size
        return F.when(self._whole(length), length).otherwise(F.least(start + self.size, length))

    def covering(self, pos: Column, length: Column) -> Column:
        low = F.greatest(F.lit(0), F.ceil((pos - self.size + 1) / F.lit(float(self.step))).cast(I))
        high = F.floor(F.least(pos, self._limit(length)) / F.lit(float(self.step))).cast(I)
        regular = F.when(
            low <= high, F.transform(F.sequence(low, high), lambda k: k * self.step)
        ).otherwise(F.array().cast("array<int>"))
        if self._has_last():
            last = F.greatest(F.lit(0), length - self.size).cast(I)
            regular = F.array_distinct(F.concat(
                regular, F.filter(F.array(last), lambda s: (s <= pos) & (pos < s + self.size))
            ))
        if self.kind == "padded":
            return regular
        return F.when(self._whole(length), F.array(F.lit(0))).otherwise(regular)


def tile_stride(size: int, stride: int, cover_edges: bool = False) -> Grid:
    """Stride grid. Without ``cover_edges`` a remainder at the far edges stays
    uncovered; a scene smaller than the tile yields one tile of scene size."""
    return Grid("stride", size, stride, cover_edges)


def tile_snapped(size: int, overlap: int) -> Grid:
    step = size - overlap
    return Grid("snapped", size, step if step > 0 else max(size, 1))


def tile_padded(size: int, overlap: int) -> Grid:
    """Full-size tiles over the whole extent. Scenes smaller than the overlap
    are refused when tiles are listed."""
    if size <= 0:
        raise ValueError(f"size must be positive, got {size}")
    if overlap < 0:
        raise ValueError(f"overlap must not be negative, got {overlap}")
    if overlap >= size:
        raise ValueError(f"overlap ({overlap}) must be smaller than size ({size})")
    return Grid("padded", size, size - overlap)


def tile_shifted(size: int) -> Grid:
    return Grid("shifted", size, size)


def list_tiles(scenes: DataFrame, grid: Grid) -> DataFrame:
    """One row per tile: scene_id, tile_id (row-major), y0, x0, y1, x1."""
    s = scenes.select("scene_id", "height", "width")
    if grid.kind == "padded":
        overlap = grid.size - grid.step
        small = (F.col("height") < overlap) | (F.col("width") < overlap)
        s = s.withColumn("height", F.when(small, F.raise_error(F.lit("Image too small")).cast(I))
                         .otherwise(F.col("height")))
    h, w = F.col("height"), F.col("width")
    rows = s.select("*", F.size(grid.starts(w)).alias("_nx"), F.posexplode(grid.starts(h)).alias("_iy", "y0"))
    cells = rows.select("*", F.posexplode(grid.starts(w)).alias("_ix", "x0"))
    return cells.select(
        "scene_id", (F.col("_iy").cast("bigint") * F.col("_nx") + F.col("_ix")).alias("tile_id"),
        F.col("y0").cast(I).alias("y0"), F.col("x0").cast(I).alias("x0"),
        grid.end(F.col("y0"), h).cast(I).alias("y1"), grid.end(F.col("x0"), w).cast(I).alias("x1"),
    )


def assign_tiles(pixels: DataFrame, scenes: DataFrame, grid: Grid) -> DataFrame:
    """Each pixel once per covering tile, with the tile's ``y0`` and ``x0``."""
    sized = pixels.join(scenes.select("scene_id", "height", "width"), "scene_id")
    return (
        sized.withColumn("y0", F.explode(grid.covering(F.col("y"), F.col("height"))))
        .withColumn("x0", F.explode(grid.covering(F.col("x"), F.col("width"))))
        .drop("height", "width")
    )


def padded_tile_pixels(pixels: DataFrame, scenes: DataFrame, grid: Grid,
                       cols: list[str]) -> DataFrame:
    """Pixels of full-size tiles; positions beyond the scene are 0.

    Only positions outside the scene are generated, so the real pixels are
    never joined to a grid.
    """
    real = assign_tiles(pixels, scenes, grid).select("scene_id", "y0", "x0", "y", "x", *cols)
    tiles = list_tiles(scenes, grid).join(scenes.select("scene_id", "height", "width"), "scene_id")
    h, w = F.col("height"), F.col("width")
    edge = tiles.where((F.col("y1") > h) | (F.col("x1") > w))
    rows = edge.withColumn("y", F.explode(F.sequence("y0", F.col("y1") - 1)))
    # inside rows need only the columns past the right edge
    first = F.when(F.col("y") < h, F.greatest(F.col("x0"), w)).otherwise(F.col("x0"))
    outside = rows.withColumn("_x", first).where(F.col("_x") < F.col("x1")).withColumn(
        "x", F.explode(F.sequence(F.col("_x"), F.col("x1") - 1)))
    zeros = outside.select("scene_id", "y0", "x0", "y", "x",
                           *[F.lit(0.0).alias(c) for c in cols])
    return real.unionByName(zeros)


def tile_min_size(scenes: DataFrame, size: int, minimum: int) -> DataFrame:
    """Cells of ``size``; a cell under ``minimum`` reads backwards, writes its own area.

    Columns: write_y0..write_x1 and read_y0..read_x1.
    """
    h, w = F.col("height"), F.col("width")

    def cells(length: Column) -> Column:
        return F.sequence(F.lit(0), (length - 1).cast(I), F.lit(size))

    def read(start: Column, end: Column) -> Column:
        return F.when(end - start < minimum, F.greatest(F.lit(0), end - minimum)).otherwise(start)

    t = (
        scenes.select("scene_id", "height", "width")
        .withColumn("write_y0", F.explode(cells(h))).withColumn("write_x0", F.explode(cells(w)))
        .withColumn("write_y1", F.least(F.col("write_y0") + size, h).cast(I))
        .withColumn("write_x1", F.least(F.col("write_x0") + size, w).cast(I))
    )
    return t.select(
        "scene_id", "write_y0", "write_x0", "write_y1", "write_x1",
        read(F.col("write_y0"), F.col("write_y1")).cast(I).alias("read_y0"),
        read(F.col("write_x0"), F.col("write_x1")).cast(I).alias("read_x0"),
        F.col("write_y1").alias("read_y1"), F.col("write_x1").alias("read_x1"),
    )


def tile_sr_geometry(scenes: DataFrame, size: int = 128, overlap: int = 12, factor: int = 4,
                     border: int = 2) -> DataFrame:
    """Windows for super-resolution: read bounds, and the write bounds in the
    enlarged scene after trimming ``border`` input pixels at inner sides."""
    t = list_tiles(scenes, tile_snapped(size, overlap)).join(
        scenes.select("scene_id", "height", "width"), "scene_id")

    def low(c: str) -> Column:
        return F.when(F.col(c) == 0, 0).otherwise(F.col(c) + border) * factor

    def high(c: str, length: str) -> Column:
        return F.when(F.col(c) == F.col(length), F.col(c)).otherwise(F.col(c) - border) * factor

    return t.select(
        "scene_id", "tile_id", "y0", "x0", "y1", "x1",
        low("y0").cast(I).alias("out_y0"), low("x0").cast(I).alias("out_x0"),
        high("y1", "height").cast(I).alias("out_y1"), high("x1", "width").cast(I).alias("out_x1"),
    )


def token_grid(height: Column, width: Column, tokens: Column, patch: int) -> Column:
    """struct<hp,wp>: size of the token grid of an image, by patch division or,
    when the count disagrees, by aspect ratio; an impossible count is an error."""
    hp = F.greatest(F.lit(1), F.floor(height / patch))
    wp = F.greatest(F.lit(1), F.floor(width / patch))
    aspect = height / F.greatest(width, F.lit(1))
    # bround rounds halves to even
    hp2 = F.greatest(F.lit(1), F.bround(F.sqrt(tokens * aspect)))
    wp2 = F.greatest(F.lit(1), F.floor(tokens / hp2))
    direct = hp * wp == tokens
    hh, ww = F.when(direct, hp).otherwise(hp2), F.when(direct, wp).otherwise(wp2)
    return F.when(
        hh * ww == tokens, F.struct(hh.cast(I).alias("hp"), ww.cast(I).alias("wp"))
    ).otherwise(F.raise_error(F.lit("token count does not fit a grid")).cast("struct<hp:int,wp:int>"))


def snap_grid(boxes: DataFrame, cell: int) -> DataFrame:
    """Cells of a map grid snapped outwards to multiples of ``cell``.

    Input columns min_x, min_y, max_x, max_y; output adds cell_x, cell_y.
    """
    def lows(lo: str, hi: str) -> Column:
        first = (F.floor(F.col(lo) / cell) * cell).cast("bigint")
        past = (F.ceil(F.col(hi) / cell) * cell).cast("bigint")
        return F.when(first < past, F.sequence(first, past - 1, F.lit(cell).cast("bigint"))).otherwise(
            F.array().cast("array<bigint>"))

    return boxes.withColumn("cell_x", F.explode(lows("min_x", "max_x"))).withColumn(
        "cell_y", F.explode(lows("min_y", "max_y")))


def grid_centers(low: Column, high: Column, patch: Column, step: Column) -> Column:
    """Array of centres so that patches of ``patch`` every ``step`` cover low..high."""
    half, middle = patch / 2.0, (low + high) / 2.0
    span = F.greatest(F.lit(0.0), high - low)
    count = F.ceil((span - patch) / step).cast(I)

    def inside(centre: Column) -> Column:
        """The nearest centre whose patch stays within low..high; the middle if none does."""
        return F.when(span < patch, middle).otherwise(F.greatest(low + half, F.least(centre, high - half)))

    many = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(0))), lambda i: inside(low + half + i * step))
    apart = F.filter(many, lambda c, i: (i == 0) | (
        F.abs(c - many[F.greatest(i - 1, F.lit(0))]) >= fv.CENTRE_EPS))
    return F.when(span <= patch, F.array(middle)).otherwise(apart)


def latlon_patches(boxes: DataFrame, edge_size: int, resolution_m: float) -> DataFrame:
    """Launch patches per box (lat1, lon1, lat2, lon2), longitude step per row."""
    if edge_size <= 0 or resolution_m <= 0:
        raise ValueError("edge_size and resolution_m must be positive")
    size_m = edge_size * float(resolution_m)
    if fv.LAUNCH_OVERLAP_M >= size_m:
        raise ValueError("the overlap must be smaller than the patch")
    step_m = size_m - fv.LAUNCH_OVERLAP_M
    b = boxes.withColumn("_s", F.least("lat1", "lat2")).withColumn("_n", F.greatest("lat1", "lat2")) \
        .withColumn("_w", F.least("lon1", "lon2")).withColumn("_e", F.greatest("lon1", "lon2"))
    lat = F.lit
    rows = b.withColumn("_lats", grid_centers(
        F.col("_s"), F.col("_n"), geo.meters_to_lat_deg(lat(size_m)), geo.meters_to_lat_deg(lat(step_m))
    )).select("*", F.size("_lats").alias("row_count"), F.posexplode("_lats").alias("row_index", "latitude"))
    cells = rows.withColumn("_patch", geo.meters_to_lon_deg(lat(size_m), F.col("latitude"))) \
        .withColumn("_step", geo.meters_to_lon_deg(lat(step_m), F.col("latitude"))) \
        .withColumn("_lons", grid_centers(F.col("_w"), F.col("_e"), F.col("_patch"), F.col("_step"))) \
        .select("*", F.size("_lons").alias("column_count"),
                F.posexplode("_lons").alias("column_index", "longitude"))
    keep = [c for c in boxes.columns]
    return cells.select(*keep, "row_index", "row_count", "column_index", "column_count",
                        "latitude", "longitude", F.lit(edge_size).alias("edge_size"))


def pixel_grid(scenes: DataFrame, block: int = 256) -> DataFrame:
    """Every (scene_id, y, x). Blocks are spread over the cluster before their
    pixels are generated, so one large scene is not expanded in one task."""
    s = scenes.select("scene_id", "height", "width")
    blocks = (
        s.withColumn("_by", F.explode(F.sequence(F.lit(0), (F.col("height") - 1).cast(I), F.lit(block))))
        .withColumn("_bx", F.explode(F.sequence(F.lit(0), (F.col("width") - 1).cast(I), F.lit(block))))
        .repartition("scene_id", "_by", "_bx")
    )
    return (
        blocks.withColumn("y", F.explode(F.sequence(
            F.col("_by"), F.least(F.col("_by") + block, F.col("height")).cast(I) - 1)))
        .withColumn("x", F.explode(F.sequence(
            F.col("_bx"), F.least(F.col("_bx") + block, F.col("width")).cast(I) - 1)))
        .select("scene_id", "y", "x")
    )
