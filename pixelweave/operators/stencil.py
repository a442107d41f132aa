"""Neighbourhood work.

``on_tiles`` sends each pixel to its tile and to tiles whose halo it lies in,
one shuffle for a whole chain of stencils, and runs array code per tile. A
tile holds at most ``(tile + 2*halo)**2`` pixels whatever the scene size; a
scene of at most ``WHOLE`` tiles' pixels is one tile, without halo or seams.
A join per offset would multiply rows by the element size at every step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import cut_lineage
from .packing import flat, pack_runs, spread

TILE = 256
WHOLE = 4      # tiles


def is_whole(tile: int) -> Column:
    """Whether a scene (height, width) is small enough to be one tile."""
    return F.coalesce(F.col("height").cast("bigint") * F.col("width") <= WHOLE * tile * tile, F.lit(False))


def on_tiles(df: DataFrame, scenes: DataFrame | None, cols: Sequence[str], halo: int,
             fn: Callable[[pd.DataFrame, int, int, int, int, tuple[int, int]], pd.DataFrame], schema: str,
             tile: int = TILE) -> DataFrame:
    """``fn(pixels, y_low, x_low, height, width, sides)`` per tile; ``y_low``/``x_low``
    is the tile's own corner and ``sides`` its rows and columns. It returns rows of
    ``schema`` for its own cells. Pixels that lie together are sent as one row.
    Without ``scenes``, tiles know no scene border and ``height`` and ``width`` are None."""
    px = df.select("scene_id", "y", "x", *cols)
    if scenes is None:
        px = px.select("*", F.lit(None).cast("int").alias("height"), F.lit(None).cast("int").alias("width"), F.lit(False).alias("_whole"))
    else:
        px = px.join(scenes.select("scene_id", "height", "width", is_whole(tile).alias("_whole")), "scene_id")
    kinds = dict(px.dtypes)
    key = ["scene_id", "_ty", "_tx"]
    carried = [*key, "height", "width", "_whole"]

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pixels of each tile and of its halo, as arrays."""
        for b in batches:
            if b.column("y").null_count or b.column("x").null_count:
                b = b.filter(pc.and_(b.column("y").is_valid(), b.column("x").is_valid()))
            if not b.num_rows:
                continue
            whole = b.column("_whole").to_numpy(zero_copy_only=False).astype(bool)
            at, ty, tx = np.flatnonzero(whole), [np.zeros(whole.sum(), np.int32)], [np.zeros(whole.sum(), np.int32)]
            rows, rest = [at], np.flatnonzero(~whole)
            if len(rest):
                y, x = (b.column(c).to_numpy()[rest].astype(np.int64) for c in ("y", "x"))
                y0, x0 = (np.floor_divide(v - halo, tile) for v in (y, x))
                if scenes_known:
                    y0, x0 = np.maximum(y0, 0), np.maximum(x0, 0)
                ny, nx = np.floor_divide(y + halo, tile) - y0, np.floor_divide(x + halo, tile) - x0
                for dy in range(int(ny.max()) + 1):
                    for dx in range(int(nx.max()) + 1):
                        hit = np.flatnonzero((dy <= ny) & (dx <= nx))
                        rows.append(rest[hit])
                        ty.append((y0[hit] + dy).astype(np.int32))
                        tx.append((x0[hit] + dx).astype(np.int32))
            if len(rest):
                b = b.take(pa.array(np.concatenate(rows)))
            if not b.num_rows:
                continue
            b = b.append_column("_ty", pa.array(np.concatenate(ty))).append_column("_tx", pa.array(np.concatenate(tx)))
            yield pack_runs(b, carried, names)

    fields = to_arrow_schema(StructType.fromDDL(f"scene_id bigint, {schema}"))
    names, scenes_known = ["y", "x", *cols], scenes is not None

    def run(key, table):
        scene, ty, tx = (k.as_py() for k in key)
        pdf = pd.DataFrame({c: flat(table, c) for c in names})
        height, width, whole = (table.column(c)[0].as_py() for c in ("height", "width", "_whole"))
        sides = (max(height, int(pdf["y"].max()) + 1), max(width, int(pdf["x"].max()) + 1)) if whole else (tile, tile)
        out = fn(pdf, ty * tile, tx * tile, height, width, sides)
        out.insert(0, "scene_id", scene)
        return pa.Table.from_arrays([pa.array(out[f.name], f.type, from_pandas=True) for f in fields], schema=fields)

    laid = px.mapInArrow(lay, ", ".join([*(f"`{c}` {kinds.get(c, 'int')}" for c in carried), *(f"`{c}` array<{kinds[c]}>" for c in names)]))
    return spread(laid, *key).groupBy(*key).applyInArrow(run, f"scene_id bigint, {schema}")


def label_cells(pdf: pd.DataFrame, y_low: int, x_low: int, sides: tuple[int, int]):
    """(names, code, count, area, span) of the pixels (label, y, x) of a tile and
    of the ring around it: the labels, the distinct (label, pixel) as sorted
    numbers, how often each is there, and the numbers a label and a row take."""
    names, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
    span = sides[1] + 2
    area = (sides[0] + 2) * span
    place = (pdf["y"].to_numpy(np.int64) - y_low + 1) * span + pdf["x"].to_numpy(np.int64) - x_low + 1
    code, count = np.unique(label.astype(np.int64) * area + place, return_counts=True)
    return names, code, count, area, span


def own_cells(code: np.ndarray, area: int, span: int, sides: tuple[int, int]) -> np.ndarray:
    """Whether the numbers of ``label_cells`` lie in the tile itself."""
    y, x = code % area // span, code % span
    return (y >= 1) & (y <= sides[0]) & (x >= 1) & (x <= sides[1])


def find_cells(code: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Where the numbers ``to`` stand in ``code``, -1 for those that are not there."""
    at = np.minimum(np.searchsorted(code, to), len(code) - 1)
    return np.where(code[at] == to, at, -1)


def element(shape: str, radius: int) -> np.ndarray:
    """Offsets (dy, dx) of a 'square', 'cross' or 'disk' element."""
    side = np.arange(-radius, radius + 1)
    dy, dx = np.meshgrid(side, side, indexing="ij")
    if shape == "square":
        keep = np.ones_like(dy, bool)
    elif shape == "cross":
        keep = np.abs(dy) + np.abs(dx) <= radius
    elif shape == "disk":
        keep = dy * dy + dx * dx <= radius * radius
    else:
        raise ValueError(shape)
    return np.stack([dy[keep], dx[keep]], axis=1)


def _any_shift(a: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    h, w = a.shape
    for dy, dx in offsets:
        ys, yd = (max(0, -dy), max(0, dy))
        xs, xd = (max(0, -dx), max(0, dx))
        out[yd:h - ys, xd:w - xs] |= a[ys:h - yd, xs:w - xd]
    return out


def morph(mask: DataFrame, scenes: DataFrame, steps: Sequence[tuple[str, str, int]],
          outside: str = "background", tile: int = TILE) -> DataFrame:
    """A chain of ('dilate'|'erode', shape, radius) steps in one pass.

    ``outside`` says how erosion sees positions beyond the scene: as
    'background', or as 'foreground' (they do not take part). Dilation never
    leaves the scene.
    """
    if outside not in ("background", "foreground"):
        raise ValueError(outside)
    plan = [(op, element(shape, radius)) for op, shape, radius in steps]
    halo = sum(radius for _, _, radius in steps)

    def fn(pdf, y_low, x_low, height, width, sides):
        full = (sides[0] + 2 * halo, sides[1] + 2 * halo)
        a = np.zeros(full, bool)
        a[pdf["y"].to_numpy() - y_low + halo, pdf["x"].to_numpy() - x_low + halo] = True
        yy = np.arange(full[0]) + y_low - halo
        xx = np.arange(full[1]) + x_low - halo
        inside = ((yy >= 0) & (yy < height))[:, None] & ((xx >= 0) & (xx < width))[None, :]
        for op, offsets in plan:
            if op == "dilate":
                a = _any_shift(a, offsets) & inside
            else:
                gap = ~a & inside if outside == "foreground" else ~a
                a = a & ~_any_shift(gap, offsets)
        ys, xs = np.nonzero(a[halo:halo + sides[0], halo:halo + sides[1]])
        return pd.DataFrame({"y": (ys + y_low).astype("int32"), "x": (xs + x_low).astype("int32")})

    return on_tiles(mask, scenes, [], halo, fn, "y int, x int", tile)


def dilate(mask, scenes, shape="square", radius=1, iterations=1, tile=TILE):
    return morph(mask, scenes, [("dilate", shape, radius)] * iterations, tile=tile)


def erode(mask, scenes, shape="square", radius=1, iterations=1, outside="background", tile=TILE):
    return morph(mask, scenes, [("erode", shape, radius)] * iterations, outside, tile)


def opening(mask, scenes, shape="square", radius=1, outside="background", tile=TILE):
    return morph(mask, scenes, [("erode", shape, radius), ("dilate", shape, radius)], outside, tile)


def closing(mask, scenes, shape="square", radius=1, outside="background", tile=TILE):
    return morph(mask, scenes, [("dilate", shape, radius), ("erode", shape, radius)], outside, tile)


def neighbors(df: DataFrame, offsets: Sequence[tuple[int, int]], value: str | None = None) -> DataFrame:
    """Self-join by offsets: one row per pixel and present neighbour, with
    ``dy``, ``dx`` and, if asked, the neighbour's value as ``neighbor``."""
    pairs = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in offsets])
    keep = ["scene_id", "y", "x"] + ([value] if value else [])
    sent = df.select(*keep).withColumn("_o", F.explode(pairs)).select(
        *keep, F.col("_o.dy").alias("dy"), F.col("_o.dx").alias("dx"),
        (F.col("y") + F.col("_o.dy")).alias("_ny"), (F.col("x") + F.col("_o.dx")).alias("_nx"))
    there = df.select("scene_id", F.col("y").alias("_ny"), F.col("x").alias("_nx"),
                      *([F.col(value).alias("neighbor")] if value else []))
    return sent.join(there, ["scene_id", "_ny", "_nx"]).drop("_ny", "_nx")


CROSS = ((-1, 0), (1, 0), (0, -1), (0, 1))
RING = CROSS + ((-1, -1), (-1, 1), (1, -1), (1, 1))


def label_boundaries(labels: DataFrame, scenes: DataFrame) -> DataFrame:
    """Labelled pixels with a 4-neighbour of another label or background.
    Positions beyond the scene are not neighbours. Each pixel sends its label
    to its neighbours, so one aggregation decides."""
    offs = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), *CROSS)])
    sent = labels.select("scene_id", "y", "x", "label", F.explode(offs).alias("o")).select(
        "scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
        "label", ((F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("_own"))
    per = sent.groupBy("scene_id", "y", "x").agg(
        F.max(F.when(F.col("_own"), F.col("label"))).alias("_c"), F.min("label").alias("_lo"),
        F.max("label").alias("_hi"), F.count("*").alias("_n"))
    sized = per.where(F.col("_c").isNotNull()).join(scenes.select("scene_id", "height", "width"), "scene_id")
    wanted = (1 + (F.col("y") > 0).cast("int") + (F.col("y") < F.col("height") - 1).cast("int")
              + (F.col("x") > 0).cast("int") + (F.col("x") < F.col("width") - 1).cast("int"))
    edge = (F.col("_lo") != F.col("_c")) | (F.col("_hi") != F.col("_c")) | (F.col("_n") < wanted)
    return sized.where(edge).select("scene_id", "y", "x", F.col("_c").alias("label"))


def _square_max(a: np.ndarray, r: int) -> np.ndarray:
    """Greatest value within the square of radius r around each cell."""
    best = a.copy()
    for axis in (0, 1):
        src = best.copy()
        for s in range(1, r + 1):
            low, high = [slice(None)] * 2, [slice(None)] * 2
            low[axis], high[axis] = slice(s, None), slice(None, -s)
            low, high = tuple(low), tuple(high)
            best[high] = np.maximum(best[high], src[low])
            best[low] = np.maximum(best[low], src[high])
    return best


def local_peaks(distance: DataFrame, scenes: DataFrame, min_distance: int,
                exclude_border: bool = True, value: str = "d2", tile: int = TILE) -> DataFrame:
    """Peaks of a positive field, at least ``min_distance`` + 1 apart.

    Candidates are pixels whose value is the greatest within a square of radius
    ``min_distance``; a border band of that width is left out. Candidates that
    near each other have equal values; of these they are kept in (y, x) order
    unless a kept one is within the square. Most candidates stand alone and are
    settled at once; the others (plateaus) are settled in rounds over tiles: a
    tile decides its candidates in order as far as earlier ones in its halo are
    decided, so rounds grow with the tiles a plateau crosses, not its pixels.
    """
    r = int(min_distance)

    def inner(sides):
        return slice(r, r + sides[0]), slice(r, r + sides[1])

    def grid(pdf, y_low, x_low, sides, values, fill):
        a = np.full((sides[0] + 2 * r, sides[1] + 2 * r), fill, np.asarray(values).dtype)
        a[pdf["y"].to_numpy() - y_low + r, pdf["x"].to_numpy() - x_low + r] = values
        return a

    def candidates(pdf, y_low, x_low, height, width, sides):
        own = inner(sides)
        v = grid(pdf, y_low, x_low, sides, pdf[value].to_numpy(float), -np.inf)
        ys, xs = np.nonzero((v[own] == _square_max(v, r)[own]) & (v[own] > 0))
        ys, xs = ys + y_low, xs + x_low
        if exclude_border:
            ok = (ys >= r) & (ys < height - r) & (xs >= r) & (xs < width - r)
            ys, xs = ys[ok], xs[ok]
        return pd.DataFrame({"y": ys.astype("int32"), "x": xs.astype("int32")})

    def settle(pdf, y_low, x_low, height, width, sides):
        """state 1: kept, 0: open; dropped ones are left out."""
        own = inner(sides)
        state = grid(pdf, y_low, x_low, sides, pdf["state"].to_numpy(np.int8), -1)
        for y, x in zip(*np.nonzero(state[own] == 0)):
            near = state[y:y + 2 * r + 1, x:x + 2 * r + 1]
            if (near == 1).any():
                state[y + r, x + r] = -1
            elif not ((near[:r] == 0).any() or (near[r, :r] == 0).any()):
                state[y + r, x + r] = 1
        ys, xs = np.nonzero(state[own] >= 0)
        return pd.DataFrame({"y": (ys + y_low).astype("int32"), "x": (xs + x_low).astype("int32"), "state": state[own][ys, xs].astype("int32")})

    kind = "y int, x int, state int"
    found = on_tiles(distance.where(F.col(value).isNotNull()), scenes, [value], r, candidates, "y int, x int", tile)
    found = cut_lineage(found.withColumn("state", F.lit(0)))
    while True:
        found = cut_lineage(on_tiles(found, scenes, ["state"], r, settle, kind, tile), found)
        if found.where("state = 0").isEmpty():
            return found.select("scene_id", "y", "x")
