"""Connected components and the clean-ups built on them.

Pixels are labelled inside tiles first; only the graph of label pairs that
touch across tile borders is then solved, by alternating large-star and
small-star steps (Kiveris et al., 2014), whose edges shrink to one star per
component. A component's label is 1 + the least row-major index of its pixels,
so it does not depend on tiles or partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .masks import keep_area_range, keep_min_area
from .merge import mask_union
from .pixels import complement
from .stencil import TILE, morph, on_tiles


def _join_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of each node's component, by hooking and pointer jumping."""
    lab = np.arange(n)
    while True:
        before = lab.copy()
        low = np.minimum(lab[a], lab[b])
        np.minimum.at(lab, lab[a], low)
        np.minimum.at(lab, lab[b], low)
        while True:
            jumped = lab[lab]
            if np.array_equal(jumped, lab):
                break
            lab = jumped
        if np.array_equal(lab, before):
            return lab


def _tile_labels(mask: DataFrame, scenes: DataFrame, connectivity: int, tile: int) -> DataFrame:
    shifts = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def fn(pdf, y_low, x_low, height, width, sides):
        ys, xs = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        cell = np.full((sides[0] + 2, sides[1] + 2), -1, np.int64)
        order = np.lexsort((xs, ys))
        ys, xs = ys[order], xs[order]
        ry, rx = ys - y_low + 1, xs - x_low + 1
        cell[ry, rx] = np.arange(len(ys))
        left, right = [], []
        for dy, dx in shifts:
            other = cell[ry + dy, rx + dx]
            hit = other >= 0
            left.append(np.flatnonzero(hit))
            right.append(other[hit])
        lab = _join_pairs(len(ys), np.concatenate(left), np.concatenate(right))
        index = ys.astype(np.int64) * width + xs + 1
        # a scene that is one tile has no seams
        edge = (y_low > 0) | (x_low > 0) | (height > sides[0]) | (width > sides[1])
        return pd.DataFrame({"y": ys, "x": xs, "label": index[lab], "edge": np.full(len(ys), edge)})

    return on_tiles(mask, scenes, [], 0, fn, "y int, x int, label bigint, edge boolean", tile)


def _seams(local: DataFrame, connectivity: int, tile: int) -> DataFrame:
    """Label pairs that touch across a tile border."""
    local = local.where("edge").drop("edge")
    y, x = F.col("y"), F.col("x")
    top, bottom = y % tile == 0, y % tile == tile - 1
    left, right = x % tile == 0, x % tile == tile - 1
    border = local.where(top | bottom | left | right)

    def step(dy: int, dx: int):
        return F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"))

    none = F.array().cast("array<struct<dy:int,dx:int>>")
    moves = [F.when(right, F.array(step(0, 1))).otherwise(none), F.when(bottom, F.array(step(1, 0))).otherwise(none)]
    if connectivity == 8:
        moves += [F.when(bottom | right, F.array(step(1, 1))).otherwise(none),
                  F.when(bottom | left, F.array(step(1, -1))).otherwise(none)]
    sent = border.withColumn("_o", F.explode(F.concat(*moves))).select(
        "scene_id", (y + F.col("_o.dy")).alias("y"), (x + F.col("_o.dx")).alias("x"), F.col("label").alias("u"))
    return sent.join(border.withColumnRenamed("label", "v"), ["scene_id", "y", "x"]).where(
        F.col("u") != F.col("v")).select("scene_id", "u", "v").distinct()


def _fingerprint(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("scene_id", "u", "v"))).first()


def solve_edges(edges: DataFrame) -> DataFrame:
    """(scene_id, u, v): each node u that is not the least of its component,
    with that least node v. Minima combine map-side; a node with very many
    edges is one key on one side of the joins, which adaptive skew splitting
    serves because the other side has a single row for it."""
    e = cut_lineage(edges.select("scene_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .where(F.col("u") != F.col("v")).distinct())
    mark = _fingerprint(e)
    while mark[0]:
        both = e.unionByName(e.select("scene_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("scene_id", "u").agg(F.min("v").alias("_m")).withColumn("_m", F.least("u", "_m"))
        large = both.where(F.col("v") > F.col("u")).join(low, ["scene_id", "u"]).select(
            "scene_id", F.col("v").alias("u"), F.col("_m").alias("v")).distinct()
        low2 = large.groupBy("scene_id", "u").agg(F.min("v").alias("_m"))
        small = large.join(low2, ["scene_id", "u"]).select(
            "scene_id", F.col("v").alias("u"), F.col("_m").alias("v")).where(F.col("u") != F.col("v"))
        e = cut_lineage(small.unionByName(low2.select("scene_id", "u", F.col("_m").alias("v"))).distinct(), e)
        now = _fingerprint(e)
        if now == mark:
            break
        mark = now
    return e


def connected_components(mask: DataFrame, scenes: DataFrame, connectivity: int = 8,
                         tile: int = TILE) -> DataFrame:
    """scene_id, y, x, label for every mask pixel; 4- or 8-neighbour."""
    if connectivity not in (4, 8):
        raise ValueError("connectivity must be 4 or 8")
    local = cut_lineage(_tile_labels(mask, scenes, connectivity, tile))
    if local.where("edge").isEmpty():
        return local.drop("edge")
    roots = solve_edges(_seams(local, connectivity, tile))
    named = roots.select("scene_id", F.col("u").alias("label"), F.col("v").alias("_root"))
    return local.join(named, ["scene_id", "label"], "left").select(
        "scene_id", "y", "x", F.coalesce("_root", "label").alias("label"))


def fill_holes(mask: DataFrame, scenes: DataFrame, tile: int = TILE) -> DataFrame:
    """Add background parts (4-neighbour) that do not reach the scene border."""
    back = connected_components(complement(mask, scenes), scenes, 4, tile)
    sized = back.join(scenes.select("scene_id", "height", "width"), "scene_id")
    on_border = ((F.col("y") == 0) | (F.col("x") == 0) | (F.col("y") == F.col("height") - 1)
                 | (F.col("x") == F.col("width") - 1))
    open_parts = sized.where(on_border).select("scene_id", "label").distinct()
    holes = back.join(open_parts, ["scene_id", "label"], "left_anti")
    return mask_union(mask, holes)


def clean_tree_mask(mask: DataFrame, scenes: DataFrame, min_area: int = 25, max_area: int = 10000,
                    tile: int = TILE) -> DataFrame:
    """Close with disk 2, open with disk 1, drop small parts, drop large parts.

    Positions beyond the scene do not take part in erosion. Small parts are
    4-neighbour components and large parts 8-neighbour ones, as the library
    defaults of the two steps have it.
    """
    steps = [("dilate", "disk", 2), ("erode", "disk", 2), ("erode", "disk", 1), ("dilate", "disk", 1)]
    shaped = morph(mask, scenes, steps, outside="foreground", tile=tile)
    kept = keep_min_area(connected_components(shaped, scenes, 4, tile), min_area)
    parts = connected_components(kept, scenes, 8, tile)
    return keep_area_range(parts, 1, max_area).select("scene_id", "y", "x")


def clean_field_mask(mask: DataFrame, scenes: DataFrame, min_area: int, tile: int = TILE) -> DataFrame:
    """Open 3x3, close 5x5, fill holes, keep 4-neighbour parts of min_area."""
    steps = [("erode", "square", 1), ("dilate", "square", 1), ("dilate", "square", 2), ("erode", "square", 2)]
    filled = fill_holes(cut_lineage(morph(mask, scenes, steps, tile=tile)), scenes, tile)
    return keep_min_area(connected_components(filled, scenes, 4, tile), min_area).select("scene_id", "y", "x")
