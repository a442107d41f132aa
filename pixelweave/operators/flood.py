"""Marker watershed in the order of a priority queue, plateaus included.

Pixels leave the queue highest first; of equal heights the one that entered
first leaves first. A pixel that leaves labels its unlabelled neighbours and
queues them, in the order up, left, right, down. Markers enter in row-major
order. What happens in one 4-connected part does not change the order inside
another, so parts are flooded apart: those of a scene of a few tiles' size by one
task, in larger scenes a part of at most ``max_pixels`` pixels by one task, a
larger one by rounds of joins, with the same result.

A round takes, per part, the queued pixels of the greatest height, up to and
including the first one that opens a higher neighbour: until then a queue would
take just these, one after the other. What they label enters in the order of
(parent, direction). Every round reads what is not labelled yet.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage, drop_tables
from .components import connected_components
from .stats import number_rows
from .stencil import TILE, is_whole, on_tiles

_PIXEL = ["scene_id", "y", "x"]
_PART = ["scene_id", "part"]
_AHEAD = ((-1, 0), (0, -1), (0, 1), (1, 0))      # in the order of entering
_LABELS = "scene_id bigint, y int, x int, label bigint"


def _flood_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The flood of pixels (y, x, h, label, marker), one part or several apart; those not reached are left out."""
    pdf = pdf.sort_values(["y", "x"], ignore_index=True)
    ys, xs = pdf["y"].to_numpy(np.int64), pdf["x"].to_numpy(np.int64)
    span = int(xs.max() - xs.min()) + 2
    place = (ys - ys.min()) * span + (xs - xs.min())
    beside = []
    for dy, dx in _AHEAD:
        to = place + dy * span + dx
        at = np.minimum(np.searchsorted(place, to), len(place) - 1)
        beside.append(np.where(place[at] == to, at, -1))
    beside = np.stack(beside, 1).tolist()
    marker = pdf["marker"].to_numpy(bool)
    label, done = pdf["label"].to_numpy(np.int64).tolist(), marker.tolist()
    depth = (-pdf["h"].to_numpy()).tolist()
    queue = [(depth[i], 0, i) for i in np.flatnonzero(marker).tolist()]
    heapq.heapify(queue)
    age = 0
    while queue:
        _, _, i = heapq.heappop(queue)
        for j in beside[i]:
            if j >= 0 and not done[j]:
                age += 1
                done[j], label[j] = True, label[i]
                heapq.heappush(queue, (depth[j], age, j))
    return pdf.assign(label=label)[[*_PIXEL, "label"]][done]


def _flood_rounds(px: DataFrame) -> DataFrame:
    """The same flood for parts of any size, by joins."""
    front = cut_lineage(number_rows(px.where("marker").select(*_PART, "y", "x", "h", "label"),
                                    ["y", "x"], "age", keys=_PART))
    rest = cut_lineage(px.where("not marker").select("scene_id", "y", "x", "h"))
    labelled = [cut_lineage(front.select(*_PIXEL, "label"))]
    ways = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in _AHEAD])
    turn = 0
    while not front.isEmpty():
        turn += 1
        top = front.groupBy(*_PART).agg(F.max("h").alias("top"))
        lead = cut_lineage(front.join(top, _PART).where(F.col("h") == F.col("top")))
        met = cut_lineage(lead.select(*_PART, "y", "x", "top", "age", "label", F.posexplode(ways).alias("way", "o")).select(
            *_PART, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
            "top", "age", "label", "way").join(rest, _PIXEL))
        stop = met.where(F.col("h") > F.col("top")).groupBy(*_PART).agg(F.min("age").alias("stop"))

        def until_stop(df: DataFrame) -> DataFrame:
            return df.join(stop, _PART, "left").where(F.col("stop").isNull() | (F.col("age") <= F.col("stop")))

        taken = until_stop(met).groupBy(*_PART, "y", "x").agg(F.min(F.struct("age", "way", "label", "h")).alias("b"))
        queued = number_rows(taken.select(*_PART, "y", "x", "b.h", "b.label", F.col("b.age").alias("parent"), "b.way"),
                             ["parent", "way"], "n", keys=_PART)
        # a later round enters later
        new = cut_lineage(queued.select(*_PART, "y", "x", "h", "label",
                                        (F.col("n") + F.lit(turn) * F.lit(1 << 40)).alias("age")))
        left = front.join(until_stop(lead).select(*_PIXEL), _PIXEL, "left_anti")
        front = cut_lineage(left.unionByName(new), front)
        rest = cut_lineage(rest.join(new.select(*_PIXEL), _PIXEL, "left_anti"), rest)
        labelled.append(cut_lineage(new.select(*_PIXEL, "label"), new))
        drop_tables(lead, met)
    return px.sparkSession.read.schema(labelled[0].schema).parquet(*[t._pixelweave_table for t in labelled])


def queue_watershed(heights: DataFrame, markers: DataFrame, scenes: DataFrame, value: str = "d2",
                    max_pixels: int = 1_000_000, tile: int = TILE) -> DataFrame:
    """Label every pixel of ``heights`` (scene_id, y, x, value; one row each) by
    the marker (scene_id, y, x, label) whose flood reaches it first.

    Pixels whose height is NULL or NaN lie outside, so do markers on them;
    parts without a marker are left out; of several markers on one pixel the
    smallest label counts."""
    height = F.col(value)
    if dict(heights.dtypes)[value] in ("double", "float"):
        height = F.nanvl(height, F.lit(None))
    named = markers.groupBy(*_PIXEL).agg(F.min("label").alias("label")).where(F.col("label").isNotNull())
    # scenes of bounded size are flooded by one task each, all their parts
    sized = scenes.withColumn("_one", is_whole(tile) & (F.col("height").cast("bigint") * F.col("width") <= max_pixels))
    beyond = sized.where(~F.col("_one")).drop("_one")
    cells = heights.select(*_PIXEL, height.alias("h")).where(F.col("h").isNotNull())
    kind = dict(cells.dtypes)["h"]
    both = cells.select(*_PIXEL, "h", F.lit(0).cast("bigint").alias("label"), F.lit(False).alias("marker")).unionByName(
        named.select(*_PIXEL, F.lit(0).cast(kind).alias("h"), F.col("label").cast("bigint").alias("label"), F.lit(True).alias("marker")))

    def flood(pdf, y_low, x_low, height, width, sides):
        marks = pdf[pdf["marker"].to_numpy(bool)]
        px = pdf[~pdf["marker"].to_numpy(bool)].drop(columns=["label", "marker"])
        px = px.merge(marks[["y", "x", "label"]], on=["y", "x"], how="left")
        marker = px["label"].notna()
        if not marker.any():
            return pd.DataFrame({"y": [], "x": [], "label": []})
        px = px.assign(label=px["label"].fillna(0).astype(np.int64), marker=marker, scene_id=0)
        return _flood_part(px)[["y", "x", "label"]]

    whole = on_tiles(both, sized.where("_one").drop("_one"), ["h", "label", "marker"], 0, flood, "y int, x int, label bigint", tile)
    if beyond.isEmpty():
        return whole
    return whole.unionByName(_flood_large(cells.join(beyond.select("scene_id"), "scene_id", "left_semi"), named, beyond, max_pixels, tile))


def _flood_large(cells: DataFrame, named: DataFrame, scenes: DataFrame, max_pixels: int, tile: int) -> DataFrame:
    """The same for larger scenes, part by part."""
    cells = cut_lineage(cells)
    parts = connected_components(cells.select(*_PIXEL), scenes, 4, tile).select(*_PIXEL, F.col("label").alias("part"))
    px = cut_lineage(cells.join(parts, _PIXEL).join(named, _PIXEL, "left").select(
        *_PART, "y", "x", "h", F.coalesce("label", F.lit(0)).cast("bigint").alias("label"),
        F.col("label").isNotNull().alias("marker")), cells)
    sizes = cut_lineage(px.groupBy(*_PART).agg(F.count("*").alias("n"), F.max("marker").alias("held"))
                        .where("held").drop("held"))
    small = px.join(sizes.where(F.col("n") <= max_pixels).select(*_PART), _PART).groupBy(*_PART).applyInPandas(
        _flood_part, _LABELS)
    large = sizes.where(F.col("n") > max_pixels).select(*_PART)
    if large.isEmpty():
        return small
    return small.unionByName(_flood_rounds(px.join(large, _PART)))
