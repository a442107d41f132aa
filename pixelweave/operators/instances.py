"""Splitting touching regions: distance, peaks, and a marker watershed.

The watershed is the minimum spanning forest rooted in the markers (watershed
cuts, Cousty et al., 2009). It is found with joins and aggregations: pixels
follow their steepest neighbour to a peak (pointer jumping), and unmarked
basins join through their highest pass (Boruvka rounds). No component is
gathered anywhere, so its size is not bounded. An edge weighs as the lower of
its heights, then as the higher one: of several labelled neighbours a pixel
takes the label of the highest. Unique heights thus determine the result; ties
follow (height, id). ``flood.queue_watershed`` keeps the order of a queue, which
also decides plateaus; ``split_instances`` uses that one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .distance import distance_transform
from .flood import queue_watershed
from .stats import number_rows
from .stencil import CROSS, TILE, local_peaks

_NODE = ["scene_id", "id"]


def _jump(pointers: DataFrame) -> DataFrame:
    """Follow ``p`` to its end for all (scene_id, id, p)."""
    used = pointers
    while True:
        ahead = pointers.select("scene_id", F.col("id").alias("p"), F.col("p").alias("_q"))
        stepped = cut_lineage(pointers.join(ahead, ["scene_id", "p"]).select(
            "scene_id", "id", F.col("_q").alias("p"), (F.col("_q") != F.col("p")).alias("_moved")), used)
        used = stepped
        moved = stepped.where("_moved").limit(1).count()
        pointers = stepped.drop("_moved")
        if not moved:
            return pointers


def marker_watershed(heights: DataFrame, markers: DataFrame, scenes: DataFrame,
                     value: str = "d2") -> DataFrame:
    """Label every pixel of ``heights`` (scene_id, y, x, value) by the marker
    (scene_id, y, x, label) it drains to, 4-neighbour. Parts without any
    marker are left out."""
    px = heights.select("scene_id", "y", "x", F.col(value).alias("h")).join(
        scenes.select("scene_id", "width"), "scene_id").withColumn(
        "id", F.col("y").cast("bigint") * F.col("width") + F.col("x")).drop("width")
    px = cut_lineage(px.join(markers.select("scene_id", "y", "x", "label"), ["scene_id", "y", "x"], "left"))

    # each pixel sends (height, id) to itself and its neighbours
    offs = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 0), *CROSS)])
    own = (F.col("o.dy") == 0) & (F.col("o.dx") == 0)
    sent = px.select("*", F.explode(offs).alias("o")).select(
        "scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
        F.struct("h", (-F.col("id")).alias("k")).alias("_s"),
        F.when(own, F.col("id")).alias("id"), F.when(own, F.col("label")).alias("label"))
    up = sent.groupBy("scene_id", "y", "x").agg(
        F.max("_s").alias("_s"), F.max("id").alias("id"), F.max("label").alias("label")
    ).where(F.col("id").isNotNull())
    pointers = up.select("scene_id", "id", F.when(F.col("label").isNotNull(), F.col("id"))
                         .otherwise(-F.col("_s.k")).alias("p"))
    basin = cut_lineage(_jump(cut_lineage(pointers)))

    cells = cut_lineage(px.join(basin, _NODE), px)
    # highest pass between touching basins
    forward = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ((0, 1), (1, 0))])
    ahead = cells.select("*", F.explode(forward).alias("o")).select(
        "scene_id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"),
        F.col("h").alias("_h"), F.col("p").alias("_p"))
    passes = ahead.join(cells.select("scene_id", "y", "x", "h", "p"), ["scene_id", "y", "x"]).where(
        F.col("p") != F.col("_p")).select(
        "scene_id", F.least("p", "_p").alias("a"), F.greatest("p", "_p").alias("b"),
        F.struct(F.least("h", "_h").alias("low"), F.greatest("h", "_h").alias("high")).alias("w")).groupBy("scene_id", "a", "b").agg(F.max("w").alias("w"))
    edges = cut_lineage(passes.select("scene_id", F.col("a").alias("ca"), F.col("b").alias("cb"),
                                      F.struct("w", (-F.col("a")).alias("a"), (-F.col("b")).alias("b")).alias("k")))
    # group: basin -> current group and the marker it holds
    marked = cells.where(F.col("label").isNotNull()).select("scene_id", F.col("id").alias("c"), "label")
    group = cut_lineage(cells.select("scene_id", F.col("p").alias("id")).distinct().join(
        marked.withColumnRenamed("c", "id"), _NODE, "left").select("scene_id", "id", F.col("id").alias("c"), "label"))

    while True:
        heads = group.groupBy("scene_id", "c").agg(F.max("label").alias("_l"))
        tagged = edges.join(heads.select("scene_id", F.col("c").alias("ca"), F.col("_l").alias("_la")),
                            ["scene_id", "ca"]).join(
            heads.select("scene_id", F.col("c").alias("cb"), F.col("_l").alias("_lb")), ["scene_id", "cb"])
        live = tagged.where((F.col("ca") != F.col("cb")) & (F.col("_la").isNull() | F.col("_lb").isNull()))
        sides = live.select("scene_id", F.col("ca").alias("c"), F.col("cb").alias("t"), "k", F.col("_la").alias("_l")) \
            .unionByName(live.select("scene_id", F.col("cb").alias("c"), F.col("ca").alias("t"), "k",
                                     F.col("_lb").alias("_l"))).where(F.col("_l").isNull())
        picks = cut_lineage(sides.groupBy("scene_id", "c").agg(F.max_by("t", "k").alias("t")))
        if picks.isEmpty():
            break
        # two groups that pick each other: the lower one stays
        back = picks.select("scene_id", F.col("c").alias("t"), F.col("t").alias("_back"))
        hooked = picks.join(back, ["scene_id", "t"], "left").select(
            "scene_id", F.col("c").alias("id"),
            F.when((F.col("_back") == F.col("c")) & (F.col("c") < F.col("t")), F.col("c"))
            .otherwise(F.col("t")).alias("p"))
        roots = heads.select("scene_id", F.col("c").alias("id")).join(
            hooked, _NODE, "left").select("scene_id", "id", F.coalesce("p", "id").alias("p"))
        moved = _jump(cut_lineage(roots)).select("scene_id", F.col("id").alias("c"), F.col("p").alias("_to"))
        group = cut_lineage(group.join(moved, ["scene_id", "c"]).select(
            "scene_id", "id", F.col("_to").alias("c"), "label"))
        edges = cut_lineage(
            edges.join(moved.select("scene_id", F.col("c").alias("ca"), F.col("_to").alias("_ta")), ["scene_id", "ca"])
            .join(moved.select("scene_id", F.col("c").alias("cb"), F.col("_to").alias("_tb")), ["scene_id", "cb"])
            .select("scene_id", F.col("_ta").alias("ca"), F.col("_tb").alias("cb"), "k")
            .where(F.col("ca") != F.col("cb")))

    heads = group.groupBy("scene_id", "c").agg(F.max("label").alias("label")).where(F.col("label").isNotNull())
    named = group.drop("label").join(heads, ["scene_id", "c"]).select("scene_id", F.col("id").alias("p"), "label")
    return cells.select("scene_id", "y", "x", "p").join(named, ["scene_id", "p"]).select(
        "scene_id", "y", "x", "label")


def split_instances(mask: DataFrame, scenes: DataFrame, min_distance: int = 10,
                    tile: int = TILE, max_pixels: int = 1_000_000) -> DataFrame:
    """Instance labels 1..n per scene for touching regions, flooded in the order
    of a queue; parts above ``max_pixels`` are flooded by rounds of joins."""
    dist = cut_lineage(distance_transform(mask, scenes))
    peaks = local_peaks(dist, scenes, min_distance, tile=tile)
    markers = number_rows(peaks, ["y", "x"], "label", keys=["scene_id"])
    return queue_watershed(dist, markers, scenes, max_pixels=max_pixels, tile=tile)
