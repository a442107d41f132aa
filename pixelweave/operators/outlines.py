"""Outlines of regions of any size: borders as successor edges, ranked as lists.

A state of a border walk is a border pixel and the side it was entered from. Its
successor turns clockwise to the first border pixel of the region, which follows
from the eight neighbours alone, and as a map of states it is one to one: every
walk is a cycle, and the outer border of a part is the cycle whose first pixel
in row-major order is left over the open west side.

* Tiles chain their states into paths, so a path's states know its head and
  their place in it.
* Only paths that leave their tile meet others: pointer jumping finds the least
  state of each cycle, then the place of each path after the first one.
* Of the outer cycles of a region the one of largest area is its ring; a point's
  rank follows from the path's and its own place.
* Rings are simplified level by level: all segments of a level find their
  farthest point, and points go on in the halves. A ring of bounded length is
  simplified by one task, of longer ones a level is an aggregation.

No task or row holds a border beyond that bound; the result of a region is its
kept points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, drop_tables
from .packing import spread
from .stencil import TILE, find_cells, label_cells, on_tiles, own_cells

_AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]   # clockwise from east
_RING = ["scene_id", "label"]


def _turns() -> np.ndarray:
    """The side to leave by, for each set of occupied sides and each side entered from."""
    out = np.zeros((256, 8), np.int8)
    for sides in range(1, 256):
        for came in range(8):
            out[sides, came] = next((came + t) % 8 for t in range(1, 9) if sides >> (came + t) % 8 & 1)
    return out


def chains(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(head, place) of each item, given the item after it or -1; no two items
    have the same one after them. A closed cycle starts at its least item."""
    n = len(after)
    before = np.full(n, -1)
    before[after[after >= 0]] = np.flatnonzero(after >= 0)
    rounds = max(1, int(n).bit_length())

    def follow():
        head, place = np.where(before >= 0, before, np.arange(n)), (before >= 0).astype(np.int64)
        for _ in range(rounds):
            place = place + place[head]
            head = head[head]
        return head, place

    head, place = follow()
    closed = before[head] >= 0
    if closed.any():
        least, jump = np.arange(n), np.where(before >= 0, before, np.arange(n))
        for _ in range(rounds):
            least = np.minimum(least, least[jump])
            jump = jump[jump]
        before[closed & (least == np.arange(n))] = -1
        head, place = follow()
    return head, place


def _states(border: DataFrame, scenes: DataFrame, tile: int) -> DataFrame:
    """The states of all border walks, chained within tiles. ``id`` is eight
    times the pixel's row-major index plus the side entered from; the last
    state of a path that leaves its tile has ``ahead``, the next head."""
    turns = _turns()

    def fn(pdf, y_low, x_low, height, width, tile_sides):
        names, code, _, area, span = label_cells(pdf, y_low, x_low, tile_sides)
        mine = code[own_cells(code, area, span, tile_sides)]
        sides = sum((find_cells(code, mine + dy * span + dx) >= 0).astype(int) << d for d, (dy, dx) in enumerate(_AROUND))
        at, came = np.nonzero(sides[:, None] >> np.arange(8) & 1)      # in the order of label and id
        out = turns[sides[at], came].astype(int)
        dy, dx = np.array(_AROUND)[out].T
        place = mine[at] % area
        py, px = place // span + y_low - 1, place % span + x_low - 1
        after = find_cells(mine[at] * 8 + came, (mine[at] + dy * span + dx) * 8 + (out + 4) % 8) if len(at) else at
        head, rank = chains(after)
        ids = (py * width + px) * 8 + came
        return pd.DataFrame({
            "label": names[mine[at] // area], "id": ids, "y": py, "x": px, "cross": px * (py + dy) - (px + dx) * py, "slant": out % 2,
            # no side from west to north-east, and this walk turns over them
            "west": (sides[at] < 16) & (sides[at] >> came == 1), "head": ids[head], "place": rank,
            "ahead": pd.Series(((py + dy) * width + px + dx) * 8 + (out + 4) % 8, dtype="Int64").where(after < 0)})

    return on_tiles(border, scenes, ["label"], 1, fn, "label bigint, id bigint, y int, x int, cross bigint, slant int, west boolean, "
                    "head bigint, place bigint, ahead bigint", tile)


def _least_state(paths: DataFrame) -> DataFrame:
    """(scene_id, label, head, m): the least state of the cycle of each open path."""
    at = cut_lineage(paths.select(*_RING, "head", F.col("ahead").alias("jump"), "m"))
    while True:
        far = at.select(*_RING, F.col("head").alias("jump"), F.col("jump").alias("_j"), F.col("m").alias("_m"))
        step = cut_lineage(at.join(far, [*_RING, "jump"]).select(
            *_RING, "head", F.col("_j").alias("jump"), F.least("m", "_m").alias("m"), (F.col("_m") < F.col("m")).alias("_moved")), at)
        if step.where("_moved").isEmpty():
            return step.select(*_RING, "head", "m")
        at = step.drop("_moved")
        at._pixelweave_table = step._pixelweave_table


def _places(paths: DataFrame) -> DataFrame:
    """(scene_id, label, head, before): the states from the first path of each cycle to each open path."""
    links = paths.select(*_RING, F.col("ahead").alias("head"), F.col("head").alias("jump"), F.col("n").alias("before"))
    at = cut_lineage(links.join(paths.select(*_RING, "head", "first"), [*_RING, "head"]).select(
        *_RING, "head", F.when(F.col("first"), F.col("head")).otherwise(F.col("jump")).alias("jump"),
        F.when(F.col("first"), F.lit(0).cast("bigint")).otherwise(F.col("before")).alias("before")))
    while True:
        far = at.select(*_RING, F.col("head").alias("jump"), F.col("jump").alias("_j"), F.col("before").alias("_b"))
        step = cut_lineage(at.join(far, [*_RING, "jump"]).select(
            *_RING, "head", F.col("_j").alias("jump"), (F.col("before") + F.col("_b")).alias("before"),
            (F.col("_j") != F.col("jump")).alias("_moved")), at)
        if step.where("_moved").isEmpty():
            return step.select(*_RING, "head", "before")
        at = step.drop("_moved")
        at._pixelweave_table = step._pixelweave_table


def outer_rings(border: DataFrame, scenes: DataFrame, tile: int = TILE) -> DataFrame:
    """(scene_id, label, rank, y, x, n, length): the points of the largest outer
    border of each region, in walking order from its first pixel. ``border`` has
    the regions' border pixels (scene_id, label, y, x); single pixels have no ring."""
    states = cut_lineage(_states(border, scenes, tile))
    west = F.when(F.col("west"), F.col("id"))
    paths = cut_lineage(states.groupBy(*_RING, "head").agg(
        F.count("*").alias("n"), F.max("ahead").alias("ahead"), F.sum("cross").alias("cross"), F.sum("slant").alias("slant"),
        F.min("id").alias("m"), F.min(west).alias("west"), F.min_by("place", west).alias("turn")))
    open_ = paths.where(F.col("ahead").isNotNull())
    if not open_.isEmpty():
        least = _least_state(open_).withColumnRenamed("m", "_m")
        paths = cut_lineage(paths.join(least, [*_RING, "head"], "left").withColumn("m", F.coalesce("_m", "m")).drop("_m"), paths)
    paths = paths.withColumn("first", F.coalesce(F.shiftright("west", 3) == F.shiftright("m", 3), F.lit(False)))
    cycles = paths.groupBy(*_RING, "m").agg(
        F.sum("n").alias("n"), F.abs(F.sum("cross")).alias("area2"), F.sum("slant").alias("slant"),
        F.bool_or("first").alias("outer"), F.max(F.when(F.col("first"), F.col("turn"))).alias("turn")).where("outer")
    ring = F.max(F.struct("area2", (-F.col("m")).alias("k"), "n", "slant", "turn"))
    chosen = cut_lineage(cycles.groupBy(*_RING).agg(ring.alias("r")).select(
        *_RING, (-F.col("r.k")).alias("m"), F.col("r.n").alias("n"), F.col("r.turn").alias("turn"),
        (F.col("r.n") - F.col("r.slant") + F.col("r.slant") * F.sqrt(F.lit(2.0))).alias("length")))
    used = cut_lineage(paths.join(chosen.select(*_RING, "m"), [*_RING, "m"], "left_semi"))
    open_ = used.where(F.col("ahead").isNotNull())
    placed = used.select(*_RING, "head", "m", F.lit(0).cast("bigint").alias("before"))
    if not open_.isEmpty():
        placed = used.select(*_RING, "head", "m").join(_places(open_), [*_RING, "head"], "left").fillna(0, ["before"])
    placed = placed.join(chosen, [*_RING, "m"])
    out = cut_lineage(states.join(placed, [*_RING, "head"]).select(
        *_RING, F.pmod(F.col("before") + F.col("place") - F.col("turn"), F.col("n")).alias("rank"), "y", "x", "n", "length"))
    drop_tables(states, paths, chosen, used)
    return out


def _gap(y: Column, x: Column, y0: Column, x0: Column) -> Column:
    return (y - y0) * (y - y0) + (x - x0) * (x - x0)


def simplified(points: DataFrame, share: float, max_points: int = 100_000) -> DataFrame:
    """(scene_id, label, rank, y, x): the points of each ring that
    Douglas-Peucker keeps at a tolerance of ``share`` of its length. A closed
    ring is split at the point farthest from its first one and the point
    farthest from that. Rings of at most ``max_points`` points are simplified by
    one task each, longer ones by joins."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    pts = points.select(*_RING, "rank", y.alias("y"), x.alias("x"), "n", (F.col("length") * share).alias("tol"))
    rings = pts.where(F.col("n") <= max_points).groupBy(*_RING).agg(
        F.sort_array(F.collect_list(F.struct("rank", "y", "x"))).alias("p"), F.first("tol").alias("tol"))
    kinds = dict(points.dtypes)
    small = spread(rings.select(*_RING, F.col("p.y").alias("y"), F.col("p.x").alias("x"), "tol"), *_RING).mapInArrow(
        _simplify_rings, f"scene_id {kinds['scene_id']}, label {kinds['label']}, rank bigint, y double, x double")
    long = pts.where(F.col("n") > max_points)
    return small if long.isEmpty() else small.unionByName(_simplified_by_levels(long))


def _simplify_rings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rings (y and x by rank), all of a batch level by level."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.list_value_length(b.column("y")).to_numpy().astype(np.int64)
        start = np.cumsum(size) - size
        ring = np.repeat(np.arange(len(size)), size)
        y, x = pc.list_flatten(b.column("y")).to_numpy(), pc.list_flatten(b.column("x")).to_numpy()
        rank = np.arange(len(ring)) - start[ring]

        def farthest(from_: np.ndarray) -> np.ndarray:
            """Per ring the first point of greatest distance from its point ``from_``."""
            c = from_[ring]
            return _first_greatest((y - y[c]) * (y - y[c]) + (x - x[c]) * (x - x[c]), start)

        far = farthest(start)
        back = farthest(far)
        one, two = np.minimum(far, back), np.maximum(far, back)
        kept = np.zeros(len(ring), bool)
        whole = one < two
        kept[one[whole]] = kept[two[whole]] = True
        # ranks are turned so that the first kept point comes first
        turned = (rank - rank[one][ring]) % size[ring]
        order = np.lexsort((turned, ring))
        order = order[whole[ring[order]] & ~kept[order]]
        front = turned[order] < (two - one)[ring[order]]
        p, q = np.where(front, one[ring[order]], two[ring[order]]), np.where(front, two[ring[order]], one[ring[order]])
        while len(order):
            new = np.concatenate([[True], (ring[order][1:] != ring[order][:-1]) | (p[1:] != p[:-1])])
            first, part = np.flatnonzero(new), np.cumsum(new) - 1
            dy, dx = y[q] - y[p], x[q] - x[p]
            length = np.sqrt(dy * dy + dx * dx)
            oy, ox = y[order] - y[p], x[order] - x[p]
            with np.errstate(divide="ignore", invalid="ignore"):
                off = np.where(length > 0, np.abs(oy * dx - ox * dy) / length, np.sqrt(oy * oy + ox * ox))
            top = _first_greatest(off, first)
            tol = b.column("tol").to_numpy()[ring[order[top]]]
            cut = off[top] > tol
            kept[order[top[cut]]] = True
            at = np.arange(len(order))
            stay = cut[part] & (at != top[part])
            before = (at < top[part])[stay]
            middle = order[top[part]][stay]
            order, p, q = order[stay], np.where(before, p[stay], middle), np.where(before, middle, q[stay])
        hit = np.flatnonzero(kept)
        of = pa.array(ring[hit])
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(of) for c in _RING), pa.array(rank[hit]), pa.array(y[hit]), pa.array(x[hit])],
                                         names=[*_RING, "rank", "y", "x"])


def _first_greatest(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The first place of the greatest value of each stretch that begins at ``start``."""
    size = np.diff(np.append(start, len(value)))
    part = np.repeat(np.arange(len(start)), size)
    hit = np.flatnonzero(value == np.maximum.reduceat(value, start)[part])
    return hit[np.searchsorted(part[hit], np.arange(len(start)))]


def _simplified_by_levels(pts: DataFrame) -> DataFrame:
    """The same for rings of any length, by joins."""
    spot = lambda name: F.struct("rank", "y", "x").alias(name)

    def farthest(centre: DataFrame, name: str) -> DataFrame:
        d = _gap(F.col("y"), F.col("x"), F.col("c.y"), F.col("c.x"))
        top = F.max(F.struct(d.alias("d"), (-F.col("rank")).alias("k"), "y", "x"))
        return pts.join(centre, _RING).groupBy(*_RING).agg(top.alias("t")).select(
            *_RING, F.struct((-F.col("t.k")).alias("rank"), F.col("t.y").alias("y"), F.col("t.x").alias("x")).alias(name))

    far = cut_lineage(farthest(pts.where("rank = 0").select(*_RING, spot("c")), "f"))
    ends = cut_lineage(far.join(farthest(far.withColumnRenamed("f", "c"), "s"), _RING).select(
        *_RING, F.least("f", "s").alias("a"), F.greatest("f", "s").alias("b")).where(F.col("a.rank") < F.col("b.rank")))
    # ranks are turned so that the first kept point has rank 0
    kept = [ends.select(*_RING, F.inline(F.array("a", "b")))]
    turned = F.pmod(F.col("rank") - F.col("a.rank"), F.col("n"))
    front = turned < F.col("b.rank") - F.col("a.rank")
    todo = cut_lineage(pts.join(ends, _RING).select(
        *_RING, "rank", "y", "x", "tol", turned.alias("t"),
        F.when(front, F.lit(0).cast("bigint")).otherwise(F.col("b.rank") - F.col("a.rank")).alias("i"),
        F.when(front, F.col("a")).otherwise(F.col("b")).alias("p"), F.when(front, F.col("b")).otherwise(F.col("a")).alias("q")).where(
        (F.col("rank") != F.col("p.rank")) & (F.col("rank") != F.col("q.rank"))))
    while True:
        dy, dx = F.col("q.y") - F.col("p.y"), F.col("q.x") - F.col("p.x")
        length = F.sqrt(dy * dy + dx * dx)
        away = F.abs((F.col("y") - F.col("p.y")) * dx - (F.col("x") - F.col("p.x")) * dy)
        off = F.when(length > 0, away / length).otherwise(F.sqrt(_gap(F.col("y"), F.col("x"), F.col("p.y"), F.col("p.x"))))
        top = F.max(F.struct(off.alias("off"), (-F.col("t")).alias("k"), "rank", "y", "x"))
        cut = cut_lineage(todo.groupBy(*_RING, "i").agg(top.alias("m"), F.first("tol").alias("tol")).where(F.col("m.off") > F.col("tol")).select(
            *_RING, "i", (-F.col("m.k")).alias("_t"), F.struct("m.rank", "m.y", "m.x").alias("_m")))
        if cut.isEmpty():
            break
        kept.append(cut.select(*_RING, "_m.*"))
        before = F.col("t") < F.col("_t")
        todo = cut_lineage(todo.join(cut, [*_RING, "i"]).where(F.col("t") != F.col("_t")).select(
            *_RING, "rank", "y", "x", "tol", "t", F.when(before, F.col("i")).otherwise(F.col("_t")).alias("i"),
            F.when(before, F.col("p")).otherwise(F.col("_m")).alias("p"), F.when(before, F.col("_m")).otherwise(F.col("q")).alias("q")), todo)
    drop_tables(todo)
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out
