"""Exact Euclidean distance transform of a sparse mask."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .packing import flat, packed, spread
from .stencil import TILE, is_whole

_FAR = np.int64(1) << 60     # no background on that side
_SHIFTS = 48                 # reach up to which shifted minima are used


def _runs(line: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """First index of each unbroken run of positions on one line, and the end."""
    new = np.flatnonzero((line[1:] != line[:-1]) | (pos[1:] != pos[:-1] + 1)) + 1
    return np.concatenate([[0], new, [len(pos)]])


def _to_gap(pos: np.ndarray, length: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Squared distance to the nearer end of the run, ends at the scene's edge left out."""
    size = np.diff(cuts)
    first, last = np.repeat(pos[cuts[:-1]], size), np.repeat(pos[cuts[1:] - 1], size)
    low = np.where(first > 0, pos - first + 1, _FAR)
    high = np.where(last < length - 1, last - pos + 1, _FAR)
    near = np.minimum(low, high)
    return np.where(near < _FAR, np.minimum(near, 1 << 29) ** 2, _FAR)


def _envelope(g: np.ndarray) -> np.ndarray:
    """min over j of g[j] + (i - j)**2.

    The first best j does not fall as i grows, so positions are settled by
    halving steps: one between two settled ones only looks between their bests.
    A level is a few array operations and looks at about twice as many values
    as there are positions.
    """
    n, j = len(g), np.flatnonzero(g < _FAR)
    if not len(j):
        return g
    v, best = g[j], np.zeros(n, np.int64)
    step = 1 << max(0, n - 1).bit_length()
    i = np.zeros(1, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, len(j) - 1)
    while True:
        size = high - low + 1
        start = np.cumsum(size) - size
        who = np.repeat(np.arange(len(i)), size)
        at = np.arange(size.sum()) - start[who] + low[who]
        value = v[at] + (i[who] - j[at]) ** 2
        hit = np.flatnonzero(value == np.minimum.reduceat(value, start)[who])
        best[i] = at[hit[np.searchsorted(who[hit], np.arange(len(i)))]]
        if step == 1:
            return v[best] + (np.arange(n) - j[best]) ** 2
        step >>= 1
        i = np.arange(step, n, 2 * step)
        if not len(i):
            i = np.zeros(1, np.int64)      # nothing new at this step
        low = np.where(i >= step, best[np.maximum(i - step, 0)], 0)
        high = np.where((i > 0) & (i + step < n), best[np.minimum(i + step, n - 1)], len(j) - 1)


def _nearest(g: np.ndarray, side: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The least of ``side`` and min over j of g[j] + (i - j)**2, j within the run."""
    best = np.minimum(g, side)
    run = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    for k in range(1, min(_SHIFTS, len(g) - 1) + 1):
        if best.max() <= k * k:
            break
        same = run[k:] == run[:-k]
        here, there = best[k:], best[:-k]
        np.minimum(here, np.where(same, g[:-k] + k * k, _FAR), out=here)
        np.minimum(there, np.where(same, g[k:] + k * k, _FAR), out=there)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a > _SHIFTS and best[a:b].max() > _SHIFTS * _SHIFTS:
            best[a:b] = np.minimum(best[a:b], _envelope(g[a:b]))
    return best


def _by_line(batches: Iterator[pa.RecordBatch], line: str, done) -> Iterator[pa.RecordBatch]:
    """``done`` on whole lines of rows sorted by (scene, line); a task holds one line and one batch."""
    held: list[pa.RecordBatch] = []

    def flush():
        t = pa.Table.from_batches(held).combine_chunks()
        yield from done({c: t.column(c).to_numpy() for c in t.column_names}).to_batches()

    for b in batches:
        if not b.num_rows:
            continue
        scene, at = b.column("scene_id").to_numpy(), b.column(line).to_numpy()
        same = (scene == scene[-1]) & (at == at[-1])
        tail = int(np.argmax(same)) if not same.all() else 0
        if held:
            last = held[-1]
            joins = last.column("scene_id")[-1].as_py() == scene[-1] and last.column(line)[-1].as_py() == at[-1]
            if tail == 0 and joins:          # one line goes on through the whole batch
                held.append(b)
                continue
        if tail:
            held.append(b.slice(0, tail))
        if held:
            yield from flush()
        held = [b.slice(tail)]
    if held:
        yield from flush()


def distance_transform(mask: DataFrame, scenes: DataFrame, tile: int = TILE) -> DataFrame:
    """Squared distance ``d2`` (integer) and ``distance`` of each mask pixel to
    the nearest background pixel of its scene; NULL in a scene without one.

    Pass one: distance within the column from the pixel's vertical run. Pass
    two: within the row only pixels of the same horizontal run can hold the
    minimum; near ones are compared by shifting, long reaches by the lower
    envelope, in linear time. Rows are laid out by column, then by row, and
    streamed line by line: a task holds one line of pixels, never a scene beyond
    the size of a few tiles.
    """
    px = mask.select("scene_id", "y", "x").join(scenes.select("scene_id", "height", "width"), "scene_id").select(
        F.col("scene_id").cast("bigint").alias("scene_id"), *[F.col(c).cast("bigint").alias(c) for c in ("y", "x", "height", "width")])

    def down(c: dict) -> pa.Table:
        line = np.stack([c["scene_id"], c["x"]])
        new = (line[:, 1:] != line[:, :-1]).any(0)
        key = np.concatenate([[0], np.cumsum(new)])
        g = _to_gap(c["y"], c["height"], _runs(key, c["y"]))
        return pa.table({"scene_id": c["scene_id"], "y": c["y"], "x": c["x"], "width": c["width"], "g": g})

    def along(c: dict) -> pa.Table:
        line = np.stack([c["scene_id"], c["y"]])
        key = np.concatenate([[0], np.cumsum((line[:, 1:] != line[:, :-1]).any(0))])
        cuts = _runs(key, c["x"])
        d2 = _nearest(c["g"], _to_gap(c["x"], c["width"], cuts), cuts)
        return pa.table({"scene_id": c["scene_id"], "y": c["y"].astype(np.int32), "x": c["x"].astype(np.int32),
                         "d2": pa.array(d2, mask=d2 >= _FAR)})

    # a scene of bounded size is one group, both passes in one task
    small, px = px.where(is_whole(tile)), px.where(~is_whole(tile))

    def both(key: tuple, table: pa.Table) -> pa.Table:
        y, x = flat(table, "y"), flat(table, "x")
        c = {"scene_id": np.full(len(y), key[0].as_py()), "height": np.full(len(y), table.column("height")[0].as_py()),
             "width": np.full(len(y), table.column("width")[0].as_py())}
        order = np.lexsort((y, x))
        t = down(c | {"y": y[order], "x": x[order]})
        c = {name: t.column(name).to_numpy() for name in t.column_names}
        order = np.lexsort((c["x"], c["y"]))
        return along({name: v[order] for name, v in c.items()})

    kind = "scene_id bigint, y int, x int, d2 bigint"
    near = spread(packed(small, ["scene_id", "height", "width"], ["y", "x"]), "scene_id").groupBy("scene_id").applyInArrow(both, kind)
    cols = px.repartition("scene_id", "x").sortWithinPartitions("scene_id", "x", "y").mapInArrow(
        lambda b: _by_line(b, "x", down), "scene_id bigint, y bigint, x bigint, width bigint, g bigint")
    rows = cols.repartition("scene_id", "y").sortWithinPartitions("scene_id", "y", "x").mapInArrow(
        lambda b: _by_line(b, "y", along), kind)
    return near.unionByName(rows).withColumn("distance", F.sqrt(F.col("d2").cast("double")))
