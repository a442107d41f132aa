"""Box overlap and greedy suppression without forming all pairs."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage


def iou(a: str, b: str) -> Column:
    """Overlap of two struct columns with x0, y0, x1, y1 (half-open)."""
    w = F.greatest(F.lit(0.0), (F.least(f"{a}.x1", f"{b}.x1") - F.greatest(f"{a}.x0", f"{b}.x0")).cast("double"))
    h = F.greatest(F.lit(0.0), (F.least(f"{a}.y1", f"{b}.y1") - F.greatest(f"{a}.y0", f"{b}.y0")).cast("double"))
    inter = w * h

    def area(s: str) -> Column:
        return (F.col(f"{s}.x1") - F.col(f"{s}.x0")).cast("double") * (F.col(f"{s}.y1") - F.col(f"{s}.y0"))

    return inter / (area(a) + area(b) - inter)


_SPAN = 16      # sides of a cell, in sides of its boxes, at most; the first round begins with one
_LIST = 256    # boxes that a cell may find kept or leave open in a round
_SLICE = 256    # boxes of a cell that are judged together


def _exponent(lo: str, hi: str, t: float) -> Column:
    """Whole parts are the size classes of a side; partners lie within half a class."""
    return F.log((F.col(hi) - F.col(lo)).cast("double")) / (2 * math.log(1 / t))


def _reach(df: DataFrame, t: float, sides: int) -> DataFrame:
    """One row per cell (``_qw``, ``_qh``, ``_qx``, ``_qy``) that may hold a
    partner of the box; ``_own`` in the cell of the box itself. Boxes with an
    overlap above t have widths (heights) within a factor t, and centres within
    (1-t) of the larger width (height), so partners lie in few cells."""
    own = F.lit(True)
    for lo, hi, q, at in (("x0", "x1", "_qw", "_qx"), ("y0", "y1", "_qh", "_qy")):
        e, side = _exponent(lo, hi, t), (F.col(hi) - F.col(lo)).cast("double")
        df = df.withColumn(q, F.explode(F.sequence(F.floor(e - 0.5 - 1e-9), F.floor(e + 0.5 + 1e-9))))
        size = F.exp((F.col(q) + 1) * (2 * math.log(1 / t)))         # upper end of the class
        span = F.greatest(side, F.least(side / t, size)) * ((1 - t) * (1 + 1e-9))
        c, cell = (F.col(lo) + F.col(hi)) / 2.0, size * sides
        df = df.withColumn(at, F.explode(F.sequence(F.floor((c - span) / cell), F.floor((c + span) / cell))))
        own = own & (F.col(q) == F.floor(e)) & (F.col(at) == F.floor(c / cell))
    return df.withColumn("_own", own)


def _overlap(a: np.ndarray, b: np.ndarray, t: float) -> np.ndarray:
    """Which boxes of ``a`` (4, n) overlap which of ``b`` (4, m) above t."""
    w = np.minimum(a[2][:, None], b[2]) - np.maximum(a[0][:, None], b[0])
    h = np.minimum(a[3][:, None], b[3]) - np.maximum(a[1][:, None], b[1])
    inter = np.maximum(w, 0.0, out=w) * np.maximum(h, 0.0, out=h)
    area = ((a[2] - a[0]) * (a[3] - a[1]))[:, None] + (b[2] - b[0]) * (b[3] - b[1])
    return inter / (area - inter) > t


class _Pile:
    """Boxes as columns of one array that grows."""

    def __init__(self):
        self.room, self.n = np.empty((4, 64)), 0

    def add(self, boxes: np.ndarray) -> None:
        n = self.n + boxes.shape[1]
        if n > self.room.shape[1]:
            self.room = np.concatenate([self.room, np.empty((4, 2 * n))], 1)
        self.room[:, self.n:n], self.n = boxes, n

    def hit(self, boxes: np.ndarray, t: float) -> np.ndarray:
        return _overlap(boxes, self.room[:, :self.n], t).any(1)


class _Cell:
    """The boxes of a cell that are kept or open so far."""

    def __init__(self):
        self.kept, self.open, self.found = _Pile(), _Pile(), 0

    def judge(self, box: np.ndarray, own: np.ndarray, t: float) -> np.ndarray:
        """1 kept, 0 open, -1 dropped, for the next best boxes of the cell."""
        out = np.where(self.kept.hit(box, t), -1, 0)
        rest = np.flatnonzero(out == 0)
        if self.found >= _LIST or not len(rest):        # beyond the list, what is better may be missing here
            return out
        some = box[:, rest]
        # a box from another cell has partners that are not seen here
        sure = own[rest] & ~self.open.hit(some, t)
        alive, inner = np.ones(len(rest), bool), np.tril(_overlap(some, some, t), -1)
        for j in np.flatnonzero(inner.any(1)):
            better = inner[j]
            if sure[better].any():
                alive[j] = sure[j] = False
            elif alive[better].any():
                sure[j] = False
        out[rest] = np.where(alive, sure, -1)
        self.kept.add(some[:, sure])
        self.open.add(some[:, alive & ~sure])
        self.found += int(alive.sum())
        return out


def _settle(t: float, place: list[str], names: list[str]):
    """Decide the boxes of each cell, best first, from rows sorted by cell, with
    the boxes kept in the round before in front. These and at most about
    ``_LIST`` others are held; the boxes after them are dropped at a kept one or
    stay open."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, cell = None, _Cell()
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in place), strict=True))
            corners = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x0", "y0", "x1", "y1")])
            state, own = (np.array(batch.column(c).to_pylist()) for c in ("_state", "_own"))
            new = np.full(len(keys), -1)
            ends = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)] if keys else []
            begin = 0
            for end in ends:
                if keys[begin] != last:
                    last, cell = keys[begin], _Cell()
                    if end < len(keys) and not own[begin:end].any():
                        begin = end             # nothing to decide here
                        continue
                at = begin + int(state[begin:end].sum())
                cell.kept.add(corners[:, begin:at])
                new[begin:at] = 2
                while at < end:
                    to = min(end, at + max(16, min(_SLICE, (1 << 20) // max(1, cell.kept.n))))
                    new[at:to] = cell.judge(corners[:, at:to], own[at:to], t)
                    at = to
                begin = end
            some = np.flatnonzero(own & (new >= 0)) if keys else np.zeros(0, np.int64)
            at = pa.array(some)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(new[some], pa.int32())], names=[*names, "_state"])

    return run


def box_nms(boxes: DataFrame, threshold: float = 0.7, key: str = "mask_id", score: str = "score",
            group: str = "patch_idx", rounds: list[int] | None = None) -> DataFrame:
    """Greedy suppression per group: best score first (lower key on ties), a
    box overlapping a kept one above ``threshold`` is dropped.

    Boxes are decided in cells of similar width, height and place, best first: a
    box is dropped at a kept one, kept when nothing better overlaps it, and stays
    open while a better open one does. A cell also sees the boxes around it that
    reach in, so only chains that cross cells need another round, as do boxes
    behind the best of a crowded cell, most of which then fall at kept ones: the
    work of a box is bounded however many lie in one place. Cells grow from round
    to round; ``rounds`` receives the open boxes after each. Equal boxes of a
    group are first reduced to their best, which is exact. Boxes without an inside overlap nothing and
    are kept, as are boxes with a missing corner. Keys are unique in a group.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    t = float(threshold)
    place = [group, "x0", "y0", "x1", "y1"]
    cell = [group, "_qw", "_qh", "_qx", "_qy"]
    boxes = cut_lineage(boxes)
    inside = F.coalesce((F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")), F.lit(False))
    todo = cut_lineage(
        boxes.where(inside).groupBy(*place).agg(F.max(F.struct(F.col(score).alias("s"), (-F.col(key)).alias("n"))).alias("_r"))
        .select(*place, F.col("_r.s").alias("_s"), F.col("_r.n").alias("_n"), F.lit(0).alias("_state")))
    names = [c for c in todo.columns if c != "_state"]
    schema = ", ".join(f"{c} {kind}" for c, kind in todo.dtypes)
    sides = 1
    while True:
        # states: 0 open, 1 kept in the last round, 2 kept and seen by all others
        sent = _reach(todo.where("_state < 2"), t, sides).repartition(*cell).sortWithinPartitions(
            *cell, F.desc("_state"), F.desc("_s"), F.desc("_n"), *place[1:])
        todo = cut_lineage(sent.mapInArrow(_settle(t, cell, names), schema).unionByName(todo.where("_state = 2")), todo)
        left = todo.where("_state = 0").count()
        if rounds is not None:
            rounds.append(left)
        if not left:
            break
        sides = min(2 * sides, _SPAN)
    ids = todo.select(F.col(group).alias("_g"), (-F.col("_n")).alias("_id"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col(key) == F.col("_id"))
    return boxes.where(inside).join(ids, same, "left_semi").unionByName(boxes.where(~inside))
