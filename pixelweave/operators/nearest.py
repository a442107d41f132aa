"""Exact nearest neighbours with metric pruning.

Training rows are grouped by the nearest of a bounded number of pivots. A group
knows the least and greatest distance of its rows to its pivot, so by the
triangle inequality no row of it is nearer to a query q than
``max(d(q, pivot) - greatest, least - d(q, pivot))``. A query opens its groups in
the order of that bound, in rounds: the first that hold k rows, then a few, then
the rest, each as far as the bound does not exceed its k-th distance so far.
Groups that cannot win are never shipped to it.

A task holds one block of a group's rows and one slice of the queries that open
the group; both are cut by key hashes, so a hot group is many tasks. Blocks and
slices are bounded by the values that a task holds: a query is sent once to each
block of a group, so small ones would multiply what is shipped. Where bounds rule
nothing out, as in many dimensions, every query meets every row; a block then
costs little more than one matrix product, and only rows within a query's k-th
distance so far are measured exactly and returned.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage, drop_tables
from .features import hash52
from .stats import top_per_group

PIVOTS = 64         # also the most groups that a query is sent to
_TASK_VALUES = 1 << 20      # vector values of one block or slice
_AHEAD = 4          # groups opened in the second round


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots, in slices of bounded size."""
    out = np.empty((len(x), len(pivots)))
    step = max(1, (1 << 22) // max(1, pivots.size))
    for at in range(0, len(x), step):
        out[at:at + step] = np.sqrt(((x[at:at + step, None] - pivots[None]) ** 2).sum(2))
    return out


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _usable(feature: str) -> Column:
    f = F.col(feature).cast("array<double>")
    return F.coalesce((F.size(f) > 0) & F.forall(f, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False))


def _grouped(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add ``_g``, the nearest pivot (lower number on ties), and ``_d``, its distance."""
    def run(batches):
        for b in batches:
            d = _distances(_vectors(b.column("_f")), pivots)
            g = d.argmin(1) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(g, pa.int32()), pa.array(d[np.arange(len(g)), g])],
                                             names=[*b.schema.names, "_g", "_d"])

    fields = ", ".join(f"{n} {t}" for n, t in train.dtypes)
    return train.mapInArrow(run, f"{fields}, _g int, _d double")


def _opened(queries: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, rows: np.ndarray, k: int,
            stage: int) -> DataFrame:
    """(key, _f, _tau, _g): the groups that a query opens at a stage, given its k-th
    distance so far (``_tau``). The order of groups is the same at every stage."""
    kind = dict(queries.dtypes)["_q"]
    held = np.flatnonzero(rows)

    def run(batches):
        for b in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            d = _distances(_vectors(b.column("_f")), pivots[held])
            # the slack covers the rounding of the distances
            bound = np.maximum(np.maximum(d - high[held], low[held] - d) - 1e-9 * (1 + d + high[held]), 0)
            order = np.lexsort((d, bound), axis=1)
            sure = (np.cumsum(rows[held][order], 1) < k).sum(1) + 1        # the first groups that hold k rows
            place = np.arange(len(held))[None]
            if stage == 0:
                take = place < sure[:, None]
            else:
                tau = b.column("_tau").to_numpy(zero_copy_only=False)[:, None]
                fits = np.take_along_axis(bound, order, 1) <= tau * (1 + 1e-9)
                ahead = sure[:, None] + _AHEAD
                take = fits & (place >= sure[:, None]) & ((place < ahead) if stage == 1 else (place >= ahead))
            row, col = np.nonzero(take)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("_q").take(at), b.column("_f").take(at), b.column("_tau").take(at), pa.array(held[order[row, col]], pa.int32())],
                                             names=["_q", "_f", "_tau", "_g"])

    return queries.mapInArrow(run, f"_q {kind}, _f array<double>, _tau double, _g int")


def _compare(k: int, kind: str, train_kind: str):
    """Up to k candidates per query of a slice in a block of training rows, none beyond ``_tau``."""
    def near(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(ts):
            return pd.DataFrame({"_q": [], "d": [], "tk": [], "l": []})
        ts = ts.sort_values("_tk")
        x, y = np.stack(qs["_f"].to_numpy()), np.stack(ts["_f"].to_numpy())
        middle = y.mean(0)          # the expansion below cancels less about the middle
        x, y = x - middle, y - middle
        keys, lab, ids, n, size = qs["_q"].to_numpy(), ts["_l"].to_numpy(), ts["_tk"].to_numpy(), min(k, len(ts)), (y ** 2).sum(1)
        reach = qs["_tau"].to_numpy(float) ** 2 * (1 + 1e-9)
        out = []
        for i in range(0, len(x), 256):
            part = x[i:i + 256]
            own = (part ** 2).sum(1)
            rough = part @ (-2 * y.T)
            rough += own[:, None]
            rough += size[None]
            # all rows that rounding may put among the nearest n are measured exactly
            slack = 1e-9 * (own + size.max(initial=0) + 1)
            limit = reach[i:i + 256] + slack
            many = np.flatnonzero((rough <= limit[:, None]).sum(1) > 4 * n)
            if len(many):
                limit[many] = np.minimum(limit[many], np.partition(rough[many], n - 1, axis=1)[:, n - 1] + slack[many])
            row, col = np.nonzero(rough <= limit[:, None])
            exact = ((part[row] - y[col]) ** 2).sum(1)
            order = np.lexsort((col, exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            some = rank < n
            out.append(pd.DataFrame({"_q": keys[i:i + 256][row[some]], "d": np.sqrt(exact[some]), "tk": ids[col[some]], "l": lab[col[some]]}))
        return pd.concat(out)

    return near, f"_q {kind}, d double, tk {train_kind}, l int"


def nearest(queries: DataFrame, train: DataFrame, key: str, feature: str, label: str, k: int = 1, block_rows: int = 4096,
            opened: list[int] | None = None) -> DataFrame:
    """(key, d, tk, l): the k nearest training rows of each query with a usable
    vector, by distance, then by training key.

    Vectors of a table have one length. Training rows with an unusable vector
    (NULL, empty, or with NULL or non-finite values) or without a label take no
    part. There is a pivot for every ``block_rows`` training rows, up to
    ``PIVOTS``. ``opened`` receives, per round, how many groups queries opened.
    """
    kind, train_kind = dict(queries.dtypes)[key], dict(train.dtypes)[key]
    q = queries.where(_usable(feature)).select(F.col(key).alias("_q"), F.col(feature).cast("array<double>").alias("_f"))
    t = train.where(_usable(feature) & F.col(label).isNotNull()).select(
        F.col(key).alias("_tk"), F.col(label).cast("int").alias("_l"), F.col(feature).cast("array<double>").alias("_f"))
    empty = q.select("_q", F.lit(0.0).alias("d"), F.lit(None).cast(train_kind).alias("tk"), F.lit(0).alias("l")).limit(0)
    n = t.count()
    if not n:
        return empty.withColumnRenamed("_q", key)
    count = min(PIVOTS, -(-n // block_rows))
    pivots = np.array([r["_f"] for r in t.orderBy(hash52(F.col("_tk")), "_tk").limit(count).collect()])
    t = cut_lineage(_grouped(t, pivots))
    rows, low, high = np.zeros(count, np.int64), np.zeros(count), np.zeros(count)
    for r in t.groupBy("_g").agg(F.count("*").alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi")).collect():      # at most PIVOTS rows
        rows[r["_g"]], low[r["_g"]], high[r["_g"]] = r["n"], r["lo"], r["hi"]
    most = max(block_rows, _TASK_VALUES // max(1, pivots.shape[1]))
    blocks = np.maximum(1, -(-rows // most))

    def part(column: str, number: np.ndarray) -> Column:
        return F.pmod(F.xxhash64(column), F.array(*[F.lit(int(v)) for v in number])[F.col("_g")]).cast("int")

    def every(number: np.ndarray) -> Column:
        return F.explode(F.sequence(F.lit(0), F.array(*[F.lit(int(v) - 1) for v in number])[F.col("_g")]))

    near, schema = _compare(k, kind, train_kind)
    best, asking = None, q.withColumn("_tau", F.lit(float("inf")))
    for stage in range(3):
        routed = cut_lineage(_opened(asking, pivots, low, high, rows, k, stage))
        load = np.zeros(count, np.int64)
        for r in routed.groupBy("_g").agg(F.count("*").alias("n")).collect():
            load[r["_g"]] = r["n"]
        if opened is not None:
            opened.append(int(load.sum()))
        if load.any():
            slices = np.maximum(1, -(-load // most))
            qs = routed.withColumn("_s", part("_q", slices)).withColumn("_b", every(blocks))
            ts = t.withColumn("_b", part("_tk", blocks)).where(F.col("_g").isin([int(g) for g in np.flatnonzero(load)])).withColumn("_s", every(slices))
            found = qs.groupBy("_g", "_b", "_s").cogroup(ts.groupBy("_g", "_b", "_s")).applyInPandas(near, schema)
            found = found if best is None else found.unionByName(best)
            used = [best] if best is not None else []
            # at most k rows per query and block
            best = cut_lineage(top_per_group(found, ["_q"], [F.col("d"), F.col("tk")], k, "_r").drop("_r"), *used)
        drop_tables(routed)
        if count == 1:
            break
        if stage < 2 and best is not None:
            tau = best.groupBy("_q").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("_tau"))
            asking = q.join(tau, "_q")
    return (empty if best is None else best).withColumnRenamed("_q", key)


def knn_classify(queries: DataFrame, train: DataFrame, key: str, feature: str, label: str, k: int = 1,
                 block_rows: int = 4096, opened: list[int] | None = None) -> DataFrame:
    """(key, prediction): majority label of the k nearest training rows
    (Euclidean), lowest label on equal votes; NULL for a query without a usable
    vector. Query keys are unique."""
    got = nearest(queries, train, key, feature, label, k, block_rows, opened)
    if k == 1:
        named = got.select(key, F.col("l").alias("prediction"))
    else:
        votes = got.groupBy(key, "l").agg(F.count("*").alias("n"))
        named = votes.groupBy(key).agg(F.max_by("l", F.struct("n", -F.col("l"))).alias("prediction"))
    return queries.select(key).join(named, key, "left")
