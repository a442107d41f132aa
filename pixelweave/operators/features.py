"""Feature vectors: grids, sampling, clustering, projection, classification.

Distances and dot products against a few fixed vectors run as Arrow UDFs: a
batch of vectors is one matrix product, where array lambdas would box every
element. The fixed vectors (centres, class weights) are driver values of
bounded size: clusters x dimensions, never data rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .. import fixed_values as fv
from ..functions import vectors as vec
from ..session import cut_lineage, drop_tables
from .hashing import hashes52
from .packing import pack_runs, spread
from .stats import order_statistics, top_per_group


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, validity of the rows): NULL rows have no vector."""
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    some = column.drop_null()
    flat = some.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (flat.reshape(len(some), -1) if len(some) else flat.reshape(0, 0)), valid


# --- grids ------------------------------------------------------------------

def tokens_to_grid(images: DataFrame, tokens: str, registers: int, wp: str = "wp") -> DataFrame:
    """One row per patch token: drop the class and register tokens, place the
    rest row by row. ``images`` has one array of token vectors per image."""
    keep = [c for c in images.columns if c != tokens]
    patch = F.slice(tokens, 2 + registers, F.greatest(F.size(tokens) - 1 - registers, F.lit(0)))
    return images.select(*keep, F.posexplode(patch).alias("_pos", "feature")).select(
        *keep, F.floor(F.col("_pos") / F.col(wp)).cast("int").alias("gy"),
        (F.col("_pos") % F.col(wp)).cast("int").alias("gx"), "feature")


def labels_to_grid(labels: DataFrame, position: str, width: int) -> DataFrame:
    return labels.withColumn("gy", F.floor(F.col(position) / width).cast("int")).withColumn(
        "gx", (F.col(position) % width).cast("int"))


# --- sampling ---------------------------------------------------------------

def hash52(key: Column, seed: int = 0) -> Column:
    """A uniform whole number below 2**52 from the key's md5, exact as double."""
    text = F.concat(key.cast("string"), F.lit(f":{seed}")) if seed else key.cast("string")
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The ``n`` rows with the lowest key hashes (all, if there are fewer).

    The n-th lowest hash is found by counting, then rows under it are kept by
    a filter; nothing is sorted or gathered. Equal hashes are cut by key.
    """
    hashed = df.withColumn("_h", hash52(F.col(key), seed))
    cut = cut_lineage(order_statistics(
        hashed, [], ["_h"],
        lambda total: F.array(F.struct(F.lit(0).alias("slot"),
                                       (F.least(F.lit(n).cast("bigint"), total) - 1).alias("rank"))),
    ).select(F.col("value").cast("bigint").alias("_t"), F.col("skip").alias("_s"), F.lit(1).alias("_one")))
    marked = hashed.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one")   # one row
    below = marked.where(F.col("_h") < F.col("_t")).select(*df.columns)
    at = marked.where(F.col("_h") == F.col("_t"))
    at = top_per_group(at, ["_h"], [F.col(key)], n, "_r").where(F.col("_r") <= F.col("_s") + 1)
    return below.unionByName(at.select(*df.columns))


def split_80_20(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Adds ``part``: 'train' for four fifths of the keys, else 'val'."""
    return df.withColumn("part", F.when(hash52(F.col(key), seed) % 100 < 80, "train").otherwise("val"))


# --- clustering -------------------------------------------------------------

def label_means(df: DataFrame, label: str, feature: str) -> list[list[float]]:
    """Mean vector per label, ordered by label. Rows come back to the driver:
    one per label."""
    rows = df.groupBy(label).agg(
        Summarizer.mean(array_to_vector(F.col(feature).cast("array<double>"))).alias("m")).collect()
    return [r["m"].toArray().tolist() for r in sorted(rows, key=lambda r: r[label])]


def _distances(centers: Sequence[Sequence[float]]):
    c = np.asarray(centers, np.float64)

    @F.arrow_udf("array<double>")
    def fn(v: pa.Array) -> pa.Array:
        x, valid = _matrix(v)
        out = np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(x) else np.zeros((0, len(c)))
        ends = np.concatenate([[0], np.cumsum(valid * len(c))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=pa.array(~valid))

    return fn


def assign_clusters(df: DataFrame, feature: str, centers: Sequence[Sequence[float]],
                    name: str = "cluster") -> DataFrame:
    """Nearest centre by Euclidean distance, lowest id on ties; NULL without a vector."""
    d = _distances(centers)(F.col(feature).cast("array<double>"))
    return df.withColumn("_d", d).withColumn(
        name, (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def kmeans_step(df: DataFrame, feature: str, centers: Sequence[Sequence[float]], key: str,
                seed: int = 0) -> DataFrame:
    """One update: (cluster, n, center). An empty cluster takes the row with
    the lowest hash for that cluster."""
    k = len(centers)
    df = df.where(F.col(feature).isNotNull())
    got = assign_clusters(df, feature, centers)
    means = got.groupBy("cluster").agg(
        F.count("*").alias("n"),
        vector_to_array(Summarizer.mean(array_to_vector(F.col(feature).cast("array<double>")))).alias("_mean"))
    means = cut_lineage(means)
    empty = sorted(set(range(k)) - {r[0] for r in means.select("cluster").collect()})     # at most k ids
    if not empty:
        return means.select("cluster", "n", F.col("_mean").alias("center"))
    spare = df.agg(*[
        F.min_by(F.col(feature).cast("array<double>"), F.struct(hash52(F.col(key), seed + 1 + j), F.col(key))).alias(f"s{j}")
        for j in empty
    ]).select(F.explode(F.array(*[F.struct(F.lit(j).alias("cluster"), F.lit(0).cast("bigint").alias("n"), F.col(f"s{j}").alias("center"))
                                  for j in empty])).alias("_s")).select("_s.*")
    return means.select("cluster", "n", F.col("_mean").alias("center")).unionByName(spare)


def kmeans_iterate(df: DataFrame, feature: str, key: str, k: int = 2, iters: int = 20,
                   tol: float = 1e-4, seed: int = 0) -> list[list[float]]:
    """Centres after repeated updates from k hashed start rows, until the
    largest centre shift is below ``tol``."""
    df = cut_lineage(df.select(key, feature))
    start = sample_rows(df, key, k, seed).orderBy(hash52(F.col(key), seed), key).select(feature).collect()
    centers = np.array([r[0] for r in start], float)
    for _ in range(iters):
        rows = kmeans_step(df, feature, centers, key, seed).orderBy("cluster").collect()
        new = np.array([r["center"] for r in rows])
        shift = np.linalg.norm(new - centers, axis=1).max()
        centers = new
        if shift < tol:
            break
    return centers.tolist()


def kmeans_fit(df: DataFrame, feature: str, k: int, seed: int = 0, max_iter: int = 100,
               normalize: bool = False, sample: tuple[str, int] | None = None, starts: int = fv.KMEANS_STARTS):
    """Fitted k-means model and the labelled rows (column ``cluster``, NULL
    without a vector): of ``starts`` fits with k-means|| seeding the one with
    the least sum of squared distances, the earlier one on ties.

    ``sample=(key, n)`` fits on a hashed sample and labels all rows.
    """
    f = vec.l2_normalize(F.col(feature)) if normalize else F.col(feature).cast("array<double>")
    some = df.where(F.col(feature).isNotNull())
    data = some.withColumn("_v", array_to_vector(f))
    fit_on = sample_rows(some, *sample).withColumn("_v", array_to_vector(f)) if sample else data
    models = [KMeans(k=k, seed=seed + s, maxIter=max_iter, featuresCol="_v", predictionCol="cluster").fit(fit_on) for s in range(starts)]
    model = min(models, key=lambda m: m.summary.trainingCost)
    none = df.where(F.col(feature).isNull()).withColumn("cluster", F.lit(None).cast("int"))
    return model, model.transform(data).drop("_v").unionByName(none)


def cluster_counts(labels: DataFrame, label: str, k: int) -> DataFrame:
    """Members per cluster 0..k-1, zero-filled."""
    ids = labels.sparkSession.range(k).select(F.col("id").cast("int").alias(label))
    n = labels.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n"))
    return ids.join(n, label, "left").select(label, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _squared(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _starts(keys: Sequence[str]) -> list[str]:
    return [*keys, "start"]


_IN_ONE_TASK = 1_000_000     # rows of a group
_TEXT_KEYS = ("bigint", "int", "smallint", "tinyint", "string")


class Vectors(NamedTuple):
    """Vectors packed by group: (keys, n) of the groups; the length of all vectors,
    or None if lengths differ, a value is missing or not finite, or a key is
    missing; the table (keys, _k, _f) of packed rows."""

    groups: DataFrame
    size: int | None
    rows: DataFrame


def pack_vectors(df: DataFrame, feature: str, keys: Sequence[str], key: str | None = None) -> Vectors:
    """The rows with a vector, packed and looked at in one pass."""
    some = df.where(F.col(feature).isNotNull()).select(*keys, F.col(feature).cast("array<double>").alias("_f"), *([F.col(key).alias("_k")] if key else []))
    kinds = dict(some.dtypes)
    cols = ["_f", "_k"] if key else ["_f"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            size, v = b.column("_f").value_lengths(), b.column("_f").flatten()
            fine = not v.null_count and bool(np.isfinite(v.to_numpy(zero_copy_only=False)).all()) and not (key and b.column("_k").null_count)
            out = pack_runs(b, keys, cols)
            looks = [pc.list_value_length(out.column("_f")).cast(pa.int64()), pa.array([fine] * out.num_rows),
                     *(pa.array([end(size).as_py()] * out.num_rows, pa.int32()) for end in (pc.min, pc.max))]
            yield pa.RecordBatch.from_arrays([*out.columns, *looks], names=[*out.schema.names, "_n", "_fine", "_low", "_high"])

    rows = cut_lineage(some.mapInArrow(pack, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{c} array<{kinds[c]}>" for c in cols),
                                                        "_n bigint, _fine boolean, _low int, _high int"])))
    all_ = rows.agg(F.bool_and("_fine"), F.min("_low"), F.max("_high")).first()
    groups = cut_lineage(rows.groupBy(*keys).agg(F.sum("_n").alias("n")))
    return Vectors(groups, all_[1] if all_[0] and 0 < all_[1] == all_[2] else None, rows)


def scene_centers(df: DataFrame, feature: str, key: str, k: int, keys: Sequence[str], seed: int = 0, starts: int = 1,
                  vectors: Vectors | None = None) -> DataFrame:
    """(keys, start, cluster, center): start centres of each group, by D-squared
    sampling. The first of a start is the row of lowest key hash; each next one
    is a row drawn with a chance in proportion to its squared distance from the
    centres so far: the least of -ln(u) / d2, with u from the key's hash. A draw
    is one aggregation for all groups and starts. A group with fewer distinct
    rows has fewer centres. Whole vectors with plain keys are drawn in batches:
    each passes on its best row per group and start. ``vectors`` are
    these rows packed with their keys, where that was done before."""
    keys = list(keys)
    if dict(df.dtypes)[key] in _TEXT_KEYS:
        vectors = vectors or pack_vectors(df, feature, keys, key)
    rows = vectors.rows.select(*keys, "_k", F.col("_f").alias("center")) if vectors and vectors.size else None
    size = vectors.size if vectors else None
    if rows is None:
        some = cut_lineage(df.where(F.col(feature).isNotNull()).select(*keys, F.col(key).alias("_k"), F.col(feature).cast("array<double>").alias("center")))
    kind = dict(df.dtypes)[key]
    every = F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))

    def uniform(step: int) -> Column:
        text = F.concat_ws(":", F.col("_k").cast("string"), F.lit(str(seed)), F.col("start").cast("string"), F.lit(str(step)))
        return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)

    def best(step: int, held: DataFrame | None) -> DataFrame:
        """The rows of each packed row that its starts would draw: (keys, start, _o, _k, center)."""
        with_ = rows
        if held is not None:
            by = held.groupBy(*_starts(keys)).agg(F.collect_list("center").alias("_c"))      # at most k centres
            by = by.groupBy(*keys).agg(F.collect_list(F.struct("start", "_c")).alias("_s"))
            with_ = rows.join(by, keys) if keys else rows.crossJoin(F.broadcast(by))
        drawn_before = held is not None
        ends = [f":{seed}:{s}:{step}" for s in range(starts)]
        if step == 0:
            ends[0] = f":{seed}" if seed else ""

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                at, start, order, name, center = [], [], [], [], []
                for i in range(b.num_rows):
                    text, v = b.column("_k")[i].values, b.column("center")[i].values
                    x = v.flatten().to_numpy().reshape(-1, size)
                    fits = [(f["start"], f["_c"]) for f in b.column("_s")[i].as_py()] if drawn_before else [(j, None) for j in range(starts)]
                    u = (hashes52(text.cast(pa.string()), [ends[j] for j, _ in fits]) + 0.5) / float(1 << 52)
                    for (j, c), o in zip(fits, u, strict=True):
                        rest = np.arange(len(o))
                        if c is not None:
                            gap = np.min([sum((one[e] - x[:, e]) ** 2 for e in range(size)) for one in c], 0)
                            rest = np.flatnonzero(gap > 0)
                            o = -np.log(o[rest]) / gap[rest]
                        if not len(rest):
                            continue
                        for r in rest[o == o.min()].tolist():
                            at.append(i)
                            start.append(j)
                            order.append(float(o.min()))
                            name.append(text[r])
                            center.append(x[r])
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(where) for c in keys), pa.array(start, pa.int32()), pa.array(order, pa.float64()),
                     pa.array(name, b.schema.field("_k").type.value_type), pa.array(center, pa.list_(pa.float64()))], names=[*keys, "start", "_o", "_k", "center"])

        kinds = dict(rows.dtypes)
        return with_.mapInArrow(draw, ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), f"start int, _o double, _k {kind}, center array<double>"]))

    if rows is not None:
        first = best(0, None).groupBy(*_starts(keys)).agg(F.min_by("center", F.struct("_o", "_k")).alias("center"))
    else:
        order = F.when(F.col("start") == 0, hash52(F.col("_k"), seed).cast("double")).otherwise(uniform(0))
        first = some.withColumn("start", every).groupBy(*_starts(keys)).agg(F.min_by("center", F.struct(order, "_k")).alias("center"))
    held = cut_lineage(first.select(*_starts(keys), F.lit(0).alias("cluster"), "center"))
    for step in range(1, k):
        if rows is not None:
            drawn = best(step, held).groupBy(*_starts(keys)).agg(F.min_by("center", F.struct("_o", "_k")).alias("center"))
        else:
            by = held.groupBy(*_starts(keys)).agg(F.collect_list("center").alias("_c"))      # at most k centres
            d2 = F.array_min(F.transform("_c", lambda c: _squared(c, F.col("center"))))
            drawn = some.join(by, keys).withColumn("_d", d2).where("_d > 0").groupBy(*_starts(keys)).agg(F.min_by("center", F.struct(-F.log(uniform(step)) / F.col("_d"), "_k")).alias("center"))
        held = cut_lineage(held.unionByName(drawn.select(*_starts(keys), F.lit(step).alias("cluster"), "center")), held)
    if rows is None:
        drop_tables(some)
    return held


def _nearest_of(centers: DataFrame, by: Sequence[str]) -> DataFrame:
    """The centres of each group as one array of clusters x dimensions."""
    return centers.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("cluster", "center"))).alias("_c"))


def _gaps(f: Column, packed) -> Column:
    return F.array_min(F.transform(packed, lambda c: F.struct(_squared(c["center"], f).alias("d"), c["cluster"].alias("cluster"))))


def _spelled(f: Column, centers: Column, k: int, size: int) -> Column:
    """``_gaps`` of whole vectors, written out term by term, which compiles where array functions do not."""
    def gap(i: int) -> Column:
        c = F.get(centers, F.lit(i))
        d = F.lit(0.0)
        for j in range(size):
            e = F.get(c["center"], F.lit(j)) - F.get(f, F.lit(j))
            d = d + e * e
        return F.when(c.isNotNull(), F.struct(d.alias("d"), c["cluster"].alias("cluster")))

    return F.least(*[gap(i) for i in range(k)]) if k > 1 else gap(0)


def assign_scene_clusters(df: DataFrame, feature: str, centers: DataFrame, keys: Sequence[str], whole: tuple[int, int] | None = None) -> DataFrame:
    """Nearest of the group's own centres, lowest id on ties; NULL without a vector.
    Centres are a table of clusters x dimensions per group and travel as one array.
    ``whole`` gives the most centres of a group and the length of the vectors, where
    all are whole."""
    f = F.col(feature).cast("array<double>")
    gaps = _gaps(f, F.col("_c")) if whole is None or whole[0] * whole[1] > _SPELLED else _spelled(f, F.col("_c"), *whole)
    return df.join(_nearest_of(centers, keys), list(keys)).withColumn(
        "cluster", F.when(f.isNotNull(), gaps["cluster"])).drop("_c")


_SPELLED = 64     # terms written out
_SALT = 64


def _chunks(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _x): vectors ``_f`` of a group end to end, many to a row; a group
    is spread over ``_SALT`` parts."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            of = list(zip(*(b.column(c).to_pylist() for c in keys), strict=True)) if keys else [()] * b.num_rows
            cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            f = b.column("_f")
            flat = [f.slice(lo, hi - lo).flatten() for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
            ends = np.cumsum([0, *map(len, flat)])
            at = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(flat))],
                                             names=[*keys, "_x"])

    kinds = dict(rows.dtypes)
    laid = rows.repartition(*keys, F.pmod(F.xxhash64("_f"), F.lit(_SALT)))
    if keys:
        laid = laid.sortWithinPartitions(*keys)
    return laid.mapInArrow(pack, ", ".join([*(f"{c} {kinds[c]}" for c in keys), "_x array<double>"]))


def _chunk_sums(chunks: DataFrame, centers: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """(keys, start, cluster, n, _d, _t): members, their summed squared distances
    and their vector sum as an array, of all fits, from one pass over the chunks."""
    packed = _nearest_of(centers, _starts(keys)).groupBy(*keys).agg(F.collect_list(F.struct("start", "_c")).alias("_s"))
    kinds = dict(centers.dtypes)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, cluster, n, far, total = [], [], [], [], [], []
            for i, fits in enumerate(b.column("_s").to_pylist()):
                x = b.column("_x")[i].values.to_numpy(zero_copy_only=False).reshape(-1, size)
                for fit in fits:
                    d = np.zeros((len(fit["_c"]), len(x)))
                    for at, c in enumerate(fit["_c"]):
                        for j in range(size):
                            d[at] += (c["center"][j] - x[:, j]) ** 2
                    best = d.argmin(0)
                    for at, c in enumerate(fit["_c"]):
                        mine = best == at
                        if mine.any():
                            row.append(i)
                            start.append(fit["start"])
                            cluster.append(c["cluster"])
                            n.append(int(mine.sum()))
                            far.append(float(d[at][mine].sum()))
                            total.append(x[mine].sum(0))
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in keys), pa.array(start, pa.int32()), pa.array(cluster, pa.int32()), pa.array(n, pa.int64()),
                                              pa.array(far, pa.float64()), pa.array(total, pa.list_(pa.float64()))], names=[*keys, "start", "cluster", "n", "_d", "_t"])

    joined = chunks.join(packed, list(keys)) if keys else chunks.crossJoin(F.broadcast(packed))
    fields = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "start int, cluster int, n bigint, _d double, _t array<double>"])
    by = [*_starts(keys), "cluster"]
    parts = joined.mapInArrow(add, fields)
    # sums of numbers are hashed; the arrays are put together again per cluster
    sums = parts.select(*by, "n", "_d", F.posexplode("_t").alias("_j", "_v")).groupBy(*by, "_j").agg(
        F.sum("_v").alias("_v"), F.sum("n").alias("n"), F.sum("_d").alias("_d"))
    return sums.groupBy(*by).agg(F.max("n").alias("n"), F.max("_d").alias("_d"), F.sort_array(F.collect_list(F.struct("_j", "_v"))).alias("_t")).select(
        *by, "n", "_d", F.transform("_t", lambda t: t["_v"]).alias("_t"))


def _fit_groups(rows: DataFrame, centers: DataFrame, keys: Sequence[str], iters: int, size: int) -> DataFrame:
    """(keys, start, cluster, _cs, _sh, _in): all updates of groups that fit one
    task, of packed rows (keys, _f): the centre before and after each update, the shifts, and the sums of
    squared distances. A fit whose centres stay put has no more entries."""
    given = _nearest_of(centers, _starts(keys)).groupBy(*keys).agg(F.collect_list(F.struct("start", "_c")).alias("_s"))
    kinds = dict(rows.dtypes)
    fields = ", ".join([*(f"`{c}` {kinds[c]}" for c in keys), "start int, cluster int, _cs array<array<double>>, _sh array<double>, _in array<double>"])

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        x = np.ascontiguousarray(pc.list_flatten(pc.list_flatten(table.column("_f"))).to_numpy().reshape(-1, size).T)
        out = []
        for given in table.column("_s")[0].as_py():
            names, c = [g["cluster"] for g in given["_c"]], np.array([g["center"] for g in given["_c"]], float)
            path, shifts, sums = [c], [], []
            while True:
                far = [sum((e - v) ** 2 for e, v in zip(one, x, strict=True)) for one in c]
                best = np.argmin(far, 0) if len(far) > 2 else (far[1] < far[0]) if len(far) == 2 else np.zeros(x.shape[1], int)
                mine = [(best == at).astype(float) for at in range(len(c))]
                sums.append([float(d @ m) for d, m in zip(far, mine, strict=True)])
                if len(path) > iters or (shifts and not np.any(shifts[-1])):
                    break
                n = np.array([m.sum() for m in mine])
                new = np.stack([x @ m / t if t else old for m, t, old in zip(mine, n, c, strict=True)])
                # as a sum over the elements in their order
                gap = np.zeros(len(c))
                for j in range(size):
                    gap += (c[:, j] - new[:, j]) ** 2
                shifts.append(np.sqrt(gap))
                path.append(new)
                c = new
            for at, name in enumerate(names):
                out.append((given["start"], name, [p[at].tolist() for p in path], [float(t[at]) for t in shifts], [sum(t) for t in sums]))
        cols = list(zip(*out, strict=True))
        kinds_ = [pa.int32(), pa.int32(), pa.list_(pa.list_(pa.float64())), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.Table.from_arrays([*(pa.array([k.as_py()] * len(out), k.type) for k in key), *(pa.array(list(c), t) for c, t in zip(cols, kinds_, strict=True))],
                                    names=[*keys, "start", "cluster", "_cs", "_sh", "_in"])

    return spread(rows.join(given, list(keys)), *keys).groupBy(*keys).applyInArrow(fit, fields)


def kmeans_per_scene(df: DataFrame, feature: str, centers: DataFrame, keys: Sequence[str], iters: int = 20,
                     tol: float = 1e-4, inertias: bool = False, max_rows: int = _IN_ONE_TASK,
                     vectors: Vectors | None = None) -> DataFrame:
    """(keys, cluster, center) after repeated updates of all groups together,
    until no centre moves by ``tol``. An empty cluster keeps its centre. Rows
    whose vectors are whole (of one length, all values finite) are packed: a
    group of at most ``max_rows`` rows takes all its updates in one task, which
    notes each; the rows of larger ones are packed into chunks once, and an update
    is one aggregation by (group, cluster) that adds up chunks. Other rows are
    aggregated one by one.

    Centres with a column ``start`` are several fits of each group; all starts
    are updated by the same aggregation, and the one with the least sum of
    squared distances stays, the lower number on ties. ``inertias`` returns
    (keys, start, inertia) of the fits in place of centres. ``vectors`` are
    these rows packed, where that was done before.
    """
    keys = list(keys)
    if "start" not in centers.columns:
        centers = centers.withColumn("start", F.lit(0))
    by = [*_starts(keys), "cluster"]
    centers = cut_lineage(centers)
    rows = df.where(F.col(feature).isNotNull()).select(*keys, F.col(feature).cast("array<double>").alias("_f"))

    def fitted(c: DataFrame) -> DataFrame:
        """A row per row and start, with its nearest centre; the rows are sent once for all starts."""
        near = _nearest_of(c, _starts(keys)).groupBy(*keys).agg(F.collect_list(F.struct("start", "_c")).alias("_s"))
        each = rows.join(near, keys).withColumn("_s", F.explode("_s"))
        return each.select(*keys, F.col("_s.start").alias("start"), "_f", _gaps(F.col("_f"), F.col("_s._c")).alias("_g")).select(
            *keys, "start", "_f", F.col("_g.cluster").alias("cluster"), F.col("_g.d").alias("_d"))

    groups, size, runs = vectors or pack_vectors(df, feature, keys)
    whole = size is not None and dict(centers.dtypes)["center"] == "array<double>" and not centers.where(
        F.col("center").isNull() | (F.size("center") != size) | F.exists("center", lambda e: e.isNull() | F.isnan(e))).limit(1).count()
    noted, moved, chunks = None, {}, None
    if whole:
        large = groups.where(F.col("n") > max_rows).select(*keys)
        if keys and iters:
            small = groups.where(F.col("n") <= max_rows).select(*keys)
            noted = cut_lineage(_fit_groups(runs.select(*keys, "_f").join(small, keys, "left_semi"), centers, keys, iters, size))
            shifts = noted.select(F.posexplode("_sh").alias("at", "s")).groupBy("at").agg(F.max("s")).collect()      # at most ``iters`` rows
            moved = {r[0] + 1: r[1] for r in shifts}
            rest = centers.join(noted.select(*by), by, "left_anti")
            if large.isEmpty():
                rest = None
            else:
                rest = cut_lineage(rest)
        else:
            large, rest = groups.select(*keys), centers
        if rest is not None:
            chunks = cut_lineage(_chunks(rows.join(large, keys, "left_semi") if keys else rows, keys))
            every, centers = centers, rest
    done = iters
    for turn in range(1, iters + 1):
        shift = moved.get(turn)
        if chunks is not None or not whole:
            if whole:
                means = _chunk_sums(chunks, centers, keys, size).select(*by, F.transform("_t", lambda t: t / F.col("n")).alias("_m"))
            else:
                means = fitted(centers).groupBy(*by).agg(vector_to_array(Summarizer.mean(array_to_vector("_f"))).alias("_m"))
            step = cut_lineage(centers.join(means, by, "left").select(
                *by, F.coalesce("_m", "center").alias("center"), F.when(F.col("_m").isNotNull(), F.sqrt(_squared("center", "_m"))).alias("_shift")))
            now = step.agg(F.max("_shift")).first()[0]
            shift = now if shift is None else shift if now is None else max(now, shift)
            centers = step.drop("_shift")
        if shift is None or shift < tol:
            done = turn
            break
    if chunks is not None:
        sums = _chunk_sums(chunks, centers, keys, size).groupBy(*_starts(keys)).agg(F.sum("_d").alias("inertia"))
    elif not whole:
        sums = fitted(centers).groupBy(*_starts(keys)).agg(F.sum("_d").alias("inertia"))
    else:
        sums = None
    if noted is not None:
        at = F.least(F.lit(done), F.size("_sh"))
        last = noted.select(*by, F.get("_cs", at).alias("_m"), F.get("_in", at).alias("inertia"))
        mine = last.groupBy(*_starts(keys)).agg(F.first("inertia").alias("inertia"))
        sums = mine if sums is None else sums.unionByName(mine)
        if chunks is not None:
            last = last.select(*by, "_m").unionByName(centers.select(*by, F.col("center").alias("_m")))
            centers = every
        centers = cut_lineage(centers.join(last.select(*by, "_m"), by, "left").select(*by, F.coalesce("_m", "center").alias("center")))
    if not inertias and centers.select("start").distinct().count() < 2:      # at most the number of starts
        return centers.drop("start")
    if inertias:
        return sums
    best = sums.groupBy(*keys).agg(F.min_by("start", F.struct("inertia", "start")).alias("start"))
    return centers.join(best, _starts(keys)).drop("start")


def score_clusters(df: DataFrame, feature: str, k: int, cluster: str = "cluster",
                   green: str | None = None, red: str | None = None,
                   bounds: tuple[float, float] = fv.COVERAGE_BOUNDS, keys: Sequence[str] = (), size: int | None = None) -> DataFrame:
    """(keys, cluster, pixels, coverage, score) for clusters 0..k-1 of each group.

    Texture is the deviation of all feature values of a cluster, taken from
    per-row sums; activation is the mean vector length. NaN values are left
    out. Coverage outside the bounds damps the score; with bands given, mean
    green minus mean red is added. An empty cluster scores minus infinity.
    ``size`` is the length of the vectors, where all are whole.
    """
    keys = list(keys)
    f = F.col(feature).cast("array<double>")
    real = F.filter(f, lambda e: e.isNotNull() & ~F.isnan(e))
    sums = F.aggregate(
        real, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0).cast("bigint").alias("n")),
        lambda a, e: F.struct((a["s"] + e).alias("s"), (a["q"] + e * e).alias("q"), (a["n"] + 1).alias("n")))
    length = F.when(F.size(real) == F.size(f), vec.norm(f))
    if size is not None and size <= _SPELLED:      # written out, which compiles where array functions do not
        total, squares = F.lit(0.0), F.lit(0.0)
        for j in range(size):
            e = F.get(f, F.lit(j))
            total, squares = total + e, squares + e * e
        sums = F.struct(total.alias("s"), squares.alias("q"), F.when(f.isNotNull(), F.lit(size).cast("bigint")).alias("n"))
        length = F.sqrt(squares)
    rows = df.select(*keys, F.col(cluster).cast("int").alias("cluster"), sums.alias("t"), length.alias("len"),
                     *([F.col(green).alias("g"), F.col(red).alias("r")] if green else []))
    agg = rows.groupBy(*keys, "cluster").agg(
        F.count("*").alias("pixels"), F.sum("t.s").alias("s"), F.sum("t.q").alias("q"), F.sum("t.n").alias("n"),
        F.avg("len").alias("act"),
        *([(F.avg("g") - F.avg("r")).alias("veg")] if green else [F.lit(0.0).alias("veg")]))
    ids = df.sparkSession.range(k).select(F.col("id").cast("int").alias("cluster"))
    if keys:
        ids = agg.select(*keys).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # k rows per group from here on
    everything = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    full = ids.join(agg, [*keys, "cluster"], "left").withColumn("_all", F.sum("pixels").over(everything))
    coverage = F.coalesce(F.col("pixels") / F.col("_all"), F.lit(0.0))
    mean = F.col("s") / F.col("n")
    texture = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean))
    base = F.coalesce(F.nanvl(texture + 0.1 * F.col("act"), F.lit(0.0)), F.lit(0.0))
    low, high = bounds
    damp = F.when(coverage < low, 0.5).when(
        coverage > high, F.when(coverage > min(fv.COVERAGE_EXTREME, high * 1.5), 0.1).otherwise(0.5)).otherwise(1.0)
    veg = F.coalesce(F.col("veg"), F.lit(0.0))
    return full.select(
        *keys, "cluster", F.coalesce("pixels", F.lit(0)).cast("bigint").alias("pixels"), coverage.alias("coverage"),
        F.when(F.col("pixels").isNull(), F.lit(float("-inf"))).otherwise(base * damp + veg).alias("score"))


def pick_cluster(scores: DataFrame, bounds: tuple[float, float] = fv.COVERAGE_BOUNDS, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cluster), one row per group: the best cluster, or, when it covers
    nothing or nearly all, the usable alternative nearest to the middle of the
    bounds. The input has one row per group and cluster."""
    keys = list(keys)
    everything = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    top = F.max(F.struct("score", (-F.col("cluster")).alias("_n"), "coverage")).over(everything)
    both = scores.withColumn("_top", top).withColumn("_b", -F.col("_top._n")).withColumn("_c", F.col("_top.coverage"))
    usable = (F.col("cluster") != F.col("_b")) & (F.col("coverage") > 0) & (F.col("coverage") < fv.COVERAGE_EXTREME)
    order = F.struct(F.abs(F.col("coverage") - sum(bounds) / 2), -F.col("score"), F.col("cluster"))
    alt = F.min_by("cluster", F.when(usable, order))
    extreme = (F.max("_c") <= 0) | (F.max("_c") >= fv.COVERAGE_EXTREME)
    return both.groupBy(*keys).agg(F.when(extreme, F.coalesce(alt, F.max("_b"))).otherwise(F.max("_b")).alias("cluster"))


def segment_unsupervised(df: DataFrame, feature: str, key: str, k: int = 2, green: str | None = None,
                         red: str | None = None, seed: int = 0, keys: Sequence[str] = ("scene_id",),
                         centers: DataFrame | None = None, iters: int = 20, starts: int = fv.KMEANS_STARTS) -> DataFrame:
    """Rows of the cluster most likely to be the target, decided per scene:
    fit on all rows of the scene from several starts, label, score, pick.
    ``centers`` gives start centres (keys, cluster, center) in place of drawn ones."""
    keys = list(keys)
    if not hasattr(df, "_pixelweave_table"):
        df = cut_lineage(df)
    vectors = pack_vectors(df, feature, keys, key)
    start = centers if centers is not None else scene_centers(df, feature, key, k, keys, seed, starts, vectors)
    fit = kmeans_per_scene(df, feature, start, keys, iters, vectors=vectors)
    # scored and returned: whole vectors are labelled twice, which is less than to write them
    size = vectors.size
    if size is not None:
        fit = cut_lineage(fit)
        most = fit.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        got = assign_scene_clusters(df, feature, fit, keys, (most, size) if most else None)
    else:
        got = cut_lineage(assign_scene_clusters(df, feature, fit, keys))
    pick = pick_cluster(score_clusters(got.where(F.col("cluster").isNotNull()), feature, k, green=green, red=red, keys=keys, size=size), keys=keys)
    return got.join(cut_lineage(pick), [*keys, "cluster"], "left_semi")


# --- projection -------------------------------------------------------------

def pca_project(df: DataFrame, feature: str, k: int = 3, standardize: bool = False,
                whiten: bool = False, l2_rows: bool = False):
    """(rows with ``projection``, explained variance ratios). Vectors are
    centred first; ``standardize`` also scales to unit variance, ``whiten``
    scales components to unit variance. Rows without a vector take no part in
    the fit and have no projection."""
    data = df.where(F.col(feature).isNotNull()).withColumn("_v", array_to_vector(F.col(feature).cast("array<double>")))
    scaler = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=standardize).fit(data)
    centred = scaler.transform(data)
    model = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred)
    out = model.transform(centred).withColumn("projection", vector_to_array("_p"))
    if whiten:
        sd = out.agg(*[F.stddev_samp(F.col("projection")[i]).alias(f"s{i}") for i in range(k)]).first()
        out = out.withColumn("projection", F.array(*[F.col("projection")[i] / sd[i] for i in range(k)]))
    if l2_rows:
        out = out.withColumn("projection", vec.l2_normalize(F.col("projection")))
    none = df.where(F.col(feature).isNull()).withColumn("projection", F.lit(None).cast("array<double>"))
    return out.drop("_v", "_c", "_p").unionByName(none), model.explainedVariance.toArray().tolist()


def covariance_matrix(df: DataFrame, feature: str) -> DataFrame:
    """(i, j, cov) for i <= j, sample covariance. Each task folds its rows
    into one product matrix about one row of the data, so that large means
    don't cost digits; what is shuffled grows with the dimensions and the task
    count, not with the rows."""
    first = df.where(F.col(feature).isNotNull()).select(F.col(feature).cast("array<double>")).first()
    origin = np.nan_to_num(np.array(first[0], float)) if first else np.zeros(0)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, prods = 0, None, None
        for batch in batches:
            x, _ = _matrix(batch.column(0))
            if not len(x):
                continue
            x = x - origin
            if sums is None:
                sums, prods = np.zeros(x.shape[1]), np.zeros((x.shape[1],) * 2)
            n, sums, prods = n + len(x), sums + x.sum(0), prods + x.T @ x
        if sums is not None:
            i, j = np.triu_indices(len(sums))
            yield pa.RecordBatch.from_pydict({
                "i": i.astype(np.int32), "j": j.astype(np.int32), "p": prods[i, j], "si": sums[i], "sj": sums[j],
                "n": np.full(len(i), n, np.int64)})

    parts = df.select(F.col(feature).cast("array<double>")).mapInArrow(
        fold, "i int, j int, p double, si double, sj double, n bigint")
    n = F.sum("n")
    return parts.groupBy("i", "j").agg(((F.sum("p") - F.sum("si") * F.sum("sj") / n) / (n - 1)).alias("cov"))


# --- classification ---------------------------------------------------------

def linear_probe_predict(df: DataFrame, feature: str, weights: Sequence[Sequence[float]],
                         bias: Sequence[float], name: str = "prediction") -> DataFrame:
    """argmax over classes of w.f + b, lowest class on ties."""
    w, b = np.asarray(weights, float), np.asarray(bias, float)

    @F.arrow_udf("int")
    def fn(v: pa.Array) -> pa.Array:
        x, valid = _matrix(v)
        best = np.zeros(len(valid), np.int32)
        if len(x):
            best[valid] = (x @ w.T + b).argmax(1)
        return pa.array(best, pa.int32(), mask=~valid)

    return df.withColumn(name, fn(F.col(feature).cast("array<double>")))


def linear_probe_fit(df: DataFrame, feature: str, label: str, max_iter: int = 20):
    """Two-class cross-entropy fit on patch labels: (weights, bias) by class."""
    data = df.select(array_to_vector(F.col(feature).cast("array<double>")).alias("_v"),
                     F.col(label).cast("double").alias("_y"))
    m = LogisticRegression(featuresCol="_v", labelCol="_y", maxIter=max_iter, family="multinomial").fit(data)
    return m.coefficientMatrix.toArray().tolist(), m.interceptVector.toArray().tolist()


def map_labels(df: DataFrame, label: str, names: dict[int, str], out: str = "name") -> DataFrame:
    """Names for prediction ids from a small literal map."""
    pairs = [F.lit(v) for kv in names.items() for v in kv]
    return df.withColumn(out, F.try_element_at(F.create_map(*pairs), F.col(label).cast("int")))


def infer_tiles(tiles: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                schema: str) -> DataFrame:
    """Score tiles with a user model. ``load`` runs once per task and returns
    the function applied to each Arrow batch of tiles. Filter tiles before
    this call: filters are not pushed through Python code."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            yield model(batch)

    return tiles.mapInPandas(run, schema)
