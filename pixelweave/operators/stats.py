"""Exact order statistics and rankings that never gather a group in one task.

A scene may hold a third of all rows, so ``percentile`` (which keeps every
distinct value of a group in one buffer) and windows over whole scenes are
avoided. Quantiles are found by narrowing brackets: each round is a count per
bucket, which combines map-side, and a running sum over a bounded number of
buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

_PER_OCTAVE = 1 << 14     # buckets per power of two, in large groups
_PER_BUCKET = 64          # rows for each of them in smaller groups


def finite(col: Column) -> Column:
    """The value as double, NULL where it is NULL, NaN or infinite."""
    d = col.cast("double")
    return F.when(F.isnan(d) | (F.abs(d) == float("inf")), None).otherwise(d)


def _log_bucket(v: Column, n: Column) -> Column:
    # log2 is monotone, so bucket order equals value order; signs mirror.
    per = F.least(F.lit(_PER_OCTAVE), F.ceil(n / _PER_BUCKET))
    mag = F.floor((F.log2(F.abs(v)) + 1100) * per).cast("bigint")
    return F.when(v == 0, F.lit(0).cast("bigint")).when(v > 0, mag).otherwise(-mag)


def _hits(hist: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add the ranks ``first``..``last`` that each bucket covers within its group."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return hist.withColumn("last", F.sum("n").over(w) - 1).withColumn(
        "first", F.col("last") - F.col("n") + 1
    )


def order_statistics(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], ranks
) -> DataFrame:
    """Values at given 0-based ranks per key group.

    ``ranks(total)`` returns an array<struct<slot:int, rank:bigint>> column.
    Output: keys, ``_item`` (position in ``values``), slot, rank, value,
    ``skip`` (rank among equal values) and total. NULL and non-finite values
    are left out. The keys and values are first written as a narrow table, so
    ``df`` is evaluated once however it was derived. Round one counts
    logarithmic buckets; round two counts the values of the few buckets that
    hold a wanted rank (in a large group a bucket spans 1/24000 of its values'
    size, so it holds few distinct values; a small group has fewer buckets, or
    counting them would be as much as its rows). Both are counts that combine
    map-side.
    """
    keys = list(keys)
    if len(values) == 1:
        flat = df.select(*keys, F.lit(0).alias("_item"), finite(F.col(values[0])).alias("_v"))
    else:
        # one pass over the row yields every band
        pairs = F.array(*[
            F.struct(F.lit(i).alias("_item"), finite(F.col(v)).alias("_v"))
            for i, v in enumerate(values)
        ])
        flat = df.select(*keys, F.inline(pairs))
    flat = cut_lineage(flat.where(F.col("_v").isNotNull()))

    g0 = [*keys, "_item"]
    g1 = [*g0, "_b1"]
    sizes = cut_lineage(flat.groupBy(*g0).agg(F.count("*").alias("_size")).select(
        "_size", *[F.col(g).alias(f"_g{i}") for i, g in enumerate(g0)]))
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(g0)]
    flat = flat.join(sizes, same).select(*g0, "_v", _log_bucket(F.col("_v"), F.col("_size")).alias("_b1"))
    hist = flat.groupBy(*g1).agg(
        F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
    )
    first = cut_lineage(
        _hits(hist, g0, "_b1")
        .withColumn("total", F.sum("n").over(W.partitionBy(*g0)))
        .withColumn(
            "hit",
            F.explode(F.filter(ranks(F.col("total")), lambda t: (t["rank"] >= F.col("first"))
                               & (t["rank"] <= F.col("last")))),
        )
        .select(*g1, "lo", "hi", "n", "total", F.col("hit.slot").alias("slot"),
                F.col("hit.rank").alias("rank"),
                (F.col("hit.rank") - F.col("first")).alias("left"))
    )
    bracket = first.select(*g1).distinct()
    # a hot bucket is split by the session's forced skew splitting where the brackets are not broadcast
    values_hit = flat.join(bracket, g1, "left_semi").groupBy(*g1, "_v").agg(F.count("*").alias("n"))
    return (
        _hits(values_hit, g1, "_v")
        .join(first.select(*g1, "total", "slot", "rank", "left"), g1)
        .where(F.col("left").between(F.col("first"), F.col("last")))
        .select(*g0, "slot", "rank", "total", F.col("_v").alias("value"),
                (F.col("left") - F.col("first")).alias("skip"))
    )


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """Linear-interpolated quantiles, one row per key group.

    Columns: keys and ``{value}_q{i}`` for the i-th probability.
    """
    probs = [float(p) for p in probs]

    def ranks(total: Column) -> Column:
        out = []
        for i, p in enumerate(probs):
            pos = F.lit(p) * (total - 1)
            out.append(F.struct(F.lit(2 * i).alias("slot"), F.floor(pos).cast("bigint").alias("rank")))
            out.append(F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(pos).cast("bigint").alias("rank")))
        return F.array(*out)

    hits = order_statistics(df, keys, values, ranks)
    aggs = []
    for j, v in enumerate(values):
        here = F.col("_item") == j
        total = F.max(F.when(here, F.col("total")))
        for i, p in enumerate(probs):
            lo = F.max(F.when(here & (F.col("slot") == 2 * i), F.col("value")))
            hi = F.max(F.when(here & (F.col("slot") == 2 * i + 1), F.col("value")))
            pos = F.lit(p) * (total - 1)
            aggs.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(f"{v}_q{i}"))
    if keys:
        return hits.groupBy(*keys).agg(*aggs)
    return hits.agg(*aggs)


def with_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join one-row-per-group statistics back to the rows.

    No broadcast hint: the number of groups is not bounded here, so the
    planner decides from the measured size, and adaptive skew splitting
    serves a hot group (its statistics are one row).
    """
    return df.join(stats, list(keys), "left")


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank_col: str = "rank"
) -> DataFrame:
    """First ``k`` rows per group, ranked from 1, in a total order.

    A first ranking inside salted sub-groups keeps a hot group from being
    sorted in one task; the second sees at most ``64 * k`` rows per group.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(64)).alias("_salt")
    salted = df.select("*", salt)
    pre = W.partitionBy(*keys, "_salt").orderBy(*order)
    fin = W.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("_r", F.row_number().over(pre)).where(F.col("_r") <= k).drop("_r", "_salt")
        .withColumn(rank_col, F.row_number().over(fin)).where(F.col(rank_col) <= k)
    )


def number_rows(df: DataFrame, order: Sequence[str], name: str = "id",
                keys: Sequence[str] = ()) -> DataFrame:
    """Consecutive numbers from 1 in ``order``, restarting per ``keys``.

    Rows are range-sorted, numbered inside each sort partition and shifted by
    the partition's running offset (one row per partition, so the window is
    bounded by the partition count). The sorted rows are checkpointed because
    both uses must see the same partitions.
    """
    keys = list(keys)
    mask = (1 << 33) - 1
    laid = cut_lineage(
        df.sort(*keys, *order).withColumn("_m", F.monotonically_increasing_id())
    ).withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit(mask)))
    sizes = laid.groupBy("_p").agg(F.count("*").alias("_n"))
    # one row per sort partition: its count is the session's shuffle setting
    offs = sizes.withColumn(
        "_off",
        F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_p")
                         .rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_n"),
    ).select("_p", "_off")
    out = laid.join(F.broadcast(offs), "_p").withColumn("_g", F.col("_off") + F.col("_r") + 1)
    if keys:
        starts = out.groupBy(*keys).agg(F.min("_g").alias("_g0"))
        out = out.join(starts, keys).withColumn(name, F.col("_g") - F.col("_g0") + 1).drop("_g0")
    else:
        out = out.withColumn(name, F.col("_g"))
    return out.drop("_m", "_p", "_r", "_off", "_g")
