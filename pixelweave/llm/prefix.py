"""Running sums over groups of any size, as joins of bounded windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

BUCKET_ROWS = 4096
CHUNK = 4096     # equal rows written by one step


def random_key(seed: str, *columns: str) -> Column:
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    between = [x for p in parts for x in (F.lit(":"), p)][1:]
    return F.md5(F.concat(F.lit(seed), *between).cast("binary"))


def equal_rows(df: DataFrame, name: str) -> DataFrame:
    """The distinct rows, with their number in ``name``: rows that repeat are
    combined before any shuffle, however many there are."""
    return df.groupBy(*df.columns).agg(F.count("*").alias(name))


def each_row(df: DataFrame, name: str, index: str) -> DataFrame:
    """Every row ``name`` times, with its ``index`` from 0, spread in chunks."""
    keys = [c for c in df.columns if c != name]
    chunks = df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(name) - 1, F.lit(CHUNK).cast("bigint"))))
    last = F.least(F.col("_c") + CHUNK, F.col(name)) - 1
    return chunks.repartition("_c", *keys).withColumn(index, F.explode(F.sequence("_c", last))).drop("_c", name)


def running_sum(df: DataFrame, group: list[str], key: str, rows: str, order: list[str], value: Column,
                name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the earlier rows of the group.

    ``key`` is a uniform hex string and the first of ``order``; its leading 32
    bits range the group's ``rows`` into even buckets. Groups need not be null
    free.
    """
    parts = F.ceil(F.col(rows) / BUCKET_ROWS).cast("bigint")
    head = F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint")
    df = df.withColumn("_b", F.shiftright(head * parts, 32)).withColumn("_v", value)
    safe = [F.coalesce(F.col(g).cast("string"), F.lit("\x00")).alias(f"_k{i}") for i, g in enumerate(group)]
    names = [f"_k{i}" for i in range(len(group))]
    df = df.select("*", *safe)
    sums = df.groupBy(*names, "_b").agg(F.sum("_v").alias("_s"))
    earlier = W.partitionBy(*names).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offset = sums.withColumn("_o", F.coalesce(F.sum("_s").over(earlier), F.lit(0))).drop("_s")
    inside = W.partitionBy(*names, "_b").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_i", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    return df.join(offset, [*names, "_b"]).withColumn(name, F.col("_o") + F.col("_i")).drop(
        *names, "_b", "_v", "_o", "_i")
