"""Mixing sources to target weights, with DataFrame functions only.

Rows get a hash-random key. Within a source the rows are ranged by that key
into buckets of a few thousand rows each, so the order over the buckets is the
order of the keys; running word counts are the sum over earlier buckets plus a
running sum inside the bucket. No source is sorted in one task. A source's
budget is cut from its rows in key order, and taken again from the start while
it exceeds what the source holds (epochs); the row at the cut gives its first
words only, so a source is short of its budget by less than one word. Rows of
equal id and size are planned as one with a count, so a bucket holds no more than
its share of the keys and, for an id (or none) that many rows share, its sizes.

Targets: source weights share all words; a source stops at ``repeats`` times
its own size and the excess is shared anew by weight. The fixed point is
min(level * weight, cap) and the level follows in closed form from the sources
in order of cap / weight.

Defined results: null text has size 0; null sources form one source, placed
last; a source without words has target 0. Equal rows are interchangeable. If
no source has words every target is 0. Other columns pass ``mixed`` untouched.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..session import cut_lineage
from .prefix import each_row, equal_rows, random_key, running_sum
from .text import WORD_REGEX

NAME = "op3_mix_sources"
REPEATS = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) of every document, read once and written narrow."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_REGEX)), F.lit(0)).cast("bigint")
    return cut_lineage(docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size")))


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, source_rows, target), one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    # windows over one row per source
    at = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source"))
    per = per.withColumn("weight", (at - 1) % 3 + 1).withColumn("cap", repeats * F.col("source_size"))
    everything = W.partitionBy(F.lit(0))
    full_first = everything.orderBy(F.col("cap") / F.col("weight"), "weight", F.col("source").isNull(), "source")
    before = full_first.rowsBetween(W.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("level", rest.cast("double") / open_weight)
    # the first source in this order that the level does not fill sets the level of all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("level", F.first(F.when(fits, F.col("level")), True).over(
        full_first.rowsBetween(W.unboundedPreceding, W.currentRow)))
    target = F.when(F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return per.select("source", "source_size", "source_rows", target.alias("target"))


def _taken(rows: DataFrame, goal: DataFrame, order: list[str], many: str | None = None) -> DataFrame:
    """Rows (source, size, _key and others) with source_size, target and taken;
    a row that stands for ``many`` is written as often."""
    # a few sources: the join side is one row per source
    rows = rows.join(goal, rows["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    words = F.col("size") * F.col(many) if many else F.col("size")
    rows = running_sum(rows, ["source"], "_key", "source_rows", order, words, "_start")
    if many:
        rows = each_row(rows, many, "_k").withColumn("_start", F.col("_start") + F.col("_k") * F.col("size"))
    budget = F.floor(F.col("target")).cast("bigint")
    some = F.col("source_size") > 0
    epochs = F.when(some, F.floor(budget / F.col("source_size"))).otherwise(0).cast("bigint")
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("_start"), F.lit(0)), F.col("size"))
    return rows.withColumn("taken", (epochs * F.col("size") + cut).cast("bigint"))


def mix(sizes: DataFrame, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of (doc_id, source, size)."""
    rows = equal_rows(sizes.select("doc_id", "source", "size"), "_many").withColumn("_key", random_key(seed, "doc_id"))
    return _taken(rows, targets(sizes, repeats), ["_key", "doc_id", "size"], "_many").select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, repeats: int = REPEATS, seed: str = "mix") -> DataFrame:
    """The documents of the mix: each row as often as an epoch takes words of it.

    Texts stay whole. Every row is planned by itself, whatever its id: its key
    is a hash of all its columns, and the row goes through the plan as a value.
    """
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD_REGEX)), F.lit(0)).cast("bigint")
    key = F.md5(F.concat(F.lit(seed), F.xxhash64("doc").cast("string")).cast("binary"))
    rows = docs.select(F.struct("*").alias("doc"), F.col("source").cast("string").alias("source"), size.alias("size")).withColumn("_key", key)
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    plan = _taken(rows, targets(sized(docs), repeats), ["_key", "size"]).where(F.col("taken") > 0)
    return plan.select("doc", F.explode(F.sequence(F.lit(1), copies))).select("doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("source")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s FROM d GROUP BY source
), w AS (
  SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w, 3 * s AS cap FROM p
), o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, w, source IS NULL, source) AS i FROM w
), l AS (
  SELECT a.*, CAST((SELECT sum(s) FROM o) - coalesce((SELECT sum(cap) FROM o b WHERE b.i < a.i), 0) AS DOUBLE)
    / CAST((SELECT sum(w) FROM o) - coalesce((SELECT sum(w) FROM o b WHERE b.i < a.i), 0) AS DOUBLE) AS level
  FROM o a
), f AS (
  SELECT *, (SELECT arg_min(level, i) FROM l b WHERE b.level * b.w <= b.cap) AS lv,
            (SELECT min(i) FROM l b WHERE b.level * b.w <= b.cap) AS fi FROM l
), t AS (
  SELECT source, s, CASE WHEN fi IS NULL OR i < fi THEN CAST(cap AS DOUBLE) ELSE lv * w END AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.s AS source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(concat('mix', CAST(d.doc_id AS VARCHAR))), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CAST(floor(t.target) AS BIGINT) AS budget
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
    + least(greatest(budget % source_size - start, 0), size) END AS BIGINT) AS taken
FROM r
"""
