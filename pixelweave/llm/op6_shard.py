"""Shards of nearly equal bytes by minimax contiguous partition, with DataFrame functions only.

Rows of equal text form an atomic group. Groups are ordered by the SHA-256 of
their text; a contiguous partition into shards is sought whose largest shard is
as small as possible. The smallest feasible capacity is found by binary search,
each candidate being checked greedily (fill a shard up to the capacity, then
start the next), and the order is cut there.

The groups never reach the driver. It holds cells, the byte and group counts of
key prefixes: 4096 at first, and finer ones only where a cut may fall. A greedy
check over cells brackets the true one: cuts on cell borders give a feasible
capacity, cuts anywhere inside cells a lower bound. Cells between the two are
refined by one aggregation per round until both agree, so the capacity is that
of the groups themselves. The cells held are bounded by the number of shards.

A group of at least the average still to be placed gets a shard of its own
first, largest first, so one hot text doesn't empty the other shards. Among the
partitions that keep to the capacity, cuts near even fill are taken.

Law: ``bytes``. Defined results: null text has no bytes, counts as one group
apart from the empty text and has CRC 0; size is bytes plus 8; equal rows are
interchangeable within their shard; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage
from .prefix import each_row, equal_rows, random_key, running_sum

NAME = "op6_shard_minimax"
SHARDS = 24
FIRST, MORE = 3, 2       # hex digits of the first cells, and digits added by each refinement


def narrow(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, key), without the texts."""
    text = F.col("text").cast("string")
    raw = F.coalesce(text, F.lit("")).cast("binary")
    key = F.when(text.isNull(), F.sha2(F.lit("\x00null").cast("binary"), 256)).otherwise(F.sha2(raw, 256))
    return docs.select("doc_id", (F.octet_length(raw) + 8).cast("bigint").alias("size"),
                       F.crc32(raw).cast("bigint").alias("text_crc32"), key.alias("key"))


class Cells:
    """Byte totals of key prefixes in key order."""

    def __init__(self, found: dict[str, tuple[int, int]]):
        self.names = sorted(found)
        self.end = np.cumsum([found[k][0] for k in self.names], dtype=np.int64)
        self.start = np.concatenate([[0], self.end[:-1]]).astype(np.int64)
        self.single = np.array([found[k][1] == 1 for k in self.names])

    def greedy(self, capacity: int, shards: int, inside: bool) -> list[int]:
        """Ends of the shards; ``inside``: a cut may also fall inside a cell of several groups."""
        ends, at, total = [], 0, int(self.end[-1])
        for _ in range(shards):
            aim = at + capacity
            i = int(np.searchsorted(self.end, aim, "right"))
            if i == len(self.end):
                at = total
            elif inside and not self.single[i]:
                at = aim
            else:
                at = int(self.start[i])
            ends.append(at)
        return ends

    def smallest(self, shards: int, inside: bool) -> int:
        low, high = -(-int(self.end[-1]) // shards), int(self.end[-1])
        while low < high:
            mid = (low + high) // 2
            if self.greedy(mid, shards, inside)[-1] >= self.end[-1]:
                high = mid
            else:
                low = mid + 1
        return low

    def doubtful(self, low: int, high: int, shards: int) -> list[str]:
        """Cells of several groups in which a cut may fall for some capacity from low to high."""
        hit = np.zeros(len(self.names), bool)
        for a, b in zip(self.greedy(low, shards, False), self.greedy(high, shards, True), strict=True):
            hit |= (self.start <= b) & (self.end > a)
        return [self.names[i] for i in np.flatnonzero(hit & ~self.single)]

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """First cell of each shard but the first, near even fill within the capacity."""
        total, n = int(self.end[-1]), len(self.names)
        latest = [n] * (shards + 1)      # the first cell that the shards from k on can still hold
        for k in range(shards - 1, -1, -1):
            top = int(self.end[latest[k + 1] - 1]) if latest[k + 1] else 0
            latest[k] = int(np.searchsorted(self.start, top - capacity, "left"))
        out, at = [], 0
        for k in range(shards - 1):
            begun = int(self.start[at]) if at < n else total
            most = int(np.searchsorted(self.end, begun + capacity, "right"))
            aim = begun + (total - begun) // (shards - k)
            near = int(np.searchsorted(self.end, aim, "right"))
            if near < n and aim - int(self.start[near]) > int(self.end[near]) - aim:
                near += 1
            at = min(max(near, latest[k + 1], at), most)
            out.append(at)
        return out


def _cells(groups: DataFrame, digits: int, within: list[str] | None = None) -> dict[str, tuple[int, int]]:
    if within is not None:
        groups = groups.where(F.substring("key", 1, len(within[0])).isin(within))
    found = groups.groupBy(F.substring("key", 1, digits).alias("c")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n"))
    return {r["c"]: (r["b"], r["n"]) for r in found.collect()}


def partition(groups: DataFrame, shards: int) -> tuple[list[str], list[str], int]:
    """(keys with a shard of their own, first keys of the later shards, capacity) of (key, bytes)."""
    left = groups.agg(F.sum("bytes")).first()[0] or 0
    own: list[str] = []
    for r in groups.orderBy(F.desc("bytes"), "key").limit(shards - 1).collect():
        if r["bytes"] * (shards - len(own)) < left:
            break
        own.append(r["key"])
        left -= r["bytes"]
    shards -= len(own)
    if own:
        groups = groups.where(~F.col("key").isin(own))
    found = _cells(groups, FIRST)
    if not found:
        return own, [], 0
    while True:
        cells = Cells(found)
        low, high = cells.smallest(shards, True), cells.smallest(shards, False)
        doubtful = cells.doubtful(low, high, shards) if low < high else []
        if not doubtful:
            first = [i for i in cells.cuts(high, shards)]
            return own, [cells.names[i] if i < len(cells.names) else "~" for i in first], high
        for digits in {len(c) for c in doubtful}:
            some = [c for c in doubtful if len(c) == digits]
            found = {k: v for k, v in found.items() if k not in set(some)} | _cells(groups, digits + MORE, some)


def shard_of(own: list[str], cuts: list[str], shards: int) -> Column:
    """The shard of ``key``."""
    if len(own) + len(cuts) + 1 > shards:
        raise ValueError("more parts than shards")
    later = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col("key") >= c)) if cuts else F.lit(0)
    out = later + len(own)
    for i, k in enumerate(own):
        out = F.when(F.col("key") == k, i).otherwise(out)
    return out.cast("int")


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per document."""
    rows = cut_lineage(narrow(docs))
    groups = cut_lineage(rows.groupBy("key").agg(F.sum("size").alias("bytes")))
    own, cuts, _ = partition(groups, shards)
    rows = rows.withColumn("shard", shard_of(own, cuts, shards)).drop("key")
    # one row per shard
    counts = rows.groupBy("shard").agg(F.count("*").alias("_rows"))
    # slots by a hash of id and text; rows of equal id and text are counted as one
    some = equal_rows(rows, "_many").join(F.broadcast(counts), "shard").withColumn(
        "_key", random_key("slot", "doc_id", "size", "text_crc32"))
    some = running_sum(some, ["shard"], "_key", "_rows", ["_key", "doc_id", "size", "text_crc32"], F.col("_many"), "slot")
    rows = each_row(some, "_many", "_k").withColumn("slot", F.col("slot") + F.col("_k"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                       F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = None
