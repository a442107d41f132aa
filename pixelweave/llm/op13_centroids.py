"""Centroid clustering over subvector dictionaries.

Vectors become integers and are cut into blocks of two dimensions. A segment of
at most ``SEGMENT`` vectors keeps, for each block, the distinct subvectors that
occur in it and a code per vector: lossless, and bounded whatever the data are,
as a dictionary has no more entries than its segment. The encoded segments are
written once and read in every round.

A round computes the exact squared distance of each dictionary entry to the
matching part of each centroid once, and a vector's distance is the sum of its
codes' entries. New centroids come from code counts: (code, cluster) counts
times the entries. A task returns one small table of sums whatever it read, and
the centroids (clusters x dimensions) are the only data on the driver.

Defined results: only vectors of exactly ``size`` components, none null or
non-finite, take part. Integer components are held at +-2**27, so that squared
distances fit in a long. Rows that repeat an id count each; a null id takes
part, but never starts a centroid while others are left. Equal start hashes are
ordered by vector. With fewer vectors than centroids each starts one. Empty
tables give empty results; other columns don't matter.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut_lineage

NAME = "op13_centroid_codes"
SEGMENT = 4096        # vectors that share dictionaries
WIDTH = 2             # dimensions of a block: one 64-bit value
LIMIT = 1 << 27
_ENCODED = "ids array<bigint>, entries array<binary>, codes array<binary>"


def kept(vectors: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(id, vec) of the usable vectors, in doubles."""
    v = F.col(vec_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce((F.size(v) == size) & finite, F.lit(False))).select(
        F.col(id_col).cast("bigint").alias("id"), v.alias("vec"))


def _whole(vec: np.ndarray, scale: int) -> np.ndarray:
    return np.clip(np.floor(vec * scale), -LIMIT, LIMIT).astype(np.int32)


def encode(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """Segments: their ids and, for each block, distinct subvectors and codes."""
    blocks = -(-size // WIDTH)

    def segment(ids: pa.Array, vec: np.ndarray) -> pa.RecordBatch:
        x = np.zeros((len(vec), blocks * WIDTH), np.int32)
        x[:, :size] = _whole(vec, scale)
        pairs = x.view(np.int64)
        entries, codes = [], []
        for b in range(blocks):
            distinct, code = np.unique(pairs[:, b], return_inverse=True)
            entries.append(distinct.tobytes())
            codes.append(code.astype(np.uint16).tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array([ids], pa.list_(pa.int64())), pa.array([entries], pa.list_(pa.binary())),
             pa.array([codes], pa.list_(pa.binary()))], names=["ids", "entries", "codes"])

    def run(batches):
        ids, vecs, n = [], [], 0
        for batch in batches:
            flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for at in range(0, batch.num_rows, SEGMENT):
                ids.append(batch.column("id").slice(at, SEGMENT))
                vecs.append(flat[at:at + SEGMENT])
                n += len(vecs[-1])
                while n >= SEGMENT:
                    all_ids, all_vecs = pa.concat_arrays(ids), np.concatenate(vecs)
                    yield segment(all_ids.slice(0, SEGMENT), all_vecs[:SEGMENT])
                    ids, vecs, n = [all_ids.slice(SEGMENT)], [all_vecs[SEGMENT:]], n - SEGMENT
        if n:
            yield segment(pa.concat_arrays(ids), np.concatenate(vecs))

    return rows.mapInArrow(run, _ENCODED)


def _segments(batches, blocks: int):
    """(ids, entries per block as (m, 2) integers, codes per block)."""
    for batch in batches:
        for i in range(batch.num_rows):
            entries, codes = batch.column("entries")[i].values, batch.column("codes")[i].values
            yield (batch.column("ids")[i].values,
                   [np.frombuffer(entries[b].as_buffer(), np.int32).reshape(-1, WIDTH).astype(np.int64) for b in range(blocks)],
                   [np.frombuffer(codes[b].as_buffer(), np.uint16) for b in range(blocks)])


def _nearest(entries, codes, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number on ties, and its squared distance."""
    total = np.zeros((len(codes[0]), len(centroids)), np.int64)
    for b, (entry, code) in enumerate(zip(entries, codes, strict=True)):
        part = ((entry[:, None] - centroids[None, :, b * WIDTH:(b + 1) * WIDTH]) ** 2).sum(2)
        total += part[code]
    cluster = total.argmin(1)
    return cluster, np.take_along_axis(total, cluster[:, None], 1)[:, 0]


def _padded(centroids: list[list[int]]) -> np.ndarray:
    c = np.array(centroids, np.int64)
    return np.pad(c, ((0, 0), (0, -c.shape[1] % WIDTH)))


def _totals(encoded: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int], int]]:
    """(vectors, component sums, distance sum) of each cluster, exact."""
    c, size = _padded(centroids), len(centroids[0])
    k, blocks = len(c), c.shape[1] // WIDTH

    def run(batches):
        # component sums, count, high and low halves of the distance sum
        sums = np.zeros((k, c.shape[1] + 3), np.int64)
        for _, entries, codes in _segments(batches, blocks):
            cluster, distance = _nearest(entries, codes, c)
            for b, (entry, code) in enumerate(zip(entries, codes, strict=True)):
                seen = np.bincount(code.astype(np.int64) * k + cluster, minlength=len(entry) * k).reshape(-1, k)
                sums[:, b * WIDTH:(b + 1) * WIDTH] += seen.T @ entry
            sums[:, -3] += np.bincount(cluster, minlength=k)
            np.add.at(sums[:, -2], cluster, distance >> 32)
            np.add.at(sums[:, -1], cluster, distance & 0xFFFFFFFF)
        at, slot = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(slot, pa.int32()), pa.array(sums[at, slot])],
                                         names=["cluster", "slot", "value"])

    # at most clusters x (dimensions + 3) rows
    got = {(r["cluster"], r["slot"]): int(r["v"]) for r in encoded.mapInArrow(run, "cluster int, slot int, value bigint").groupBy(
        "cluster", "slot").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v")).collect()}
    at = lambda j, s: got.get((j, s), 0)
    n, high, low = c.shape[1], c.shape[1] + 1, c.shape[1] + 2
    return [(at(j, n), [at(j, s) for s in range(size)], (at(j, high) << 32) + at(j, low)) for j in range(k)]


def start(rows: DataFrame, k: int, seed: str, scale: int) -> list[list[int]]:
    """The k vectors of smallest sha256 of ``<seed>:<id>``, as integers."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    some = rows.orderBy(key.asc_nulls_last(), "vec").limit(k).collect()
    return [_whole(np.array(r["vec"]), scale).tolist() for r in some]


def cluster(vectors: DataFrame, id_col: str, vec_col: str, size: int = 64, k: int = 16, rounds: int = 3,
            scale: int = 64, seed: str = "1") -> tuple[DataFrame, list[list[int]], list[int]]:
    """(id, cluster, distance) of every usable vector, the final centroids, and
    the distance sum of each cluster."""
    rows = kept(vectors, id_col, vec_col, size)
    centroids = start(rows, k, seed, scale)
    if not centroids:
        return rows.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).limit(0), [], []
    encoded = cut_lineage(encode(rows, size, scale))
    for _ in range(rounds):
        centroids = [[s // n for s in sums] if n else old
                     for (n, sums, _), old in zip(_totals(encoded, centroids), centroids, strict=True)]
    inertia = [d for _, _, d in _totals(encoded, centroids)]
    c = _padded(centroids)

    def run(batches):
        for ids, entries, codes in _segments(batches, c.shape[1] // WIDTH):
            near, distance = _nearest(entries, codes, c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(near, pa.int32()), pa.array(distance)],
                                             names=["id", "cluster", "distance"])

    return encoded.mapInArrow(run, "id bigint, cluster int, distance bigint"), centroids, inertia


def _per_cluster(values: list, kind: str) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")[F.col("cluster")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids, inertia = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    most = (1 << 63) - 1
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return rows.select(
        F.col("id").alias("vec_id"), "cluster", "distance",
        _per_cluster([min(i, most) for i in inertia], "bigint").alias("cluster_inertia"),
        F.lit(min(sum(inertia), most)).cast("bigint").alias("inertia"),
        _per_cluster(digests, "string").alias("centroid_sha256"))


def _oracle() -> str:
    near = """a{r} AS (
  SELECT vec_id, e, arg_min(j, (d, j)) AS j, min(d) AS d FROM (
    SELECT v.vec_id, v.e, c.j, list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i]))) AS d FROM v, c{r} c)
  GROUP BY vec_id, e
)"""
    move = """s{r} AS (
  SELECT j, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
    SELECT j, unnest(range(1, 65)) AS i, unnest(e) AS x FROM a{p}) GROUP BY j, i
), m{r} AS (
  SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{r} GROUP BY j
), c{r} AS (
  SELECT c.j, coalesce(m.e, c.e) AS e FROM c{p} c LEFT JOIN m{r} m USING (j)
)"""
    steps = [near.format(r=0)]
    for r in (1, 2, 3):
        steps += [move.format(r=r, p=r - 1), near.format(r=r)]
    return """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, e FROM (SELECT sha256('1:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 16)
), """ + ", ".join(steps) + """, t AS (
  SELECT j, CAST(sum(d) AS BIGINT) AS ci FROM a3 GROUP BY j
)
SELECT a.vec_id, CAST(a.j AS INT) AS cluster, CAST(a.d AS BIGINT) AS distance, t.ci AS cluster_inertia,
  CAST((SELECT sum(ci) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a3 a JOIN t USING (j) JOIN c3 c USING (j)
"""


ORACLE_SQL = _oracle()
