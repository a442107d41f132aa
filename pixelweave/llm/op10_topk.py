"""Exact top-k search by inner product with pivot-table elimination.

Every vector carries its distances to a fixed set of pivots. For a query q and
a candidate x the triangle inequality gives |q-x| >= |d(q,p) - d(x,p)| for each
pivot p, so the inner product (|q|^2 + |x|^2 - |q-x|^2) / 2 has an upper bound
from the largest of these gaps. Candidates are evaluated in the order of that
bound until the k-th best score exceeds every bound that is left, so results
are exact whatever the pivots are.

Work is laid out as tiles of a bounded block of queries against a bounded block
of candidates, co-grouped by Spark; a tile returns k rows per query. Nothing is
broadcast but the pivots, whose number is a parameter.

Defined results: vectors that are null, empty or hold null or non-finite
components take no part; rows that repeat an id are candidates of their own,
but never of a query with that id; a query without candidates has no rows.
Vectors of unequal length are scored within their own length only. Scores beyond
the range of a long are set to its ends. Columns beyond the id and the vector are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

NAME = "op10_pivot_topk"
PIVOTS = 16          # distances kept per vector
QUERY_BLOCK = 1024   # queries of a tile
ROW_BLOCK = 16384    # candidates of a tile
STEP = 512           # candidates evaluated between two looks at the bound


def quantize(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 1024) -> DataFrame:
    """(id, vec): floor(scale * x) of each component; unusable vectors go."""
    v = F.col(vec_col).cast("array<double>")
    usable = F.col(id_col).isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(id_col).alias("id"),
        F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("vec"))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.int64).reshape(len(col), -1)


def _pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Add ``dist``: the distances to the pivots of the vector's length."""

    def fill(batches):
        for pdf in batches:
            dist = np.empty(len(pdf), object)
            for size, part in pdf.groupby(pdf["vec"].map(len)):
                x = _matrix(part["vec"]).astype(float)
                p = pivots.get(size, np.zeros((0, size)))
                d = np.sqrt(((x[:, None, :] - p[None]) ** 2).sum(2))
                for at, row in zip(pdf.index.get_indexer(part.index), d, strict=True):
                    dist[at] = row
            yield pdf.assign(dist=dist)

    return vectors.mapInPandas(fill, "id bigint, vec array<bigint>, dist array<double>")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in doubles where every sum is exact there."""
    largest = np.abs(a.astype(float)).max() * np.abs(b.astype(float)).max() * a.shape[-1]
    if largest < 2.0 ** 52:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if largest < 2.0 ** 62:
        return a @ b.T
    whole = np.iinfo(np.int64)
    return np.clip(a.astype(object) @ b.T.astype(object), whole.min, whole.max).astype(np.int64)


def _search(q: np.ndarray, q_id: np.ndarray, q_dist: np.ndarray, x: np.ndarray, x_id: np.ndarray,
            x_dist: np.ndarray, k: int):
    """Best k of ``x`` for each query: (query position, id, score)."""
    qn, xn = (q.astype(float) ** 2).sum(1), (x.astype(float) ** 2).sum(1)
    for i in range(len(q)):
        gap = np.zeros(len(x))
        for p in range(x_dist.shape[1]):
            np.maximum(gap, np.abs(x_dist[:, p] - q_dist[i, p]), out=gap)
        # the slack covers the rounding of the distances
        bound = (qn[i] + xn - gap * gap) / 2 + 1e-9 * (qn[i] + xn) + 1
        order = np.argsort(-bound, kind="stable")
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in range(0, len(order), STEP):
            part = order[at:at + STEP]
            if len(ids) == k and bound[part[0]] < scores[-1]:
                break
            part = part[x_id[part] != q_id[i]]
            ids = np.concatenate([ids, x_id[part]])
            scores = np.concatenate([scores, _products(q[i:i + 1], x[part])[0]]) if len(part) else scores
            best = np.lexsort((ids, -scores))[:k]
            ids, scores = ids[best], scores[best]
        yield i, ids, scores


def top_k(queries: DataFrame, rows: DataFrame, k: int = 10, pivots: int = PIVOTS) -> DataFrame:
    """(query_id, rank, id, score): each query's k highest inner products, ties
    to the smaller id. Both inputs are (id, vec) tables as ``quantize`` makes."""
    lengths = [r[0] for r in rows.select(F.size("vec")).distinct().limit(1000).collect()]
    table = {}
    for n in lengths:
        some = rows.where(F.size("vec") == n).orderBy(F.xxhash64("id"), "id").limit(pivots).collect()
        table[n] = np.array([r["vec"] for r in some], dtype=float).reshape(len(some), n)
    n_q, n_x = queries.count(), rows.count()
    nq, nx = max(1, -(-n_q // QUERY_BLOCK)), max(1, -(-n_x // ROW_BLOCK))

    def block(n: int):
        return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")

    qs = _pivot_table(queries, table).withColumn("qb", block(nq)).withColumn(
        "xb", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))))
    xs = _pivot_table(rows, table).withColumn("xb", block(nx)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))

    def tile(key, q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(q) and len(x):
            for size, part in q.groupby(q["vec"].map(len)):
                near = x[x["vec"].map(len) == size]
                if near.empty:
                    continue
                dist = lambda d: np.array(d["dist"].tolist(), float).reshape(len(d), -1)
                q_id = part["id"].to_numpy()
                for i, ids, scores in _search(_matrix(part["vec"]), q_id, dist(part), _matrix(near["vec"]),
                                              near["id"].to_numpy(), dist(near), k):
                    out.append((np.full(len(ids), q_id[i]), ids, scores))
        q_all, ids, scores = (np.concatenate(c) for c in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q_all, "id": ids, "score": scores})

    tiles = qs.groupBy("qb", "xb").cogroup(xs.groupBy("qb", "xb")).applyInPandas(
        tile, "query_id bigint, id bigint, score bigint")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return tiles.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(
        "query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of every row for the rows whose id is divisible by 100."""
    rows = quantize(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(rows.where(F.col("id") % 100 == 0).dropDuplicates(["id", "vec"]), rows).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id,
         CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * x.e[i])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
