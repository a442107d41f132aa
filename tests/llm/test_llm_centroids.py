"""Centroid clustering against plain integer loops."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pixelweave.llm import op13_centroids as op13

SCHEMA = "vec_id bigint, embedding array<float>, cluster string, distance int"


def brute(rows, size, k, rounds, scale=64):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cent = [v for _, v in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cent))
    for _ in range(rounds):
        at = [near(v)[1] for _, v in kept]
        for j in range(len(cent)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                cent[j] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    return sorted(((i, *near(v)[::-1]) for i, v in kept), key=str), cent


def rows_of(seed, size, n=400):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    grid = lambda x: round(x * 16) / 16
    rows = [(i, [grid(x + r.gauss(0, 0.3)) for x in r.choice(middle)]) for i in range(n)]
    some = rows[3][1]
    return rows + [(None, some), (None, some), (3, some), (7, some), (900, None), (901, [1.0]), (902, [None] + some[1:]),
                   (903, [float("nan")] + some[1:]), (904, [float("inf")] + some[1:]), (905, some + [0.0])]


@pytest.mark.parametrize("size,segment", [(6, 4096), (5, 7), (64, 64)])
def test_matches_loops(spark, monkeypatch, size, segment):
    monkeypatch.setattr(op13, "SEGMENT", segment)
    rows = rows_of(size, size)
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA).repartition(3)
    got, centroids, inertia = op13.cluster(df, "vec_id", "embedding", size, 16, 3)
    got = sorted(((r["id"], r["cluster"], r["distance"]) for r in got.collect()), key=str)
    want, cent = brute(rows, size, 16, 3)
    assert got == want and centroids == cent
    assert inertia == [sum(d for _, c, d in want if c == j) for j in range(16)]


def test_dictionaries_are_lossless(spark):
    rows = [(i, v) for i, v in rows_of(1, 5) if v and len(v) == 5 and None not in v]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], SCHEMA)
    kept = op13.kept(df, "vec_id", "embedding", 5)
    enc = op13.encode(kept, 5, 64).toArrow().to_batches()
    back = []
    for ids, entries, codes in op13._segments(enc, 3):
        whole = [e[c] for e, c in zip(entries, codes, strict=True)]
        assert all(len({tuple(x) for x in e.tolist()}) == len(e) for e in entries)
        back += [(i, [int(x) for b in whole for x in b[n]][:5]) for n, i in enumerate(ids.to_pylist())]
    want = [(r["id"], [math.floor(64 * x) for x in r["vec"]]) for r in kept.collect()]
    assert sorted(back, key=str) == sorted(want, key=str)


def test_few_none_and_large(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], "", 0), (2, [3e38, -3e38], "", 0), (None, [0.0, 0.0], "", 0)], SCHEMA)
    got, centroids, inertia = op13.cluster(df, "vec_id", "embedding", 2, 16, 3)
    assert sorted(r["distance"] for r in got.collect()) == [0, 0, 0] and len(centroids) == 3 and sum(inertia) == 0
    assert [op13.LIMIT, -op13.LIMIT] in centroids
    far, _, total = op13.cluster(df, "vec_id", "embedding", 2, 1, 0)
    assert sum(total) == sum(r["distance"] for r in far.collect()) > 1 << 53
    for none in (df.limit(0), df.where(F.col("embedding").isNull())):
        out, c, i = op13.cluster(none, "vec_id", "embedding", 2)
        assert out.count() == 0 and (c, i) == ([], [])
        assert out.columns == ["id", "cluster", "distance"]
