"""Top-k search against brute force."""

import math
import random

from pixelweave.llm import op10_topk


def brute(vectors, k):
    q = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors
         if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, a in {(i, tuple(v)) for i, v in q if i % 100 == 0}:
        all_ = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in q if j != i and len(b) == len(a))
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(all_[:k])]
    return sorted(out)


def run(spark, vectors, k=10):
    df = spark.createDataFrame([(i, v, "c", 1.0) for i, v in vectors], "vec_id bigint, embedding array<float>, vec string, dist double")
    rows = op10_topk.quantize(df, "vec_id", "embedding")
    got = op10_topk.top_k(rows.where("id % 100 = 0").dropDuplicates(["id", "vec"]), rows, k)
    return sorted(tuple(r) for r in got.collect())


def test_matches_brute_force(spark):
    r = random.Random(3)
    import numpy as np

    v = [(i, [float(np.float32(r.gauss(0, 0.2))) for _ in range(6)]) for i in range(901)]
    v += [(1000 + i, v[5][1]) for i in range(40)]                      # ties
    v += [(2000, None), (2001, []), (2002, [None] * 6), (2003, [float("nan")] * 6), (None, v[0][1]), (2100, [float("inf")] * 6)]
    assert run(spark, v) == brute(v, 10)
    assert run(spark, v[:4]) == brute(v[:4], 10)
    assert run(spark, v[:1]) == [] and run(spark, [(1, None)]) == []


def test_repeated_rows_and_large_values(spark):
    v = [(0, [3.0e6, -2.0e6]), (1, [3.0e6, 1.0]), (1, [3.0e6, 1.0]), (2, [-1.0, 5.0]), (100, [0.0, 0.0]), (100, [0.0, 0.0])]
    want = [(q, r, i, min(s, 2**63 - 1)) for q, r, i, s in brute(v, 3)]
    assert run(spark, v, 3) == want
