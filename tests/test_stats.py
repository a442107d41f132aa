import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import stats


@pytest.mark.parametrize("octave", [1 << 14, 2])
def test_exact_quantiles_match_numpy(spark, monkeypatch, octave):
    monkeypatch.setattr(stats, "_PER_OCTAVE", octave)
    rng = np.random.default_rng(1)
    parts = {0: rng.normal(0, 1e4, 901), 1: rng.integers(-3, 4, 500).astype(float), 2: np.array([5.0]),
             3: np.concatenate([rng.uniform(1.0, 1.001, 400), -np.exp(rng.normal(0, 20, 100)), [0.0] * 50])}
    pdf = pd.concat([pd.DataFrame({"k": k, "v": v}) for k, v in parts.items()])
    pdf = pd.concat([pdf, pd.DataFrame({"k": [0, 1], "v": [np.nan, np.inf]})])
    probs = [0.0, 0.02, 0.37, 0.5, 0.98, 1.0]
    got = {r["k"]: r for r in stats.exact_quantiles(spark.createDataFrame(pdf), ["k"], ["v"], probs).collect()}
    for k, v in parts.items():
        want = np.quantile(v, probs)
        assert np.allclose([got[k][f"v_q{i}"] for i in range(len(probs))], want, rtol=1e-12), k


def test_whole_numbers_need_one_round(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    assert stats.exact_quantiles(df, [], ["v"], [0.5]).first()[0] == np.median(np.arange(1000) % 7)


def test_top_per_group_with_hot_group(spark):
    df = spark.range(3000).select(F.when(F.col("id") < 2800, 0).otherwise(1).alias("g"), (F.col("id") * 37 % 3001).alias("v"))
    got = stats.top_per_group(df, ["g"], [F.col("v").desc()], 5)
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        want = part["v"].sort_values(ascending=False).head(5).tolist()
        assert [r["v"] for r in got.where(F.col("g") == g).orderBy("rank").collect()] == want


def test_number_rows_is_consecutive_per_key(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"))
    pdf = stats.number_rows(df, ["o"], "n", keys=["k"]).toPandas()
    for _, part in pdf.groupby("k"):
        assert part.sort_values("o")["n"].tolist() == list(range(1, len(part) + 1))
