"""Scenes, groups and rings of bounded size are worked on whole: with the results of
the distributed forms, but without their rounds."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import components as cp, distance as ds, features as ft, flood as fl, outlines as ol
from pixelweave.operators import pixels as po, regions as rg
from pixelweave.operators.hashing import hashes52


def counted(monkeypatch, module):
    """The tables that a module writes from here on."""
    tables, real = [], module.cut_lineage
    monkeypatch.setattr(module, "cut_lineage", lambda *a: tables.append(1) or real(*a))
    return tables


@pytest.fixture(scope="module")
def lines(spark):
    """Two groups whose fits move for many rounds, and one of equal rows."""
    rng = np.random.default_rng(5)
    rows = [(s, 1000 * s + i, [float(v), float(w)]) for s in (0, 1) for i, (v, w) in enumerate(rng.uniform(0, 9, (400, 2)))]
    rows += [(2, 2000 + i, [1.0, 2.0]) for i in range(5)] + [(0, 3000, None)]
    return spark.createDataFrame(rows, "s bigint, id bigint, f array<double>").repartition(3, "id")


def test_fits_of_small_groups_equal_the_rounds(spark, monkeypatch, lines):
    start = ft.scene_centers(lines, "f", "id", 3, ["s"], starts=2)
    rounds = counted(monkeypatch, ft)
    def fit(most, **more):
        return {tuple(r[c] for c in r.__fields__ if c not in ("center", "inertia")): r[-1]
                for r in ft.kmeans_per_scene(lines, "f", start, ["s"], max_rows=most, **more).collect()}
    want, by_rounds = fit(0), len(rounds)
    for most in (10, 1000):      # some groups, all groups
        del rounds[:]
        got = fit(most)
        assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    assert by_rounds > 10 and len(rounds) <= 6
    want, got = fit(0, inertias=True), fit(10, inertias=True)
    assert len(want) == 6 and got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_draws_from_packed_rows_equal_those_from_rows(spark, monkeypatch, lines):
    def drawn():
        return {(r["s"], r["start"], r["cluster"]): r["center"] for r in ft.scene_centers(lines, "f", "id", 3, ["s"], 7, 3).collect()}
    got = drawn()
    monkeypatch.setattr(ft, "_TEXT_KEYS", ())
    assert got == drawn() and len(got) == 2 * 9 + 3


def test_hashes_equal_md5():
    texts = ["", "0", "12345678901", "-7", "ä" * 20, "x" * 55, "y" * 70, "1000"]
    got = hashes52(pa.array(texts).slice(1), ["", ":0:4:1"])
    for line, end in zip(got, ("", ":0:4:1"), strict=True):
        assert line.tolist() == [int(hashlib.md5((t + end).encode()).hexdigest()[:13], 16) for t in texts[1:]]


def test_components_of_small_scenes_need_one_table(spark, make, monkeypatch):
    a = np.random.default_rng(3).random((20, 60)) < 0.5
    want = make.array(cp.connected_components(make.mask(a), make.scenes(a.shape), 4, 8), a.shape, "label")
    tables = counted(monkeypatch, cp)
    got = cp.connected_components(make.mask(a), make.scenes(a.shape), 4, 20)
    assert np.array_equal(make.array(got, a.shape, "label"), want) and len(tables) == 1


def test_small_scenes_equal_tiled_ones(spark, make):
    rng = np.random.default_rng(8)
    masks = [rng.random((30, 20)) < 0.8, rng.random((4, 5)) < 0.8, np.ones((5, 5), bool), np.zeros((9, 30), bool)]
    sc = make.scenes(*[m.shape for m in masks])
    df = make.mask(masks[0], 0)
    for i, m in enumerate(masks[1:3], 1):
        df = df.unionByName(make.mask(m, i))
    far = {t: ds.distance_transform(df, sc, t).select("scene_id", "y", "x", "d2") for t in (3, 64)}
    assert set(map(tuple, far[3].collect())) == set(map(tuple, far[64].collect()))
    none = {(i, y, x) for i, m in enumerate(masks) for y, x in np.argwhere(~m).tolist()}
    for tile in (3, 64):
        got = [tuple(r) for r in po.complement(df.unionByName(df), sc, tile).collect()]
        assert len(got) == len(none) and set(got) == none
    h = far[64].where("d2 is not null")
    marks = h.where("(y * 7 + x) % 11 = 0").withColumn("label", (F.col("y") * 100 + F.col("x")).cast("bigint")).drop("d2")
    flooded = [set(map(tuple, fl.queue_watershed(h, marks, sc, tile=t).select("scene_id", "y", "x", "label").collect())) for t in (3, 64)]
    assert flooded[0] == flooded[1] and flooded[0]


def test_short_rings_are_simplified_as_long_ones(spark, make):
    rng = np.random.default_rng(4)
    a = np.kron(rng.integers(0, 5, (4, 5)), np.ones((6, 6), int)) * (rng.random((24, 30)) < 0.95)
    df = make.values(a, "label").where("label > 0").withColumn("label", F.col("label").cast("bigint"))
    rings = ol.outer_rings(rg.border(df), make.scenes(a.shape), 64)
    got, levels = (set(map(tuple, ol.simplified(rings, 0.01, n).collect())) for n in (100_000, 0))
    assert got == levels and len(got) > 30
