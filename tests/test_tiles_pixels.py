import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelweave.functions import geo, scalar as sc, vectors as vec
from pixelweave.operators import pixels as po, tiles as tl
from pixelweave.operators import merge as mg


def test_padded_grid_count(spark, make):
    t = tl.list_tiles(make.scenes((2560, 3584)), tl.tile_padded(1024, 512)).orderBy("tile_id").collect()
    assert len(t) == 35 and (t[0]["y0"], t[0]["x0"]) == (0, 0)
    assert all(r["y1"] - r["y0"] == 1024 for r in t)


def test_padded_grid_checks(spark, make):
    assert tl.list_tiles(make.scenes((2048, 2048)), tl.tile_padded(1024, 128)).count() > 0
    with pytest.raises(Exception, match="Image too small"):
        tl.list_tiles(make.scenes((100, 100)), tl.tile_padded(1024, 128)).collect()
    for size, overlap in ((10, 10), (0, 0), (10, -1)):
        with pytest.raises(ValueError):
            tl.tile_padded(size, overlap)


def test_padded_tile_is_zero_beyond_the_scene(spark, make):
    px = make.values(np.ones((100, 100)))
    got = tl.padded_tile_pixels(px, make.scenes((100, 100)), tl.tile_padded(50, 10), ["v"]).where("y0 = 80 and x0 = 80")
    assert got.count() == 2500 and got.agg(F.sum("v")).first()[0] == 400


@pytest.mark.parametrize("grid", [
    tl.tile_stride(8, 5), tl.tile_stride(8, 5, cover_edges=True), tl.tile_snapped(8, 3), tl.tile_snapped(8, 8),
    tl.tile_padded(8, 3), tl.tile_shifted(8), tl.tile_snapped(100, 3), tl.tile_stride(100, 3),
])
def test_assignment_agrees_with_tile_list(spark, make, grid):
    shape = (21, 17)
    sc_, px = make.scenes(shape), make.mask(np.ones(shape, bool))
    tiles = tl.list_tiles(sc_, grid).collect()
    want = sorted((y, x, t["y0"], t["x0"]) for t in tiles for y in range(shape[0]) for x in range(shape[1])
                  if t["y0"] <= y < t["y1"] and t["x0"] <= x < t["x1"])
    got = sorted((r["y"], r["x"], r["y0"], r["x0"]) for r in tl.assign_tiles(px, sc_, grid).collect())
    assert got == want
    if grid.kind != "stride" or grid.cover_edges:
        assert {(a, b) for a, b, _, _ in got} == {(y, x) for y in range(21) for x in range(17)}


def test_constant_scene_stitches_to_constant(spark, make):
    px = make.values(np.full((30, 41), 7.0))
    got = mg.stitch_mean(tl.assign_tiles(px, make.scenes((30, 41)), tl.tile_snapped(16, 6)), "v")
    assert got.count() == 30 * 41 and got.where("v <> 7").count() == 0


def test_degrees_and_centres(spark):
    one = spark.range(1)
    v = one.select(geo.meters_to_lat_deg(F.lit(111320.0)).alias("a"), geo.meters_to_lon_deg(F.lit(111320.0), F.lit(0.0)).alias("b"),
                   geo.meters_to_lon_deg(F.lit(111320.0), F.lit(60.0)).alias("c"),
                   tl.grid_centers(F.lit(0.0), F.lit(10.0), F.lit(6.0), F.lit(5.0)).alias("d"),
                   tl.grid_centers(F.lit(0.0), F.lit(4.0), F.lit(6.0), F.lit(5.0)).alias("e"),
                   tl.grid_centers(F.lit(0.0), F.lit(1.0), F.lit(0.6), F.lit(0.5)).alias("f"),
                   tl.grid_centers(F.lit(0.0), F.lit(0.0), F.lit(0.6), F.lit(0.5)).alias("g")).first()
    assert [round(x, 3) for x in v[:3]] == [1.0, 1.0, 2.0] and v[3:5] == ([3.0, 7.0], [2.0])
    assert np.allclose(v["f"], [0.3, 0.7]) and v["g"] == [0.0]
    with pytest.raises(Exception, match="degree length"):
        one.select(geo.meters_to_lon_deg(F.lit(1.0), F.lit(120.0))).collect()


def test_one_launch_patch(spark):
    b = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0)], "lat1 double, lon1 double, lat2 double, lon2 double")
    assert tl.latlon_patches(b, 512, 10.0).count() == 1
    with pytest.raises(ValueError):
        tl.latlon_patches(b, 12, 10.0)


def test_token_grid_errors_when_counts_do_not_fit(spark):
    with pytest.raises(Exception, match="token count"):
        spark.range(1).select(tl.token_grid(F.lit(32), F.lit(32), F.lit(7), 16)).collect()


def test_to_uint8(spark, make):
    px = make.values(np.array([[0, .5], [.75, 1]]))
    assert make.array(po.to_uint8(px, ["v"], use_percentile=False), (2, 2), "v").tolist() == [[0, 127], [191, 255]]
    assert po.to_uint8(px, ["v"], is_byte=True) is px
    flat = po.to_uint8(make.values(np.full((2, 2), 9.0)), ["v"]).select("v").distinct().collect()
    assert [r["v"] for r in flat] == [0]


def test_stretch_without_spread(spark, make):
    got = lambda c: po.stretch_2_98(make.values(np.full((4, 4), c)), ["v"]).select("v").distinct().collect()[0]["v"]
    assert got(7.0) == 1.0 and got(0.0) == 0.0 and got(-2.0) == 1.0


def test_bands_are_checked(spark):
    df = spark.createDataFrame([(0, 0, 0, [1.0, 2.0])], "scene_id bigint, y int, x int, bands array<double>")
    with pytest.raises(Exception, match="out of range"):
        po.pick_bands(df, [3], ["b"]).collect()
    with pytest.raises(Exception, match="out of range"):
        po.pick_bands(df, [0], ["b"]).collect()
    with pytest.raises(Exception, match="two bands"):
        po.rgb_from_order(df).collect()
    one = spark.createDataFrame([(0, 0, 0, [4.0])], df.schema)
    assert po.rgb_from_order(one).select("r", "g", "b").first() == (4.0, 4.0, 4.0)


def test_reflectance_scaling(spark, make):
    got = po.scale_reflectance(make.values(np.array([[0.5, 1.05, -0.1]])), ["v"])
    assert sorted(r["v"] for r in got.collect()) == [0, 5000, 10000]
    raw = po.scale_reflectance(make.values(np.array([[1234.9, 3.2]])), ["v"])
    assert sorted(r["v"] for r in raw.collect()) == [3, 1234]


def test_colours(spark):
    labels = spark.createDataFrame([(0, 0, 0, 0), (0, 0, 1, 3)], "scene_id bigint, y int, x int, label bigint")
    rows = {r["label"]: r for r in po.colorize_labels(labels).collect()}
    assert (rows[0]["r"], rows[0]["g"], rows[0]["b"]) == (0, 0, 0)
    lut = po.label_colours(labels)
    same = {r["label"]: r for r in po.colorize_labels(labels, lut).collect()}
    assert all(rows[k][c] == same[k][c] for k in rows for c in "rgb")


def test_layouts(spark):
    df = spark.createDataFrame([([4, 512, 600],), ([512, 600, 4],), ([512, 600],), ([512, 600, 3],)], "s array<int>")
    assert [r[0] for r in df.select(sc.infer_layout(F.col("s"))).collect()] == ["CHW", "HWC", "HW", "HWC"]
    assert [r[0] for r in df.select(sc.infer_layout_strict(F.col("s"))).collect()] == ["CHW", "HWC", "HW", "HWC"]


def test_vectors(spark):
    v = spark.createDataFrame([([3.0, 4.0],)], "v array<float>")
    r = v.select(vec.l2_normalize(F.col("v")).alias("n"), vec.unstandardize_bands(F.array(F.lit(0.1), F.lit(9.0)), [0.5, 0.5], [0.2, 0.2]).alias("u"),
                 vec.mean_layers(F.array(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(6.0)))).alias("m")).first()
    assert np.allclose(r["n"], [0.6, 0.8]) and np.allclose(r["u"], [0.52, 1.0]) and r["m"] == [2.0, 4.0]
