import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pixelweave.operators import align as al, features as ft, nearest, prompts as pr, resample as rs


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (60, 3)) for c in ((0, 0, 0), (3, 0, 1), (0, 4, 2))])
    pdf = pd.DataFrame({"id": np.arange(180), "label": np.repeat([0, 1, 2], 60), "f": x.tolist()})
    return pdf, spark.createDataFrame(pdf, "id bigint, label int, f array<double>").cache()


@pytest.mark.parametrize("k", [1, 5])
def test_knn_by_brute_force(spark, points, k):
    pdf, df = points
    rng = np.random.default_rng(4)
    q = pd.DataFrame({"id": np.arange(1000, 1050), "f": rng.uniform(-1, 5, (50, 3)).tolist()})
    got = nearest.knn_classify(spark.createDataFrame(q, "id bigint, f array<double>"), df, "id", "f", "label", k, block_rows=40)
    x = np.stack(pdf["f"])
    want = {}
    for i, f in zip(q["id"], q["f"]):
        near = np.argsort(((x - f) ** 2).sum(1), kind="stable")[:k]
        votes = np.bincount(pdf["label"].to_numpy()[near], minlength=3)
        want[i] = int(votes.argmax())
    assert {r["id"]: r["prediction"] for r in got.collect()} == want


def plain_knn(pdf, q, k):
    x, y = np.stack(pdf["f"]), pdf["label"].to_numpy()
    out = {}
    for i, f in zip(q["id"], q["f"]):
        near = np.argsort(((x - np.array(f)) ** 2).sum(1), kind="stable")[:k]
        out[i] = int(np.bincount(y[near]).argmax())
    return out


@pytest.mark.parametrize("k", [1, 7])
def test_knn_opens_few_groups(spark, k):
    """Clustered rows with a hot vector: a query is sent to groups near it only."""
    rng = np.random.default_rng(8)
    middles = rng.uniform(-100, 100, (40, 4))
    f = np.concatenate([np.repeat(middles[:1], 400, 0), *(rng.normal(m, 0.5, (20, 4)) for m in middles)])
    pdf = pd.DataFrame({"id": np.arange(len(f)), "label": rng.integers(0, 5, len(f)), "f": f.tolist()})
    q = pd.DataFrame({"id": np.arange(300), "f": (middles[rng.integers(0, 40, 300)] + rng.normal(0, 0.5, (300, 4))).tolist()})
    opened = []
    got = nearest.knn_classify(spark.createDataFrame(q, "id bigint, f array<double>"),
                               spark.createDataFrame(pdf, "id bigint, label int, f array<double>"), "id", "f", "label", k, 25, opened)
    assert {r["id"]: r["prediction"] for r in got.collect()} == plain_knn(pdf, q, k)
    groups = -(-len(f) // 25)
    assert sum(opened) < 300 * groups / 4 and opened[0] >= 300


def test_knn_tasks_do_not_follow_the_number_of_pivots(spark):
    """Without pruning, a query is sent to at most ``PIVOTS`` blocks of small
    groups; far rows do not come back once a k-th distance is known."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 24))
    pdf = pd.DataFrame({"id": np.arange(1500), "label": rng.integers(0, 3, 1500), "f": x.tolist()})
    q = pd.DataFrame({"id": np.arange(60) + 9000, "f": rng.normal(size=(60, 24)).tolist()})
    opened = []
    got = {r["id"]: r["prediction"] for r in nearest.knn_classify(
        spark.createDataFrame(q, "id bigint, f array<double>"), spark.createDataFrame(pdf, "id bigint, label int, f array<double>"),
        "id", "f", "label", 3, 10, opened).collect()}
    assert sum(opened) <= 60 * 64
    for i, f in zip(q["id"], q["f"], strict=True):
        d = np.sqrt(((x - np.array(f)) ** 2).sum(1))
        votes = np.bincount(pdf["label"].to_numpy()[np.lexsort((pdf["id"], d))[:3]])
        assert got[i] == votes.argmax()
    near, _ = nearest._compare(3, "bigint", "bigint")
    qs = pd.DataFrame({"_q": [1, 2], "_f": [x[0], x[0]], "_tau": [np.inf, 0.0]})
    ts = pd.DataFrame({"_tk": pdf["id"], "_l": pdf["label"], "_f": list(x)})
    assert near(qs, ts).groupby("_q").size().to_dict() == {1: 3, 2: 1}


def test_knn_without_vectors(spark, points):
    pdf, df = points
    bad = [(1000, None), (1001, [float("nan"), 0.0, 0.0]), (1002, []), (1003, [0.1, 0.1, 0.1])]
    q = spark.createDataFrame(bad, "id bigint, f array<double>")
    more = spark.createDataFrame([(900, 2, None), (901, None, [0.1, 0.1, 0.1]), (902, 2, [None, 1.0, 1.0])], "id bigint, label int, f array<double>")
    for k in (1, 3):
        got = {r["id"]: r["prediction"] for r in nearest.knn_classify(q, df.unionByName(more), "id", "f", "label", k, 50).collect()}
        assert got == {1000: None, 1001: None, 1002: None, 1003: 0}
        none = nearest.knn_classify(q, df.limit(0), "id", "f", "label", k).collect()
        assert len(none) == 4 and all(r["prediction"] is None for r in none)


def test_several_starts_keep_the_best(spark):
    """Groups on which one start often ends in a bad fit."""
    rng = np.random.default_rng(2)
    rows = []
    for scene, spots in enumerate([((0, 0), (0, 1), (40, 0)), ((5, 5), (5, 9), (60, 7)), ((0, 0), (0, 0), (0, 0))]):
        for c in spots:
            rows += [(scene, len(rows) + i, (np.array(c, float) + (rng.normal(0, 0.05, 2) if scene < 2 else 0)).tolist()) for i in range(30)]
    df = spark.createDataFrame(rows + [(0, 9999, None)], "scene_id bigint, id bigint, f array<double>")
    start = ft.scene_centers(df, "f", "id", 3, ["scene_id"], starts=5)
    sums = {(r["scene_id"], r["start"]): r["inertia"] for r in ft.kmeans_per_scene(df, "f", start, ["scene_id"], inertias=True).collect()}
    best = ft.kmeans_per_scene(df, "f", start, ["scene_id"])
    assert best.groupBy("scene_id").count().where("scene_id < 2 and count <> 3").count() == 0
    got = ft.assign_scene_clusters(df, "f", best, ["scene_id"])
    assert got.where("f is null and cluster is not null").count() == 0
    centre = {(r["scene_id"], r["cluster"]): np.array(r["center"]) for r in best.collect()}
    for s in (0, 1, 2):
        total = sum(((np.array(r["f"]) - centre[s, r["cluster"]]) ** 2).sum() for r in got.where(f"scene_id = {s} and f is not null").collect())
        assert total == pytest.approx(min(v for (scene, _), v in sums.items() if scene == s), abs=1e-9)
        assert len({st for scene, st in sums if scene == s}) == 5


def test_null_vectors_stay_null(spark, points):
    _, df = points
    some = df.unionByName(spark.createDataFrame([(999, 0, None)], "id bigint, label int, f array<double>"))
    _, rows = ft.kmeans_fit(some, "f", 3, starts=2)
    assert rows.count() == 181 and rows.where("cluster is null").select("id").collect()[0][0] == 999
    out, shares = ft.pca_project(some, "f", 2, whiten=True)
    assert out.count() == 181 and out.where("projection is null").count() == 1 and len(shares) == 2


def test_kmeans_finds_the_groups(points):
    pdf, df = points
    centers = ft.kmeans_iterate(df, "f", "id", k=3, iters=20, seed=1)
    got = ft.assign_clusters(df, "f", centers).groupBy("label", "cluster").count()
    model, rows = ft.kmeans_fit(df, "f", 3, sample=("id", 100))
    assert rows.groupBy("label").agg(F.count_distinct("cluster").alias("n")).where("n > 1").count() == 0
    assert len(centers) == 3 and got.agg(F.sum("count")).first()[0] == 180


def test_empty_cluster_takes_a_row(points):
    pdf, df = points
    s = {r["cluster"]: r for r in ft.kmeans_step(df, "f", [[0, 0, 0], [900, 900, 900]], "id").collect()}
    assert s[1]["n"] == 0 and any(np.allclose(s[1]["center"], f) for f in pdf["f"])
    assert np.allclose(s[0]["center"], np.stack(pdf["f"]).mean(0))


def test_ties_take_the_lowest(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0])], "id bigint, f array<double>")
    assert ft.assign_clusters(df, "f", [[1, 0], [0, 1]]).first()["cluster"] == 0
    assert ft.linear_probe_predict(df, "f", [[1, 0], [0, 1]], [0, 0]).first()["prediction"] == 0


def test_covariance_and_pca(points):
    pdf, df = points
    x = np.stack(pdf["f"])
    cov = np.cov(x.T)
    for r in ft.covariance_matrix(df, "f").collect():
        assert r["cov"] == pytest.approx(cov[r["i"], r["j"]])
    got, ratio = ft.pca_project(df, "f", 2)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert np.allclose(ratio, values[:2] / values.sum())
    p = np.stack([r["projection"] for r in got.orderBy("id").collect()])
    assert np.allclose(np.var(p, axis=0, ddof=1), values[:2])
    white, _ = ft.pca_project(df, "f", 2, standardize=True, whiten=True)
    w = np.stack([r["projection"] for r in white.collect()])
    assert np.allclose(w.std(0, ddof=1), 1)


def test_probe_learns(points):
    _, df = points
    two = df.where("label < 2")
    w, b = ft.linear_probe_fit(two, "f", "label")
    assert ft.linear_probe_predict(two, "f", w, b).where("prediction = label").count() > 115


def test_sampling_is_exact_and_repeatable(spark):
    df = spark.range(5000)
    one, two = (sorted(r["id"] for r in ft.sample_rows(df, "id", 700, seed=2).collect()) for _ in range(2))
    assert one == two and len(set(one)) == 700
    assert ft.sample_rows(df, "id", 9000).count() == 5000


def test_pick_falls_back_when_coverage_is_extreme(spark):
    s = spark.createDataFrame([(0, 0.97, 5.0), (1, 0.01, 1.0), (2, 0.02, 0.5), (3, 0.0, float("-inf"))], "cluster int, coverage double, score double")
    assert ft.pick_cluster(s).first()[0] == 2
    assert ft.pick_cluster(s.where("cluster in (0, 3)")).first()[0] == 0
    assert ft.pick_cluster(s.where("cluster > 0")).first()[0] == 1


def test_score_skips_nan(spark):
    df = spark.createDataFrame([(0, [1.0, float("nan")]), (0, [3.0, 4.0])], "cluster int, f array<double>")
    r = ft.score_clusters(df, "f", 1, bounds=(0.0, 1.0)).first()
    assert r["score"] == pytest.approx(np.nanstd([1, 3, 4]) + 0.1 * 5.0)


def test_fallback_prompts_for_an_empty_scene(spark, make):
    obj, points = pr.seed_prompts(make.values(np.zeros((64, 64)), "index"), make.scenes((64, 64)), [95, 80], 5, 0, 3, 2, tile=32)
    assert obj.count() == 0
    got = sorted((r["label"], r["y"], r["x"]) for r in points.collect())
    assert got == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 1), (1, 0, 2)]


def test_fallback_counts_are_capped(spark, make):
    got = pr.topk_prompts(make.values(np.array([[1.0, 2.0]]), "index"), 10, 10)
    assert got.count() == 4


def test_seed_prompts_stop_at_the_cap(spark, make):
    a = np.zeros((60, 60))
    for i, s in enumerate((9, 7, 5, 11)):
        a[14 * i + 1:14 * i + 1 + s, 5:5 + s] = 1.0
    obj, points = pr.seed_prompts(make.values(a, "index"), make.scenes((60, 60)), [90.0, 50.0], 3, 0, floor_area=20, tile=32)
    rows = obj.orderBy("rank").collect()
    assert [r["area"] for r in rows] == [121, 81, 49] and points.count() == 0
    assert (rows[0]["cx"], rows[0]["cy"]) == (10.0, 48.0) and rows[0]["box_x0"] == 0


def test_prompt_groups(spark):
    pts = spark.createDataFrame([(1, 2, 5.0, 6.0, 0), (1, 1, 3.0, 4.0, 1)], "obj_id bigint, seq bigint, x double, y double, label int")
    box = spark.createDataFrame([(2, 8.0, 9.0, 2.0, 1.0)], "obj_id bigint, x0 double, y0 double, x1 double, y1 double")
    got = {r["obj_id"]: r for r in pr.pack_prompts(pr.assemble_prompts(pts, box)).collect()}
    assert got[1]["points"] == [[3.0, 4.0], [5.0, 6.0]] and got[1]["labels"] == [1, 0] and got[1]["box"] == [0.0] * 4
    assert got[2]["points"] == [[5.0, 5.0]] and got[2]["labels"] == [1] and got[2]["box"] == [2.0, 1.0, 8.0, 9.0]
    none = pr.pack_prompts(pr.assemble_prompts(pts, box.where("obj_id > 5"))).collect()
    assert len(none) == 1 and none[0]["box"] is None


def test_plane_survives_resizing(spark, make):
    yy, xx = np.indices((12, 10))
    sizes = spark.createDataFrame([(0, 12, 10, 36, 30)], "scene_id bigint, src_h int, src_w int, dst_h int, dst_w int")
    y, x = np.indices((36, 30))
    want = 2 * ((x + .5) / 3 - .5) + (y + .5) / 3 - .5
    got = make.array(rs.resize_bilinear(make.values(2.0 * xx + yy), sizes, ["v"]), (36, 30), "v")
    assert np.allclose(got[2:-2, 2:-2], want[2:-2, 2:-2])
    flat = make.array(rs.resize_bicubic(make.values(np.full((12, 10), 3.0)), sizes, ["v"]), (36, 30), "v")
    assert np.allclose(flat, 3.0)


@pytest.mark.parametrize("kernel", ["bilinear", "bicubic"])
def test_resizing_keeps_nodata(spark, make, kernel):
    """An output is NULL where a source that it draws on is NULL or missing, else as without gaps."""
    a = np.arange(48.0).reshape(6, 8) ** 1.5
    sizes = spark.createDataFrame([(0, 6, 8, 13, 21)], "scene_id bigint, src_h int, src_w int, dst_h int, dst_w int")
    fn = rs.resize_bilinear if kernel == "bilinear" else rs.resize_bicubic
    whole = make.array(fn(make.values(a), sizes, ["v"]), (13, 21), "v")
    df = make.values(a)
    holes = df.withColumn("v", F.when(~((F.col("y") == 2) & (F.col("x") == 3)), F.col("v"))).where("not (y = 5 and x = 7)")
    got = {(r["y"], r["x"]): r["v"] for r in fn(holes, sizes, ["v"]).collect()}
    for y in range(13):
        for x in range(21):
            sy, sx = (y + .5) * 6 / 13 - .5, (x + .5) * 8 / 21 - .5
            if kernel == "bilinear":
                sy, sx = min(max(sy, 0), 5), min(max(sx, 0), 7)
                near = lambda s, p: abs(s - p) < 1
                uses = (near(sy, 2) and near(sx, 3)) or (near(sy, 5) and near(sx, 7))
            else:
                taps = lambda s, n: {min(max(int(np.floor(s)) + k, 0), n - 1) for k in (-1, 0, 1, 2)}
                uses = (2 in taps(sy, 6) and 3 in taps(sx, 8)) or (5 in taps(sy, 6) and 7 in taps(sx, 8))
            v = got.get((y, x))
            assert (v is None) if uses else v == pytest.approx(whole[y, x]), (y, x)


def test_block_shift_finds_the_move(spark, make):
    rng = np.random.default_rng(11)
    a = rng.random((128, 128))
    a = a + np.roll(a, 1, 0) + np.roll(a, 1, 1)
    ref = make.values(a)
    moved = al.shift_scene(ref, 3, -5).where("y >= 0 and x >= 0")
    got = al.block_shift(ref, moved, "v", block=64, max_shift=8).collect()
    assert len(got) == 4 and {(r["dx"], r["dy"]) for r in got} == {(3, -5)}


def test_reprojection_across_zones_keeps_most_labels(spark, make):
    from pixelweave.functions import geo

    lab = make.mask(np.ones((50, 50), bool)).withColumn("label", F.lit(4)).drop("scene_id")
    base = spark.createDataFrame([(0, 40, 40, 25832, 32631, 300250.0, 5899750.0)], "scene_id bigint, height int, width int, epsg0 int, epsg int, e double, n double")
    src = base.select(F.col("epsg0").alias("epsg"), geo.affine(10.0, 0.0, 300000.0, 0.0, -10.0, 5900000.0).alias("transform"))
    mid = geo.add_latlon(base, "e", "n", "epsg0", "lat", "lon")
    tgt = geo.add_utm(mid, "lat", "lon", "epsg", "te", "tn").withColumn(
        "transform", geo.affine(10.0, 0.0, F.col("te") - 200.0, 0.0, -10.0, F.col("tn") + 200.0))
    got = rs.reproject_nearest(lab, src, tgt.select("scene_id", "height", "width", "epsg", "transform"))
    assert got.count() == 1600 and got.where("label = 4").count() > 1500


def test_null_vectors_stay_null(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [9.0, 9.0]), (4, None)], "id int, f array<double>").coalesce(1)
    got = {r["id"]: r["cluster"] for r in ft.assign_clusters(df, "f", [[0.0, 0.0], [9.0, 9.0]]).collect()}
    assert got == {1: 0, 2: None, 3: 1, 4: None}
    got = {r["id"]: r["prediction"] for r in ft.linear_probe_predict(df, "f", [[0.0, 0.0], [1.0, 1.0]], [1.0, 0.0]).collect()}
    assert got == {1: 0, 2: None, 3: 1, 4: None}
    assert ft.covariance_matrix(df, "f").count() == 3
    assert ft.kmeans_step(df, "f", [[0.0, 0.0], [50.0, 50.0]], "id").orderBy("cluster").select("n").collect()[1][0] in (0, 1)


def test_scenes_are_segmented_apart(spark):
    import numpy as np
    rng = np.random.default_rng(2)
    rows = [(s, i, [float(c + rng.normal(0, 0.1)), float(rng.normal(0, 0.1))], float(c == s), 0.0)
            for s in (0, 1) for i, c in enumerate([0] * 30 + [1] * 30)]
    df = spark.createDataFrame(rows, "scene_id bigint, id int, f array<double>, g double, r double")
    got = ft.segment_unsupervised(df, "f", "id", green="g", red="r").collect()
    assert {(r["scene_id"], r["id"]) for r in got} == {(0, i) for i in range(30)} | {(1, i) for i in range(30, 60)}


def test_tile_scenes_do_not_collide(spark):
    from pixelweave.operators.tiles import tile_stride
    from pixelweave.plans import flows
    sc = spark.createDataFrame([(0, 1100, 1100), (1, 3, 3)], "scene_id bigint, height int, width int")
    px = spark.createDataFrame([(0, 1099, 1099), (1, 0, 0)], "scene_id bigint, y int, x int")
    rows, sized = flows.tiles_as_scenes(px, sc, tile_stride(1, 1))
    assert sized.select("scene_id").distinct().count() == sized.count() == 1100 * 1100 + 9
    assert rows.join(sized.select("scene_id", "scene_id0"), "scene_id").select("scene_id0").distinct().count() == 2


def test_many_scenes_are_fitted_from_chunks(spark):
    """More groups than an aggregate of vectors hashes, one of them hot: an
    update is the mean of each centre's rows, and no vector aggregate is planned."""
    rng = np.random.default_rng(11)
    scene = np.concatenate([np.arange(200).repeat(6), np.full(900, 7)])
    x = rng.normal(size=(len(scene), 3))
    df = spark.createDataFrame(pd.DataFrame({"s": scene, "f": x.tolist()}), "s bigint, f array<double>")
    chunks = ft._chunks(df.select("s", F.col("f").alias("_f")), ["s"]).toPandas()
    assert chunks["_x"].map(len).sum() == x.size and len(chunks) < len(scene)
    start = spark.createDataFrame([(i, c, [float(c), 0.5, -0.5]) for i in range(200) for c in range(2)], "s bigint, cluster int, center array<double>")
    got = {(r["s"], r["cluster"]): r["center"] for r in ft.kmeans_per_scene(df, "f", start, ["s"], iters=1).collect()}
    first = np.array([[0, 0.5, -0.5], [1, 0.5, -0.5]])
    near = ((x[:, None] - first[None]) ** 2).sum(2).argmin(1)
    assert len(got) == 400
    for (s_, c), center in got.items():
        mine = x[(scene == s_) & (near == c)]
        np.testing.assert_allclose(center, mine.mean(0) if len(mine) else first[c], rtol=1e-12)
