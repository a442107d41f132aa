import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import plain_rings
from conftest import discs
from pixelweave.operators import boxes as bx, masks as mk, outlines as ol, regions as rg, stencil as st


def labelled(make, a, n=1):
    return make.mask(a).withColumn("label", F.lit(n).cast("bigint"))


def test_square_region(spark, make):
    a = np.zeros((20, 20), bool)
    a[4:14, 5:15] = True
    lab, sc = labelled(make, a), make.scenes((20, 20))
    r = rg.region_table(lab, sc, 1).first()
    assert (r["area"], r["min_row"], r["min_col"], r["max_row"], r["max_col"]) == (100, 4, 5, 14, 15)
    assert (r["centroid_row"], r["centroid_col"]) == (8.5, 9.5) and (r["px"], r["py"]) == (9.5, -8.5)
    assert r["perimeter"] == pytest.approx(36.0) and r["solidity"] == 1.0 and r["eccentricity"] == pytest.approx(0, abs=1e-6)
    assert {(p["x"], p["y"]) for p in r["ring"]} == {(5.0, -4.0), (14.0, -4.0), (14.0, -13.0), (5.0, -13.0)}
    assert r["wkt"].startswith("POLYGON ((")


def test_solidity_of_an_l_shape(spark, make):
    a = np.zeros((12, 12), bool)
    a[1:11, 1:4] = True
    a[8:11, 1:11] = True
    r = rg.region_solidity(labelled(make, a)).first()
    assert r["area"] == int(a.sum()) and r["area"] < r["convex_area"] < 100


def test_hull_pixels_by_half_planes():
    a = discs((30, 30), [(12, 11), (18, 20)], 6)
    ys, xs = np.nonzero(a)
    rows = np.unique(ys)
    lo = np.array([xs[ys == y].min() for y in rows], float)
    hi = np.array([xs[ys == y].max() for y in rows], float)
    got = rg.hull_row_pixels(rg.convex_hull(rg.diamond_points(rows.astype(float), lo, hi)), int(rows.min()), int(rows.max()))
    pts = np.concatenate([np.stack([xs + dx, ys + dy], 1) for dx, dy in ((.5, 0), (-.5, 0), (0, .5), (0, -.5))])
    hull = rg.convex_hull(pts)
    nxt = np.roll(hull, -1, axis=0)
    want = sum(all((n[0] - p[0]) * (y - p[1]) - (n[1] - p[1]) * (x - p[0]) >= -1e-9 for p, n in zip(hull, nxt))
               for y in range(30) for x in range(30))
    assert got == want


@pytest.mark.parametrize("strip", [1, 3, 256])
def test_merged_hulls_equal_one_hull(spark, make, strip):
    """Regions over many strips, one of them far from the first rows."""
    rng = np.random.default_rng(strip)
    a = np.zeros((90, 60), int)
    for label, (y, x) in enumerate(((5, 5), (40, 20), (60, 40)), 1):
        a[y:y + 28, x:x + 18][rng.random((28, 18)) < 0.2] = label
    a[3:88, 58] = 4
    df = make.values(a, "label").where("label > 0").withColumn("label", F.col("label").cast("bigint"))
    for r in rg.region_solidity(df, strip).collect():
        ys, xs = np.nonzero(a == r["label"])
        rows = np.unique(ys)
        ends = [np.array([f(xs[ys == y]) for y in rows], float) for f in (np.min, np.max)]
        hull = rg.convex_hull(rg.diamond_points(rows.astype(float), *ends))
        assert (r["area"], r["convex_area"]) == (len(ys), rg.hull_row_pixels(hull, int(rows.min()), int(rows.max())))
        assert r["solidity"] == r["area"] / r["convex_area"]
    assert rg.region_solidity(df.limit(0), strip).count() == 0


def regions_of(seed):
    """Ragged regions with holes, several parts, lines and lone pixels."""
    rng = np.random.default_rng(seed)
    a = np.zeros((40, 46), int)
    a[2:20, 3:25] = np.where(rng.random((18, 22)) < 0.62, 1, 0)
    a[22:38, 2:40] = np.where(rng.random((16, 38)) < 0.5, 2, 0)
    yy, xx = np.indices(a.shape)
    d = (yy - 11) ** 2 + (xx - 34) ** 2
    a[(d < 80) & (d > 20)] = 3
    a[38, 5:44] = 4
    a[36, 43] = 5
    a[2, 44:46] = 6
    return a


@pytest.mark.parametrize("seed,tile", [(0, 5), (1, 16), (2, 256)])
def test_ranked_outlines_equal_a_plain_walk(spark, make, seed, tile):
    a = regions_of(seed)
    df = make.values(a, "label").where("label > 0").withColumn("label", F.col("label").cast("bigint"))
    sc = make.scenes(a.shape)
    rings = ol.outer_rings(rg.border(df), sc, tile)
    got, short = {}, {}
    for r in rings.orderBy("label", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["label"], []))
        got[r["label"]].append((r["y"], r["x"]))
    for r in ol.simplified(rings, 0.01).orderBy("label", "rank").collect():
        short.setdefault(r["label"], []).append((int(r["y"]), int(r["x"])))
    for label in range(1, 7):
        edge = {(r["y"], r["x"]) for r in rg.border(df.where(F.col("label") == label)).collect()}
        ring = max(plain_rings.outer_contours(edge), key=plain_rings.ring_area)
        assert got.get(label, ring[:1]) == ring
        pts = np.array(ring, float)
        length = float(np.hypot(*(np.roll(pts, -1, axis=0) - pts).T).sum())
        want = plain_rings.simplify_ring(ring, 0.01 * length)
        assert short.get(label, want[:1]) == want, label
    assert 5 not in got and len(got[4]) == 76


def test_outlines_of_nothing(spark, make):
    df = make.values(np.zeros((4, 4)), "label").withColumn("label", F.col("label").cast("bigint")).limit(0)
    assert rg.polygonize(df, make.scenes((4, 4)), 1, 8).count() == 0


def test_chains_of_items():
    r = np.random.default_rng(1)
    order = r.permutation(200)
    after = np.full(200, -1)
    after[order[:79]] = order[1:80]                    # a path of 80
    after[order[80:150]] = order[81:151]               # a path that is closed below
    after[order[150]] = order[80]
    head, place = ol.chains(after)
    assert head[order[:80]].tolist() == [order[0]] * 80 and place[order[:80]].tolist() == list(range(80))
    ring = order[80:151].tolist()
    turn = ring.index(min(ring))
    ring = ring[turn:] + ring[:turn]
    assert head[ring].tolist() == [ring[0]] * 71 and place[ring].tolist() == list(range(71))
    assert head[order[151:]].tolist() == order[151:].tolist()
    assert ol.chains(np.zeros(0, int))[0].tolist() == []


def test_thin_region_and_dot_have_contours():
    assert plain_rings.outer_contours({(3, 3)}) == [[(3, 3)]]
    line = plain_rings.outer_contours({(0, 0), (0, 1), (0, 2)})[0]
    assert set(line) == {(0, 0), (0, 1), (0, 2)} and plain_rings.ring_area(line) == 0


def test_contour_ignores_holes_and_keeps_area():
    a = discs((40, 40), [(20, 20)], 12) & ~discs((40, 40), [(20, 20)], 5)
    ring = plain_rings.outer_contours(set(zip(*map(list, np.nonzero(a)))))
    assert len(ring) == 1
    # area inside the outer pixel centres of the full disc
    assert abs(plain_rings.ring_area(ring[0]) - math.pi * 12 ** 2) / (math.pi * 144) < 0.12
    assert all((y - 20) ** 2 + (x - 20) ** 2 > 100 for y, x in ring[0])


def test_simplified_ring_stays_close():
    a = discs((60, 60), [(30, 30)], 20)
    ring = plain_rings.outer_contours(set(zip(*map(list, np.nonzero(a)))))[0]
    short = plain_rings.simplify_ring(ring, 1.5)
    assert 4 <= len(short) < len(ring) / 4
    assert abs(plain_rings.ring_area(short) - plain_rings.ring_area(ring)) / plain_rings.ring_area(ring) < 0.15


def test_small_regions_are_dropped(spark, make):
    a = np.zeros((12, 12), bool)
    a[2:4, 2:4] = True
    assert rg.polygonize(labelled(make, a), make.scenes((12, 12)), 25).count() == 0


def test_boundaries_do_not_count_the_scene_edge(spark, make):
    a = np.ones((4, 5), bool)
    assert st.label_boundaries(labelled(make, a), make.scenes((4, 5))).count() == 0
    two = labelled(make, a[:, :2]).unionByName(
        labelled(make, a[:, :3], 2).withColumn("x", F.col("x") + 2))
    got = st.label_boundaries(two, make.scenes((4, 5))).collect()
    assert {(r["x"]) for r in got} == {1, 2} and len(got) == 8


def greedy(rows, t):
    def area(b):
        return (b[2] - b[0]) * (b[3] - b[1])

    kept = []
    for b in sorted(rows, key=lambda r: (-r[5], r[4])):
        for k in kept:
            w, h = min(b[2], k[2]) - max(b[0], k[0]), min(b[3], k[3]) - max(b[1], k[1])
            inter = max(0, w) * max(0, h)
            if inter / (area(b) + area(k) - inter) > t:
                break
        else:
            kept.append(b)
    return sorted(b[4] for b in kept)


@pytest.mark.parametrize("t", [0.4, 0.7, 0.9])
def test_box_nms_equals_greedy(spark, t):
    rng = np.random.default_rng(int(t * 10))
    rows = []
    for i in range(300):
        x, y = (int(v) for v in rng.integers(0, 40, 2))
        w, h = (int(v) for v in rng.integers(5, 30, 2))
        rows.append((x, y, x + w, y + h, i, float(rng.integers(0, 50))))
    rows += [(*rows[0][:4], 300 + j, float(j)) for j in range(150)]       # a hot place
    df = spark.createDataFrame([(0, *r) for r in rows], "patch_idx int, x0 int, y0 int, x1 int, y1 int, mask_id bigint, score double")
    got = sorted(r["mask_id"] for r in bx.box_nms(df, t).collect())
    assert got == greedy(rows, t)


def test_equal_mask_ids_in_several_patches(spark):
    rows = [(0, 0, 0, 10, 10, 1, 2.0), (0, 0, 0, 10, 11, 2, 1.0), (1, 50, 50, 60, 60, 2, 1.0), (None, 0, 0, 10, 10, 2, 1.0), (None, 0, 0, 10, 11, 1, 2.0)]
    df = spark.createDataFrame(rows, "patch_idx int, x0 int, y0 int, x1 int, y1 int, mask_id bigint, score double")
    got = bx.box_nms(df, 0.7)
    assert got.columns == df.columns
    assert {(r["patch_idx"], r["mask_id"]) for r in got.collect()} == {(0, 1), (1, 2), (None, 1)}


def test_long_chain_ends_in_few_rounds(spark):
    # each box is better than the next one and overlaps it
    rows = [(0, i, 0, i + 10, 10, i, float(2000 - i)) for i in range(1000)]
    df = spark.createDataFrame(rows, "patch_idx int, x0 int, y0 int, x1 int, y1 int, mask_id bigint, score double")
    rounds = []
    got = sorted(r["mask_id"] for r in bx.box_nms(df, 0.7, rounds=rounds).collect())
    assert got == greedy([r[1:] for r in rows], 0.7) and len(got) > 300
    assert len(rounds) <= 12 and rounds[-1] == 0


def test_crowded_place_equals_greedy(spark):
    # far more boxes in one place than a cell may hold in a round
    rng = np.random.default_rng(5)
    rows = []
    for i in range(3000):
        x, y, w, h = (int(v) for v in rng.integers([0, 0, 60, 800], [12, 160, 100, 1300]))
        rows.append((x, y, x + w, y + h, i, float(rng.integers(0, 40))))
    df = spark.createDataFrame([(0, *r) for r in rows], "patch_idx int, x0 int, y0 int, x1 int, y1 int, mask_id bigint, score double")
    rounds = []
    got = sorted(r["mask_id"] for r in bx.box_nms(df, 0.7, rounds=rounds).collect())
    assert got == greedy(rows, 0.7)
    assert len(rounds) <= 12


def test_work_of_a_crowded_cell_grows_with_its_rows(monkeypatch):
    import pyarrow as pa

    pairs, overlap = [], bx._overlap

    def counted(a, b, t):
        pairs.append(a.shape[1] * b.shape[1])
        return overlap(a, b, t)

    monkeypatch.setattr(bx, "_overlap", counted)

    def work(n):
        """Pairs compared for n boxes of other cells, which all overlap and stay open."""
        pairs.clear()
        i = np.arange(n)
        columns = {"cell": i * 0, "x0": i % 5, "y0": i % 7, "x1": 100 + i % 3, "y1": 100 + i % 4, "_state": i * 0, "_own": i == n - 1}
        batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})
        out = list(bx._settle(0.7, ["cell"], ["x0"])(iter([batch])))
        assert [b.column("_state").to_pylist() for b in out] == [[0]]
        return sum(pairs)

    assert work(40_000) <= work(10_000) * 4 and work(40_000) < 40_000 * 2_000


def test_blank_tiles_and_areas(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 0.0), (1, float("nan")), (2, 3.0)], "t int, v double")
    assert {r["t"] for r in mk.drop_blank_tiles(df, ["t"], ["v"]).collect()} == {1, 2}


def test_degenerate_boxes_are_kept(spark):
    rows = [(0, 0, 0, 5, 5, 1, 1.0), (0, 9, 9, 9, 20, 2, 0.5), (0, 30, 3, 40, 3, 3, 0.1), (0, 1, 0, 5, 5, 4, 0.9), (1, 7, 7, 7, 7, 5, 0.0)]
    df = spark.createDataFrame(rows, "patch_idx int, x0 int, y0 int, x1 int, y1 int, mask_id bigint, score double")
    assert sorted(r["mask_id"] for r in bx.box_nms(df, 0.7).collect()) == [1, 2, 3, 5]
    assert sorted(r["mask_id"] for r in bx.box_nms(df.where("x0 = x1"), 0.7).collect()) == [2, 5]


def test_relax_is_decided_per_scene(spark):
    calls = []
    found = {(0, 24): 6, (1, 24): 1, (1, 12): 3, (2, 24): 2, (2, 12): 2, (3, 12): 1}

    def build(some, area, dist):
        calls.append((area, dist))
        ids = [r["scene_id"] for r in some.collect()]
        return spark.createDataFrame([(s, area) for s in ids for _ in range(found.get((s, area), 0))], "scene_id bigint, area int")

    scenes = spark.createDataFrame([(i,) for i in range(4)], "scene_id bigint")
    got = rg.relax_if_few(build, scenes, 24, 10).groupBy("scene_id", "area").count().collect()
    assert {(r[0], r[1]): r[2] for r in got} == {(0, 24): 6, (1, 12): 3, (2, 24): 2, (3, 12): 1}
    assert calls == [(24, 10), (12, 5)]
