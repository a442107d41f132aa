import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import discs
from pixelweave.operators import components as cp, distance as ds, flood as fl, instances as ins, merge as mg, stencil as st


def brute_labels(a, conn):
    h, w = a.shape
    out = np.zeros(a.shape, int)
    steps = [(-1, 0), (1, 0), (0, -1), (0, 1)] + ([(-1, -1), (-1, 1), (1, -1), (1, 1)] if conn == 8 else [])
    for y, x in zip(*np.nonzero(a)):
        if out[y, x]:
            continue
        name, todo = y * w + x + 1, [(y, x)]
        out[y, x] = name
        while todo:
            p, q = todo.pop()
            for dy, dx in steps:
                r, s = p + dy, q + dx
                if 0 <= r < h and 0 <= s < w and a[r, s] and not out[r, s]:
                    out[r, s] = name
                    todo.append((r, s))
    return out


@pytest.mark.parametrize("conn,density,tile", [(4, 0.55, 8), (8, 0.4, 8), (8, 0.4, 64)])
def test_components_match_flood_fill(spark, make, conn, density, tile):
    a = np.random.default_rng(conn).random((45, 37)) < density
    got = cp.connected_components(make.mask(a), make.scenes(a.shape), conn, tile)
    assert np.array_equal(make.array(got, a.shape, "label"), brute_labels(a, conn))


def test_component_winding_through_many_tiles(spark, make):
    a = np.zeros((41, 40), bool)
    a[::2] = True
    a[1::4, -1] = True
    a[3::4, 0] = True
    got = cp.connected_components(make.mask(a), make.scenes(a.shape), 4, 4)
    assert [r["label"] for r in got.select("label").distinct().collect()] == [1]


def test_apart_discs(spark, make):
    a = discs((256, 256), [(16 + 32 * i, 16 + 32 * j) for i in range(8) for j in range(8)], 6)
    n = cp.connected_components(make.mask(a), make.scenes(a.shape), 8, 64).groupBy("label").count()
    assert n.count() == 64 and {r["count"] for r in n.collect()} == {113}


def test_solve_edges_path_and_hub(spark):
    path = [(0, i, i + 1) for i in range(1, 60)]
    hub = [(1, 100, i) for i in range(1, 60)]
    got = cp.solve_edges(spark.createDataFrame(path + hub, "scene_id bigint, u bigint, v bigint")).collect()
    assert {r["v"] for r in got} == {1} and len(got) == 59 + 59


def test_ring_is_filled(spark, make):
    big, small = discs((64, 64), [(32, 32)], 20), discs((64, 64), [(32, 32)], 10)
    got = cp.fill_holes(make.mask(big & ~small), make.scenes((64, 64)), 16)
    assert np.array_equal(make.array(got, (64, 64)), big)


def shifted(a, dy, dx, fill):
    h, w = a.shape
    out = np.full(a.shape, fill)
    out[max(0, dy):h + min(0, dy), max(0, dx):w + min(0, dx)] = a[max(0, -dy):h + min(0, -dy), max(0, -dx):w + min(0, -dx)]
    return out


@pytest.mark.parametrize("shape,radius", [("square", 1), ("cross", 1), ("disk", 2)])
def test_morphology_against_shifts(spark, make, shape, radius):
    a = np.random.default_rng(5).random((29, 33)) < 0.7
    sc, offs = make.scenes(a.shape), st.element(shape, radius)
    grown = np.any([shifted(a, dy, dx, False) for dy, dx in offs], axis=0)
    assert np.array_equal(make.array(st.dilate(make.mask(a), sc, shape, radius, tile=8), a.shape), grown)
    for outside in ("background", "foreground"):
        want = np.all([shifted(a, dy, dx, outside == "foreground") for dy, dx in offs], axis=0)
        got = st.erode(make.mask(a), sc, shape, radius, outside=outside, tile=8)
        assert np.array_equal(make.array(got, a.shape), want), outside


def test_opening_is_idempotent(spark, make):
    a = np.random.default_rng(6).random((40, 40)) < 0.8
    sc = make.scenes(a.shape)
    once = make.array(st.opening(make.mask(a), sc, tile=16), a.shape)
    assert once.any() and np.array_equal(make.array(st.opening(make.mask(once), sc, tile=16), a.shape), once)


def test_distance_by_brute_force(spark, make):
    a = np.random.default_rng(7).random((25, 31)) < 0.93
    got = make.array(ds.distance_transform(make.mask(a), make.scenes(a.shape)), a.shape, "d2")
    by, bx = np.nonzero(~a)
    for y, x in zip(*np.nonzero(a)):
        assert got[y, x] == ((by - y) ** 2 + (bx - x) ** 2).min()


def test_distance_without_background_is_null(spark, make):
    got = ds.distance_transform(make.mask(np.ones((5, 6), bool)), make.scenes((5, 6)))
    assert got.where(F.col("d2").isNull()).count() == 30


def test_distance_of_long_runs(spark, make):
    a = np.ones((6, 700), bool)
    a[0, 350] = a[5, 3] = False
    got = make.array(ds.distance_transform(make.mask(a), make.scenes(a.shape)), a.shape, "d2")
    yy, xx = np.indices(a.shape)
    want = np.min([(yy - y) ** 2 + (xx - x) ** 2 for y, x in zip(*np.nonzero(~a))], axis=0)
    assert np.array_equal(got[a], want[a])


def test_envelope_against_all_pairs():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 65, 300):
        for share in (0.0, 0.1, 1.0):
            g = np.where(rng.random(n) < share, rng.integers(0, n * n // 3 + 2, n), ds._FAR)
            i = np.arange(n)
            want = (g[None] + (i[:, None] - i[None]) ** 2).min(1)
            assert (ds._envelope(g) == np.where((g < ds._FAR).any(), want, g)).all(), (n, share)


def test_distance_of_a_full_wide_row(spark, make):
    n = 100_000
    row = spark.range(1, n).select(F.lit(0).cast("bigint").alias("scene_id"), F.lit(0).alias("y"), F.col("id").cast("int").alias("x"))
    got = ds.distance_transform(row, make.scenes((1, n))).agg(F.count("*"), F.max("d2"), F.min("d2")).first()
    assert tuple(got) == (n - 1, (n - 1) ** 2, 1)


def greedy_peaks(v, r):
    h, w = v.shape
    cand = [(y, x) for y in range(r, h - r) for x in range(r, w - r) if v[y, x] > 0 and v[y, x] == v[y - r:y + r + 1, x - r:x + r + 1].max()]
    kept = []
    for y, x in sorted(cand, key=lambda c: (-v[c], c)):
        if all(max(abs(y - a), abs(x - b)) > r for a, b in kept):
            kept.append((y, x))
    return sorted(kept)


def test_peaks_on_plateaus_and_fractions(spark, make):
    rng = np.random.default_rng(3)
    ridge = np.zeros((12, 80))
    ridge[6, 10:60] = 0.5
    for v, r in ((ridge, 3), (np.full((30, 41), 2.5), 2), (rng.integers(0, 3, (30, 40)) / 2, 2), (rng.random((20, 20)) + 1, 3)):
        got = st.local_peaks(make.values(v), make.scenes(v.shape), r, value="v", tile=8)
        assert sorted((p["y"], p["x"]) for p in got.collect()) == greedy_peaks(v, r)


def test_touching_discs_split_in_two(spark, make):
    centres = [(20 + 40 * i, 20 + 50 * j + s) for i in range(3) for j in range(2) for s in (0, 12)]
    a = discs((128, 128), centres, 8)
    sc = make.scenes(a.shape)
    parts = cp.connected_components(make.mask(a), sc, 8, 32)
    assert parts.select("label").distinct().count() == 6
    got = ins.split_instances(make.mask(a), sc, 5, 32)
    lab = make.array(got, a.shape, "label")
    assert np.array_equal(lab > 0, a)
    assert sorted(np.unique(lab[a])) == list(range(1, 13))
    for y, x in centres:      # the two halves of a pair differ
        assert len({lab[c] for c in centres}) == 12


def test_watershed_is_the_flood_of_unique_heights(spark, make):
    rng = np.random.default_rng(8)
    shape = (14, 15)
    h = rng.permutation(shape[0] * shape[1]).reshape(shape) + 1
    marks = {(2, 3): 1, (10, 4): 2, (6, 12): 3}
    hd = make.values(h, "d2").withColumn("d2", F.col("d2").cast("bigint"))
    m = spark.createDataFrame([(0, y, x, n) for (y, x), n in marks.items()], "scene_id bigint, y int, x int, label bigint")
    lab = make.array(ins.marker_watershed(hd, m, make.scenes(shape)), shape, "label")
    # Prim from all markers; an edge weighs as its lower, then its higher height
    import heapq

    want, heap = np.zeros(shape, int), []
    for (y, x), n in marks.items():
        heapq.heappush(heap, (-10 ** 9, 0, y, x, n))
    while heap:
        _, _, y, x, n = heapq.heappop(heap)
        if want[y, x]:
            continue
        want[y, x] = n
        for dy, dx in st.CROSS:
            p, q = y + dy, x + dx
            if 0 <= p < shape[0] and 0 <= q < shape[1] and not want[p, q]:
                heapq.heappush(heap, (-min(h[y, x], h[p, q]), -max(h[y, x], h[p, q]), p, q, n))
    assert np.array_equal(lab, want)


def plain_flood(h, marks):
    """Priority queue with first in, first out among equal heights; NaN lies outside."""
    import heapq

    lab, heap, age = np.zeros(h.shape, int), [], 0
    for (y, x), n in sorted(marks.items()):
        lab[y, x] = n
        heapq.heappush(heap, (-h[y, x], 0, y, x))
    while heap:
        _, _, y, x = heapq.heappop(heap)
        for p, q in ((y - 1, x), (y, x - 1), (y, x + 1), (y + 1, x)):
            if 0 <= p < h.shape[0] and 0 <= q < h.shape[1] and not lab[p, q] and not np.isnan(h[p, q]):
                age += 1
                lab[p, q] = lab[y, x]
                heapq.heappush(heap, (-h[p, q], age, p, q))
    return lab


def test_flood_in_queue_order_with_plateaus(spark, make):
    rng = np.random.default_rng(12)
    shape = (40, 41)
    rows, marks, hs = [], {}, {}
    for scene, levels in enumerate((1, 2, 4, 9)):
        h = rng.integers(1, levels + 1, shape).astype(float)
        h[rng.random(shape) < 0.25] = np.nan
        h[20, :] = np.nan if scene == 3 else h[20, :]
        free = np.argwhere(~np.isnan(h))
        marks[scene] = {tuple(map(int, c)): n + 1 for n, c in enumerate(free[rng.choice(len(free), 9, False)])}
        hs[scene] = h
        rows += [(scene, y, x, n) for (y, x), n in marks[scene].items()]
    hd = make.values(hs[0], "d2", 0)
    for scene in (1, 2, 3):
        hd = hd.unionByName(make.values(hs[scene], "d2", scene))
    m = spark.createDataFrame(rows, "scene_id bigint, y int, x int, label bigint")
    got = fl.queue_watershed(hd, m, make.scenes(*[shape] * 4), tile=16).collect()
    for scene, h in hs.items():
        lab = np.zeros(shape, int)
        for r in got:
            if r["scene_id"] == scene:
                lab[r["y"], r["x"]] = r["label"]
        assert np.array_equal(lab, plain_flood(h, marks[scene])), scene
    none = fl.queue_watershed(hd, m.limit(0), make.scenes(*[shape] * 4), tile=16)
    assert none.isEmpty()


def test_flood_of_large_parts_equals_the_queue(spark, make):
    rng = np.random.default_rng(4)
    h = rng.integers(1, 4, (5, 6)).astype(float)
    h[2, :2] = np.nan
    marks = {(0, 0): 5, (1, 5): 2, (4, 4): 9}
    m = spark.createDataFrame([(0, y, x, n) for (y, x), n in marks.items()], "scene_id bigint, y int, x int, label bigint")
    got = fl.queue_watershed(make.values(h, "d2"), m, make.scenes(h.shape), max_pixels=1, tile=4)
    assert np.array_equal(make.array(got, h.shape, "label"), plain_flood(h, marks))


def test_split_pixels_equal_a_plain_flood(spark, make):
    a = discs((48, 48), [(14, 14), (14, 25), (30, 30), (37, 38)], 8)
    d2 = make.array(ds.distance_transform(make.mask(a), make.scenes(a.shape)), a.shape, "d2")
    marks = {p: n + 1 for n, p in enumerate(greedy_peaks(np.where(a, d2, 0), 5))}
    want = plain_flood(np.where(a, d2, np.nan), marks)
    got = ins.split_instances(make.mask(a), make.scenes(a.shape), 5, 16)
    assert np.array_equal(make.array(got, a.shape, "label"), want)


def test_paint_first_come(spark):
    masks = spark.createDataFrame([(0, 7, 100)], "patch_idx int, mask_id bigint, area bigint")
    px = spark.createDataFrame([(7, y, x) for y in range(10, 20) for x in range(10, 20)], "mask_id bigint, y int, x int")
    got = mg.paint_labels(masks, px)
    assert got.count() == 100 and got.select("label").distinct().collect()[0][0] == 1


def test_paint_equals_sequential_painting(spark):
    rng = np.random.default_rng(9)
    canvas, nxt, rows, px = np.zeros((40, 40), int), 1, [], []
    todo = []
    for i in range(60):
        y, x, s = rng.integers(0, 34), rng.integers(0, 34), rng.integers(1, 7)
        a = np.zeros((40, 40), bool)
        a[y:y + s, x:x + s] = True
        todo.append((int(rng.integers(0, 4)), int(a.sum()), i, a))
        rows.append((todo[-1][0], i, int(a.sum())))
        px += [(i, int(p), int(q)) for p, q in zip(*np.nonzero(a))]
    for _, _, _, a in sorted(todo, key=lambda t: t[:3]):
        free = a & (canvas == 0)
        if free.any():
            canvas[free] = nxt
            nxt += 1
    got = mg.paint_labels(spark.createDataFrame(rows, "patch_idx int, mask_id bigint, area bigint"),
                          spark.createDataFrame(px, "mask_id bigint, y int, x int"))
    lab = np.zeros((40, 40), int)
    for r in got.collect():
        lab[r["y"], r["x"]] = r["label"]
    assert np.array_equal(lab, canvas)
