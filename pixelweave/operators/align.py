"""Pairing images with labels, and block shifts between two scenes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import geo


def align_labels(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """Pixels with the label at the same place."""
    return pixels.join(labels, ["scene_id", "y", "x"])


def crop_to_bounds(labels: DataFrame, label_scene: DataFrame, images: DataFrame) -> DataFrame:
    """Label pixels whose centre lies in each image's bounds, re-based to the
    first kept row and column. ``labels`` is one raster (y, x, ...) with the
    one-row georeference ``label_scene``; images share its projection.

    Bounds become row and column ranges once per image, so pixels are tested
    on plain integers; the images side is a scene list and the join key is a
    block about the size of an image (one small aggregate over the list), so it
    stays an equi join in which an image meets a few blocks and a block few images.
    """
    inv = geo.affine_inverse(F.col("_t"))
    im = images.withColumn("_one", F.lit(1)).join(
        F.broadcast(label_scene.select(F.col("transform").alias("_t"), F.lit(1).alias("_one"))), "_one")  # one row
    w, h, t = F.col("width"), F.col("height"), F.col("transform")
    x0, y0 = geo.map_x(t, F.lit(0), F.lit(0)), geo.map_y(t, F.lit(0), F.lit(0))
    x1, y1 = geo.map_x(t, w, h), geo.map_y(t, w, h)
    im = im.select("scene_id", inv.alias("_i"), x0.alias("_x0"), y0.alias("_y0"), x1.alias("_x1"), y1.alias("_y1"))

    def first(v):          # least pixel whose centre is at or past v
        return F.ceil(F.round(v, 6) - 0.5).cast("int")

    ca, cb = geo.map_x(F.col("_i"), F.col("_x0"), F.col("_y0")), geo.map_x(F.col("_i"), F.col("_x1"), F.col("_y1"))
    ra, rb = geo.map_y(F.col("_i"), F.col("_x0"), F.col("_y0")), geo.map_y(F.col("_i"), F.col("_x1"), F.col("_y1"))
    im = im.select(F.col("scene_id"), first(F.least(ca, cb)).alias("_c0"), (first(F.greatest(ca, cb)) - 1).alias("_c1"),
                   first(F.least(ra, rb)).alias("_r0"), (first(F.greatest(ra, rb)) - 1).alias("_r1"))
    # rows and columns before the raster do not exist
    im = im.withColumn("_r0", F.greatest("_r0", F.lit(0))).withColumn("_c0", F.greatest("_c0", F.lit(0))).where(
        (F.col("_r0") <= F.col("_r1")) & (F.col("_c0") <= F.col("_c1")))

    side = im.agg(F.avg(F.greatest(F.col("_r1") - F.col("_r0"), F.col("_c1") - F.col("_c0")) + 1)).first()[0]
    block = max(16, int(side or 16))

    def blocks(lo: str, hi: str):
        return F.explode(F.sequence(F.floor(F.col(lo) / block).cast("int"), F.floor(F.col(hi) / block).cast("int")))

    spread = im.withColumn("_by", blocks("_r0", "_r1")).withColumn("_bx", blocks("_c0", "_c1"))
    keyed = labels.withColumn("_by", F.floor(F.col("y") / block).cast("int")).withColumn(
        "_bx", F.floor(F.col("x") / block).cast("int"))
    keep = [c for c in labels.columns if c not in ("y", "x", "scene_id")]
    return keyed.drop("scene_id").join(spread, ["_by", "_bx"]).where(
        F.col("y").between(F.col("_r0"), F.col("_r1")) & F.col("x").between(F.col("_c0"), F.col("_c1"))).select(
        "scene_id", (F.col("y") - F.col("_r0")).alias("y"), (F.col("x") - F.col("_c0")).alias("x"), *keep)


def block_shift(reference: DataFrame, target: DataFrame, value: str, block: int = 200,
                max_shift: int = 40, min_pixels: int = 3) -> DataFrame:
    """Per block of the reference the offset (dx, dy) of the target that
    correlates best: target(y+dy, x+dx) against reference(y, x).

    Columns: scene_id, block_y, block_x, dx, dy, score. A block meets only target pixels
    within ``max_shift``; all offsets are scored together by Fourier products
    of values and validity, which is the correlation over common pixels. Equal
    scores take the shorter, then lower (dy, dx) offset.
    """
    m = int(max_shift)
    full = block + 2 * m
    r = reference.where(F.col(value).isNotNull()).select(
        "scene_id", F.floor(F.col("y") / block).cast("int").alias("block_y"),
        F.floor(F.col("x") / block).cast("int").alias("block_x"), "y", "x", F.col(value).cast("double").alias("v"))

    def cover(pos: str):
        return F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col(pos) - m) / block)).cast("int"),
                                    F.floor((F.col(pos) + m) / block).cast("int")))

    t = target.where(F.col(value).isNotNull()).select("scene_id", "y", "x", F.col(value).cast("double").alias("v")) \
        .withColumn("block_y", cover("y")).withColumn("block_x", cover("x"))

    def score(key, ref, tgt):
        cols = {"scene_id": [], "block_y": [], "block_x": [], "dx": [], "dy": [], "score": []}
        if not len(ref) or not len(tgt):
            return pd.DataFrame(cols)
        scene, by, bx = key
        top, left = int(by) * block - m, int(bx) * block - m
        # centred values keep the products small; correlation is unchanged
        mid, spread = ref["v"].mean(), ref["v"].std(ddof=0) or 1.0
        a, am, b, bm = (np.zeros((full, full)) for _ in range(4))
        ry, rx = ref["y"].to_numpy() - top, ref["x"].to_numpy() - left
        ty, tx = tgt["y"].to_numpy() - top, tgt["x"].to_numpy() - left
        a[ry, rx], am[ry, rx] = (ref["v"].to_numpy() - mid) / spread, 1
        b[ty, tx], bm[ty, tx] = (tgt["v"].to_numpy() - mid) / spread, 1
        shape = (full + 2 * m, full + 2 * m)

        def tf(z):
            return np.fft.rfft2(z, shape)

        fa, fa2, fam = np.conj(tf(a)), np.conj(tf(a * a)), np.conj(tf(am))
        fb, fb2, fbm = tf(b), tf(b * b), tf(bm)

        def lag(p, q):
            z = np.fft.irfft2(p * q, shape)
            return np.roll(z, (m, m), (0, 1))[:2 * m + 1, :2 * m + 1]

        n = np.rint(lag(fam, fbm))
        ok = n >= min_pixels
        n1 = np.where(ok, n, 1)
        sa, sb, sab = lag(fa, fbm), lag(fam, fb), lag(fa, fb)
        va, vb = lag(fa2, fbm) - sa * sa / n1, lag(fam, fb2) - sb * sb / n1
        good = ok & (va > 1e-9) & (vb > 1e-9)
        if not good.any():
            return pd.DataFrame(cols)
        corr = np.where(good, (sab - sa * sb / n1) / np.sqrt(np.where(good, va * vb, 1)), -2).round(9)
        dy, dx = np.meshgrid(np.arange(-m, m + 1), np.arange(-m, m + 1), indexing="ij")
        order = np.lexsort((dx.ravel(), dy.ravel(), (dx ** 2 + dy ** 2).ravel(), -corr.ravel()))
        i = order[0]
        return pd.DataFrame({"scene_id": [scene], "block_y": [by], "block_x": [bx], "dx": [int(dx.ravel()[i])],
                             "dy": [int(dy.ravel()[i])], "score": [float(corr.ravel()[i])]})

    g = ["scene_id", "block_y", "block_x"]
    return r.groupBy(*g).cogroup(t.groupBy(*g)).applyInPandas(
        score, "scene_id bigint, block_y int, block_x int, dx int, dy int, score double")


def shift_scene(pixels: DataFrame, dx: int, dy: int) -> DataFrame:
    """The scene moved by whole pixels."""
    return pixels.withColumn("y", F.col("y") + dy).withColumn("x", F.col("x") + dx)
