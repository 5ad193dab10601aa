"""Image operators: dense against long form, brute force, recovery of simulated truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Panel
from lumenframe.operators import blobs, calibrate, dense, noise, stencil
from lumenframe.operators.components import connected_components
from lumenframe.sources.frames import simulate_frames
from lumenframe.streaming.online import fold


def long_of(spark, stack):
    rows = [(f, r, c, float(stack[f, r, c])) for f in range(stack.shape[0]) for r in range(stack.shape[1]) for c in range(stack.shape[2])]
    return spark.createDataFrame(rows, "frame_index long, row int, col int, adu double")


def image(df, value, shape):
    p = df.toPandas()
    out = np.full(shape, np.nan)
    out[p.frame_index, p.row, p.col] = p[value]
    return out


@pytest.fixture(scope="module")
def stack():
    return np.random.default_rng(0).normal(100, 10, (6, 12, 15))


def test_long_and_dense_stencils_agree(spark, stack):
    px = long_of(spark, stack)
    assert np.allclose(image(stencil.box_sum(px, {"s": F.col("adu")}, 3), "s", stack.shape), stencil.shift_sum(stack, 3))
    assert np.allclose(image(stencil.gaussian_mean(px, "adu", 5, 1.0, 12, 15), "smooth", stack.shape), stencil.correlate_dense(stack, stencil.gaussian(5, 1.0), "reflect"))
    z = px.withColumn("z", (F.col("adu") - 100) / 10)
    assert np.allclose(image(stencil.matched_filter(z, "z", [0.6, 1.0], 12, 15), "t", stack.shape), stencil.matched_dense((stack - 100) / 10, np.ones_like(stack), [0.6, 1.0]))
    assert np.allclose(image(stencil.box_max(px, {"m": F.col("adu")}, 2), "m", stack.shape), stencil.dilate(stack, 2))
    x = px.withColumn("x", F.col("adu") - 100).withColumn("var", F.lit(100.0))
    a = stencil.annulus_background(x, inner=1, outer=3)
    for f in range(2):
        mean, var = stencil.annulus_dense(stack[f] - 100, np.full((12, 15), 100.0), np.ones((12, 15), bool), 1, 3)
        assert np.allclose(image(a, "local_mean", stack.shape)[f], mean) and np.allclose(image(a, "local_var", stack.shape)[f], var)


def test_box_sum_by_brute_force(stack):
    got = stencil.shift_sum(stack[0], 2)
    for r, c in ((0, 0), (5, 7), (11, 14), (1, 13)):
        assert got[r, c] == pytest.approx(stack[0][max(0, r - 2) : r + 3, max(0, c - 2) : c + 3].sum())
    with pytest.raises(ValueError):
        stencil.gaussian(4, 1.0)


def test_components_and_blobs_agree(spark):
    rng = np.random.default_rng(1)
    masks = rng.random((4, 20, 20)) < 0.35
    excess = rng.normal(5, 3, masks.shape)
    rows = [(int(f), int(r), int(c), float(excess[f, r, c]), 4.0, float(excess[f, r, c] / 2), 0.1, 0.5) for f, r, c in zip(*np.nonzero(masks), strict=True)]
    fg = spark.createDataFrame(rows, "frame_index long, row int, col int, excess double, var double, z double, log_bf double, posterior double")
    for connectivity in (1, 2):
        lab = blobs.label_components(fg, 20, connectivity).toPandas()
        got = np.zeros(masks.shape, int)
        got[lab.frame_index, lab.row, lab.col] = lab.label
        assert all((got[f] == blobs.label_array(masks[f], connectivity)).all() for f in range(4))
    long = blobs.blob_stats(blobs.label_components(fg, 20)).toPandas().sort_values(["frame_index", "label"]).reset_index(drop=True)
    ones = np.ones((20, 20))
    want = [blobs.array_blobs(blobs.label_array(masks[f]), excess[f], ones * 4, excess[f] / 2, ones * 0.1, ones * 0.5).assign(frame_index=f) for f in range(4)]
    import pandas as pd

    want = pd.concat(want).reset_index(drop=True)
    for c in want.columns:
        assert np.allclose(long[c].to_numpy(float), want[c].to_numpy(float), equal_nan=True), c
    assert blobs.label_components(fg.limit(0), 20).count() == 0


def test_long_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)], "a long, b long")
    got = connected_components(edges).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, 201), (500, 2)]


def test_robust_fold_resists_spots(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(100, 3, 60)
    x[[10, 25, 40]] = 50000
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)] + [(1, 99, None)], "pix int, f int, v double")
    r = noise.robust_fold(df, "pix", ["f"], "v").first()
    assert r["n"] == 60 and r["clipped"] >= 3 and abs(r["mean"] - 100) < 3 and r["var"] < 60
    n, mean, m2, clipped = fold(0, 0.0, 0.0, 0, x)
    assert (n, clipped) == (60, r["clipped"]) and mean == pytest.approx(r["mean"]) and m2 / 59 == pytest.approx(r["var"])
    half = fold(*fold(0, 0.0, 0.0, 0, x[:30]), x[30:])
    assert half[1] == pytest.approx(mean)
    with pytest.raises(ValueError):
        noise.ewma_fold(df, "pix", ["f"], "v", decay=1.0)


def test_statistics_recover_the_truth(spark):
    px = noise.pixels_of(simulate_frames(spark, 64, 16, 16, seed=3), width=16)
    s = noise.pixel_stats(px).toPandas()
    assert abs(s["mean"].mean() - 100) < 0.5 and abs(s["var"].mean() - 100) < 5
    ring = noise.radial_stats(px, 16, 16).toPandas()
    assert (abs(ring["var"] / 100 - 1) < 0.9).all() and ring["pixels"].sum() == 256
    tiles = noise.panel_stats(px, [Panel("a", 0, 7, 0, 15), Panel("b", 8, 15, 0, 15)]).toPandas()
    assert sorted(tiles["panel"]) == ["a", "b"] and (tiles["pixels"] == 128).all()


def test_em_and_null(spark):
    rng = np.random.default_rng(5)
    z = np.concatenate([rng.normal(0, 1, 9500), rng.normal(0, 8, 500)])
    pi, kappa = calibrate.em_mixture(spark.createDataFrame([(float(v),) for v in z], "z double"), iterations=40)
    assert 0.03 < pi < 0.08 and 5 < kappa < 11
    null = calibrate.empirical_null(spark.createDataFrame([(float(v),) for v in z], "t double")).first()
    assert abs(null["mu0"]) < 0.1 and 0.9 < null["sigma0"] < 2.2
    assert calibrate.lower_median_of(spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "x double"), "x").first()[0] == 2.0
    w = calibrate.simplex()
    assert len(w) == 66 and all(sum(x) == pytest.approx(1) for x in w)


def test_photon_transfer_recovers_the_gain(spark):
    rng = np.random.default_rng(6)
    level = rng.uniform(20, 400, 15000)
    df = spark.createDataFrame([(float(m), float(9 + 2 * m + rng.normal(0, 10))) for m in level], "mean double, var double")
    r = calibrate.photon_transfer(df).first()
    assert 1.8 < r["gain"] < 2.2 and 0 <= r["read_var"] < 25 and r["bins"] == 24


def test_planted_spots_are_found(spark):
    spots = [(f, float(r), float(c), 900.0) for f in (3, 5) for r, c in ((12, 14), (30, 40), (45.3, 20.6), (50, 50))]
    df = simulate_frames(spark, 8, 64, 64, spark.createDataFrame(spots, "frame_index long, row double, col double, intensity double"), seed=9)
    bg = dense.Background(np.full((64, 64), 100.0), np.full((64, 64), 100.0), np.ones((64, 64), bool))
    got = dense.find_peaks(df, bg, dense.FinderRule(threshold=7.0, scales=(1.0,), size_max=60)).toPandas()
    for f, r, c, i in spots:
        near = got[(got.frame_index == f) & (np.hypot(got.row - r, got.col - c) < 1)]
        assert len(near) == 1 and abs(near.intensity.iloc[0] / i - 1) < 0.4
    assert len(got) <= len(spots) + 3
    with pytest.raises(ValueError):
        dense.FinderRule(inner=9, outer=4)
    assert math.isfinite(got["eccentricity"].max())
