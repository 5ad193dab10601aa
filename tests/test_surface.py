"""Scans, masks, streams, statistics and functions for users of SQL."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import sql
from lumenframe.functions.geometry import Panel
from lumenframe.functions.scoring import poisson_tail
from lumenframe.operators import blobs, calibrate, dense, noise
from lumenframe.plans.pipeline import Pipeline
from lumenframe.sinks import tables, text
from lumenframe.sources import frames as src
from lumenframe.sources.geom import MaskRule, parse_geometry


def test_scan_leaves_out_what_cannot_be_read(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    def put(name, n, h, w):
        cols = {"frame_index": pa.array(range(n), pa.int64()), "filename": ["f"] * n, "event": pa.array(range(n), pa.int64()), "h": pa.array([h] * n, pa.int32()), "w": pa.array([w] * n, pa.int32()), "pixels": pa.array([[0.0] * (h * w)] * n, pa.list_(pa.float32()))}
        pq.write_table(pa.table(cols), tmp_path / name)
        return str(tmp_path / name)

    good, other = put("a.parquet", 3, 4, 5), put("b.parquet", 2, 5, 5)
    (tmp_path / "c.parquet").write_text("not a table")
    pq.write_table(pa.table({"x": [1]}), tmp_path / "d.parquet")
    paths = [good, other, str(tmp_path / "c.parquet"), str(tmp_path / "d.parquet"), str(tmp_path / "none.parquet")]
    got = src.scan_files(spark, paths)
    rows = {r["pos"]: r for r in got.collect()}
    assert [rows[k]["n_frames"] for k in range(5)] == [3, 0, 0, 0, 0]
    assert rows[0]["problem"] is None and "5 x 5" in rows[1]["problem"] and "no column" in rows[3]["problem"] and rows[4]["problem"]
    with pytest.warns(UserWarning):
        assert src.usable_files(got) == [good]
    assert src.scan_files(spark, paths, 5, 5).where("problem IS NULL").first()["filename"] == other


def test_masks_and_placement(spark, tmp_path):
    flat = str(tmp_path / "flat")
    spark.createDataFrame([(0, 0, 0), (0, 1, 5), (1, 0, 4), (1, 1, None)], "row int, col int, word long").write.parquet(flat)
    mask = lambda p, rule, panels=(): {(r["row"], r["col"]): r["valid"] for r in src.read_mask(spark, p, rule, panels).collect()}
    assert mask(flat, MaskRule()) == {(0, 0): True, (0, 1): False, (1, 0): False, (1, 1): False}
    assert mask(flat, MaskRule(good=4, bad=1)) == {(0, 0): False, (0, 1): False, (1, 0): True, (1, 1): False}
    slabs = str(tmp_path / "slabs")
    spark.createDataFrame([("b", 0, 0, 0), ("a", 0, 0, 1)], "panel string, ss int, fs int, word long").write.parquet(slabs)
    panels = [Panel("a", 0, 0, 0, 0), Panel("b", 1, 1, 0, 0)]
    assert mask(slabs, MaskRule(), panels) == {(0, 1): True, (0, 0): False}
    src.check_placement(panels, 1, 2)
    for wrong in ([Panel("a", 0, 2, 0, 0)], [Panel("a", 0, 1, 0, 0), Panel("b", 1, 1, 0, 0)], [Panel("a", 1, 0, 0, 0)]):
        with pytest.raises(ValueError):
            src.check_placement(wrong, 1, 2)


def test_streams_are_merged(spark, tmp_path):
    chunk = lambda n, what: f"----- Begin chunk -----\nImage serial number: {n}\n{what}\n----- End chunk -----"
    head = text.header("test", None)
    (tmp_path / "a.stream").write_text(head + "\n" + chunk(1, "first") + "\n" + chunk(2, "second") + "\n")
    (tmp_path / "b.stream").write_text("")
    text.write_stream(spark.createDataFrame([(1, chunk(1, "third"))], "serial long, chunk string"), head, str(tmp_path / "c.stream"))
    parts = [str(tmp_path / f"{x}.stream") for x in "abcd"]
    out = str(tmp_path / "all")
    assert text.merge_streams(spark, parts, out) == 3
    got = "\n".join(p.read_text().rstrip("\n") for p in sorted((tmp_path / "all").glob("part-*")) if p.stat().st_size)
    assert got == "\n".join([head, chunk(1, "first"), chunk(2, "second"), chunk(3, "third")])
    assert text.merge_streams(spark, parts[1:2], out) == 0


def test_statistics_add_up(spark, tmp_path):
    for k in range(3):
        tables.write_stats(spark, {"frames": 10 + k, "hits": k}, str(tmp_path / f"s{k}"))
    got = tables.merge_stats(spark, [str(tmp_path / f"s{k}") for k in range(4)])
    assert got == {"frames": 33, "hits": 3, "indexed": 0, "peaks": 0, "reflections": 0}
    assert tables.merge_stats(spark, []) == dict.fromkeys(tables.STATS, 0)


def test_a_failed_write_keeps_the_former_tables(spark, tmp_path):
    out = str(tmp_path / "out")
    panels = lambda n: spark.createDataFrame([(f"p{n}", 0, 1, 0, 1)], tables.SCHEMAS["panels"])
    tables.write_tables({"panels": panels(1)}, out)
    broken = spark.createDataFrame([], tables.SCHEMAS["frames"]).unionByName(spark.range(1).selectExpr("raise_error('no') AS frame_id"), allowMissingColumns=True)
    with pytest.raises(Exception):  # noqa: B017
        tables.write_tables({"panels": panels(2), "frames": broken}, out)
    assert spark.read.parquet(f"{out}/panels.parquet").first()["name"] == "p1"
    tables.write_tables({"panels": panels(3)}, out)
    assert [r["name"] for r in spark.read.parquet(f"{out}/panels.parquet").collect()] == ["p3"]


def test_observed_peaks_stand_in(spark):
    refl = spark.createDataFrame([(1, 7, 1, 0, 0, 5.0, 1.0, 9.0, 2.0)], "frame_index long, refl long, h int, k int, l int, intensity double, sigma double, peak double, background double")
    seen = spark.createDataFrame([(1, 2, 0, 0, 4.0, 1.0), (2, 3, 0, 0, 6.0, 2.0)], "frame_index long, h int, k int, l int, intensity double, sigma double")
    got = sorted((r["frame_index"], r["h"], r["intensity"], r["peak"], r["background"]) for r in tables.with_observed(refl, seen).collect())
    assert got == [(1, 1, 5.0, 9.0, 2.0), (2, 3, 6.0, 0.0, 0.0)]


def test_functions_for_sql(spark):
    names = sql.register(spark)
    assert {"frame_id", "predict_hkl", "reduce_cell", "poisson_sf"} <= set(names)
    r = spark.sql("SELECT frame_id('run.h5', 3) AS id, excitation(0D, 0D, 0D, 1.3D) AS e, poisson_sf(2, 1.5D) AS p, poisson_sf(NULL, 1D) AS n, cell_volume(2D, 3D, 4D, 90D, 90D, 90D) AS v, reduce_cell(array(0.1D, 0D, 0D, 0D, 0.05D, 0D, 0D, 0D, 0.025D)) AS c").first()
    assert len(r["id"]) == 16 and r["e"] == 0 and r["p"] == pytest.approx(1 - 2.5 * math.exp(-1.5)) and r["n"] is None and r["v"] == pytest.approx(24)
    assert sorted(r["c"][x] for x in "abc") == pytest.approx([10, 20, 40])
    hkl = spark.sql("SELECT * FROM predict_hkl(array(0.05D, 0D, 0D, 0D, 0.04D, 0D, 0D, 0D, 0.03D), 0.3D, 1.3D, 0.005D)").toPandas()
    g = np.stack([x.ravel() for x in np.mgrid[-8:9, -8:9, -11:12]], axis=1)
    q = g * [0.05, 0.04, 0.03]
    s = 1.3 * q + [0, 0, 1]
    ok = (np.linalg.norm(q, axis=1) <= 0.3) & (g != 0).any(axis=1) & (np.abs(np.linalg.norm(s, axis=1) - 1) < 0.005)
    assert {tuple(x) for x in hkl.to_numpy().tolist()} == {tuple(x) for x in g[ok].tolist()}
    assert spark.sql("SELECT * FROM predict_hkl(NULL, 0.3D, 1.3D, 0.005D)").count() == 0


def test_small_chances_are_told_apart(spark):
    rows = [(k, m) for k in (0, 1, 3, 10, 40, 200) for m in (0.5, 3.0, 50.0, 180.0)] + [(None, 1.0), (5, None)]
    got = {(r["k"], r["m"]): r["p"] for r in spark.createDataFrame(rows, "k int, m double").select("k", "m", poisson_tail(F.col("k"), F.col("m")).alias("p")).collect()}
    for k, m in rows:
        if k is None or m is None:
            assert got[k, m] is None
            continue
        want = sum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k, k + 600)) if k > m else 1 - sum(math.exp(i * math.log(m) - m - math.lgamma(i + 1)) for i in range(k))
        assert got[k, m] == pytest.approx(want, rel=1e-9, abs=1e-300)
    assert 0 < got[40, 0.5] < got[10, 0.5] < 1e-9 and got[40, 0.5] < 1e-50


def test_scales_in_the_kernel_are_those_of_the_long_form(spark):
    rng = np.random.default_rng(2)
    mean, var = rng.uniform(50, 150, (6, 7)), rng.uniform(1, 4, (6, 7))
    valid = rng.random((6, 7)) < 0.9
    stack = [(k, (0.96 + 0.02 * k) * mean + k + rng.normal(0, 1, (6, 7))) for k in range(3)]
    stack[0][1][2, 2] = 1e6
    df = spark.createDataFrame([(k, x.ravel().tolist()) for k, x in stack] + [(9, None), (10, [1.0])], "frame_index long, pixels array<double>")
    got = dense.frame_scales(df, dense.Background(mean, var, valid)).toPandas().set_index("frame_index")
    long = [(k, float(mean[r, c]), float(x[r, c]), float(var[r, c])) for k, x in stack for r in range(6) for c in range(7) if valid[r, c]]
    want = calibrate.weighted_scale(spark.createDataFrame(long, "frame_index long, t double, y double, var double"), "frame_index", "t", "y", "var").toPandas().set_index("frame_index")
    assert set(got.index) == {0, 1, 2} and np.allclose(got.loc[want.index, ["scale", "sigma", "offset"]], want[["scale", "sigma", "offset"]])


def test_labels_of_rows_are_those_of_images():
    rng = np.random.default_rng(4)
    stack = rng.random((5, 9, 11)) < 0.45
    f, r, c = np.nonzero(stack)
    for connectivity in (1, 2):
        got = blobs.label_rows(f, r, c, connectivity)
        assert (got == np.concatenate([blobs.label_array(x, connectivity)[x] for x in stack])).all()


GEOMETRY = """clen = 0.1
wavelength = 1.3 A
photon_energy = 9537.2
res = 13333.3
west/min_fs = 0
west/max_fs = 15
west/min_ss = 0
west/max_ss = 23
west/corner_x = -16
west/corner_y = -12
west/fs = +1.0x
west/ss = +1.0y
east/min_fs = 16
east/max_fs = 31
east/min_ss = 0
east/max_ss = 23
east/corner_x = 0
east/corner_y = -12
east/fs = +1.0x
east/ss = +1.0y
"""


def test_panels_and_spots_of_the_seed_do_not_mix(spark):
    """Two panels of different level, and a strong spot in one seed frame: neither leaks into the background."""
    rng = np.random.default_rng(11)
    level = np.where(np.arange(32)[None, :] < 16, 100.0, 300.0) * np.ones((24, 1))
    stack = level + rng.normal(0, 5, (34, 24, 32))
    stack[20, 6:9, 6:9] += 25
    stack[20, 7, 7] += 60
    rows = [(k, "run", k, 24, 32, x.astype(np.float32).ravel().tolist()) for k, x in enumerate(stack)]
    frames = spark.createDataFrame(rows, src.FRAME_SCHEMA)
    run = Pipeline(frames, parse_geometry(GEOMETRY), 24, 32)
    learned = run.calibrate(eigen_modes=2)
    bg = learned.background
    assert np.abs(bg.mean - level)[bg.valid].max() < 8
    assert bg.modes.shape == (2, 24, 32) and np.allclose([np.linalg.norm(m) for m in bg.modes], 1, atol=1e-6)
    assert abs(bg.mean[7, 7] - 100) < 8 and bg.var[7, 7] < 100
    scale = run.scales().toPandas()
    assert len(scale) == 34 and np.allclose(scale["scale"], 1, atol=0.05)


def test_clipped_values_are_those_that_are_learned(spark):
    rng = np.random.default_rng(3)
    rows = [(k, t, float(x)) for k in range(3) for t, x in enumerate(rng.normal(10, 1, 30))]
    rows[12] = (0, 12, 500.0)
    df = spark.createDataFrame(rows, "pix int, t int, x double")
    clipped = noise.clipped_values(df, "pix", ["t"], "x")
    want = noise.robust_fold(df, "pix", ["t"], "x").toPandas().set_index("pix")
    got = clipped.groupBy("pix").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var")).toPandas().set_index("pix")
    assert np.allclose(got.loc[want.index, "mean"], want["mean"]) and np.allclose(got.loc[want.index, "var"], want["var"])
    assert clipped.where("pix = 0 AND t = 12").first()["x"] < 30
