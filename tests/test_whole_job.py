"""Registered queries over small tables of their own: nothing of the job is left out."""

import inspect
import math

import numpy as np
import pytest

from lumenframe.functions import lattice
from lumenframe.functions.geometry import q_max
from lumenframe.operators import indexing
from lumenframe.operators.orphans import Entity, ForeignKey, find_orphans
from lumenframe.plans import crystal, detector, kernels

CELL = lattice.Cell(21.0, 27.0, 33.0, math.radians(90), math.radians(105), math.radians(90))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """Two crystals on a detector whose panels reach row and column 2075."""
    d = str(tmp_path_factory.mktemp("run"))
    mats = {f: indexing.rotations(np.array(w)) @ lattice.basis(CELL) for f, w in ((3, (0.3, -0.5, 0.9)), (4, (-0.7, 0.2, 0.4)))}
    names = [f"{v}_{x}" for v in ("astar", "bstar", "cstar") for x in "xyz"]
    rows = [(f, True, *[float(10 * m[r, c]) for c in range(3) for r in range(3)], 21.0, 27.0, 33.0, 90.0, 105.0, 90.0) for f, m in mats.items()]
    cell = [f"cell_{x}_a" for x in "abc"] + [f"cell_{x}_deg" for x in ("alpha", "beta", "gamma")]
    spark.createDataFrame(rows, "frame_index long, indexed boolean, " + ", ".join(f"{n} double" for n in names + cell)).write.parquet(f"{d}/frames.parquet")
    spark.createDataFrame([("a", 0, 2075, 0, 1023), ("b", 0, 2075, 1028, 2075)], "name string, min_fs int, max_fs int, min_ss int, max_ss int").write.parquet(f"{d}/panels.parquet")
    return d, mats


def brute(a, top):
    """Every triple of the box: its indices, and which are reflections on the detector."""
    n = np.maximum(np.ceil(top * np.linalg.norm(np.linalg.inv(a), axis=1)), 1).astype(int)
    hkl = np.stack([g.ravel() for g in np.mgrid[tuple(slice(-k, k + 1) for k in n)]], axis=1)
    hkl = hkl[(hkl != 0).any(axis=1)]
    q = hkl @ a.T
    qn, s = np.linalg.norm(q, axis=1), 1.3 * q + [0, 0, 1]
    exc = np.linalg.norm(s, axis=1) - 1
    sz = np.where(s[:, 2] > 0, s[:, 2], np.nan)
    row, col = 512 + s[:, 1] / sz * 0.1 / 75e-6, 1040 + s[:, 0] / sz * 0.1 / 75e-6
    ok = (qn <= top) & (np.abs(exc) < np.maximum(1.95 * (5e-5 + 0.0015 * qn), 5e-4)) & (row >= 0) & (row <= 2075) & (col >= 0) & (col <= 2079)
    return hkl, ok, qn, exc, row


def test_prediction_reaches_the_detectors_edge(spark, run):
    d, mats = run
    top = q_max(crystal.DET, 2076, 2080)
    shell = crystal.ewald_shell(spark, d).toPandas()
    radius = crystal.rocking(spark, d).toPandas()
    mosaic = crystal.mosaicity(spark, d).toPandas().set_index("frame_index")["mosaicity"]
    grid = crystal.hkl_enumerate(spark, d).toPandas().set_index("frame_index")
    for f, a in mats.items():
        hkl, ok, qn, exc, row = brute(a, top)
        want = {tuple(x) for x in hkl[ok].tolist()}
        for got in (shell, radius):
            got = got[got.frame_index == f]
            assert len(got) == len(want) and {tuple(x) for x in got[["h", "k", "l"]].to_numpy().tolist()} == want
        assert qn[ok].max() > 0.5 and row[ok].max() > 1023
        slope = 2 * math.sqrt(math.pi / 2) * (qn[ok] * np.abs(exc[ok]) / 1.3).sum() / (qn[ok] ** 2).sum()
        assert mosaic[f] == pytest.approx(min(max(slope, math.radians(0.02)), math.radians(0.8)), abs=1e-7)
        assert grid.loc[f].tolist() == [len(hkl), *hkl.max(axis=0).tolist()]


def leaving(df, kernel="MapInArrow"):
    """Columns that leave the kernel of a plan, and the plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    line = next(x for x in plan.splitlines() if kernel in x)
    return [c.split("#")[0] for c in line[line.index("[") + 1 : line.index("]")].split(", ")], plan


def test_mosaicity_moves_only_what_it_sums(spark, run):
    names, plan = leaving(crystal.mosaicity(spark, run[0]))
    assert names == ["frame_index", "qn", "excitation"] and "Generate" not in plan


def test_rocking_moves_one_number_and_rounds_as_sql(spark, run):
    d, mats = run
    df = crystal.rocking(spark, d)
    names, plan = leaving(df)
    assert names == ["frame_index", "h", "k", "l", "qn"] and "Generate" not in plan and "round(" not in plan
    for r in df.collect():
        q = float(np.linalg.norm(mats[r.frame_index] @ [r.h, r.k, r.l]))
        assert r.radius == pytest.approx(5e-5 + 0.0015 * q + 0.0013 * q * q, abs=5.1e-10) and r.radius == round(r.radius, 9)


def test_predicted_reflections_are_indexed_where_they_are_predicted(spark, run):
    """Between the kernel that predicts and the one that indexes there is no shuffle."""
    d, mats = run
    plan = kernels.seed_refine(spark, d)._jdf.queryExecution().executedPlan().toString()
    last = plan.rindex("MapInArrow")
    assert plan.count("MapInArrow") == 2 and "Exchange" not in plan[plan.index("MapInArrow") : last] and "FlatMapGroupsInPandas" not in plan


@pytest.fixture(scope="module")
def peaks(spark, tmp_path_factory):
    """Peaks all over the detector, in a half pixel around it and between the panels of the tilted one."""
    d = str(tmp_path_factory.mktemp("peaks"))
    rng = np.random.default_rng(5)
    at = [(0.2, 0.4), (999.0, 5.0), (1000.0, 1050.0), (2075.0, 2075.0), (1500.0, 30.5), (-0.3, 10.0), (1600.0, 1039.7), (1600.0, 1039.2), (5.0, 1035.0)]
    at += rng.uniform(0, 2075, (40, 2)).tolist()
    rows = [(k, 7 if k < 35 else 8, float(r), float(c), float(100 - k // 2)) for k, (r, c) in enumerate(at)]
    spark.createDataFrame(rows, "peak_id long, frame_index long, ss double, fs double, intensity double").write.parquet(f"{d}/peaks.parquet")
    return d, rows


def lifted(x, y):
    n = math.sqrt((x * 75e-6) ** 2 + (y * 75e-6) ** 2 + 0.01)
    return x * 75e-6 / n / 1.3, y * 75e-6 / n / 1.3, (0.1 / n - 1) / 1.3


def test_all_peaks_are_lifted_and_projected(spark, peaks):
    d, rows = peaks
    lift = crystal.q_lift_panels(spark, d).toPandas().set_index("peak_id")
    back = crystal.q_project(spark, d).toPandas().set_index("peak_id")
    assert len(lift) == len(back) == len(rows)
    for k, _, r, c, _ in rows:
        x, y = (-1040 + c - 0.01 * r, -512 + 0.01 * c + r) if c < 1039.5 else (4 + (c - 1040) + 0.02 * r, -512 - 0.02 * (c - 1040) + r)
        assert lift.loc[k].tolist() == pytest.approx(lifted(x, y), abs=1e-6)
        on = 0 <= r <= 2075 and (0 <= c <= 1039 or 1040 <= c <= 2079)
        assert back.loc[k].tolist() == pytest.approx([r, c], abs=1e-3) if on else back.loc[k].isna().all()


def test_refinement_searches_by_the_default_rule(spark, run, monkeypatch):
    d, mats = run
    asked = []
    monkeypatch.setattr(indexing, "index_frames", lambda p, cell=None, rule=indexing.SearchRule(): asked.append((p, rule)) or p.selectExpr("frame_index", "1 AS n_peaks", "1 AS n_indexed", "0D AS rmsd"))
    kernels.seed_refine(spark, d)
    p, rule = asked[0]
    got = p.toPandas()
    assert rule == indexing.SearchRule()
    assert np.linalg.norm(got[["qx", "qy", "qz"]].to_numpy(), axis=1).max() > 0.5 and set(got.frame_index) == set(mats)


def test_fitness_is_that_of_the_best_of_all_directions(spark, peaks):
    d, rows = peaks
    got = crystal.seed_fitness(spark, d).toPandas().set_index("frame_index")
    for f, n in ((7, 6000), (8, 12000)):  # fewer than 30 peaks are tried along twice as many
        q = np.array([lifted(c - 1040, r - 512) for _, g, r, c, _ in rows if g == f])
        z = (np.arange(n) + 0.5) / n
        phi = np.arange(n) * 2.399963229728653
        dirs = np.stack([np.sqrt(1 - z * z) * np.cos(phi), np.sqrt(1 - z * z) * np.sin(phi), z], axis=1)
        fit = np.cos(2 * math.pi * 48.31 * (dirs @ q.T)).mean(axis=1)
        assert got.loc[f, "n"] == n and got.loc[f, "fitness"] == pytest.approx(fit.max(), abs=2e-6)


def test_noise_and_assembly_take_all_frames(spark, tmp_path):
    n, d = 40, str(tmp_path)
    e = np.random.default_rng(6).normal(0, 1, (n, 64)).astype(np.float32)
    spark.createDataFrame([(k, e[k].tolist()) for k in range(n)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    px = 100 + 80 * e.astype(float).reshape(n, 8, 8)
    put = crystal.assemble_physical(spark, d).toPandas()
    assert put.groupby("frame_index").size().to_dict() == {k: 64 for k in range(n)}
    assert np.allclose(np.sort(put.adu), np.sort(px.ravel()), atol=1e-4)
    run = detector.noise_running(spark, d).toPandas()
    assert len(run) == px.size
    last = run[run.frame_index == n - 1].sort_values(["row", "col"])
    every = detector.noise_pixel_stats(spark, d).toPandas().sort_values(["row", "col"])
    for got in (last, every):
        assert (got.n == n).all() and np.allclose(got["mean"], px.mean(axis=0).ravel(), atol=1e-4) and np.allclose(got["var"], px.var(axis=0, ddof=1).ravel(), atol=1e-3)
    panel = detector.noise_panel(spark, d).toPandas().set_index("panel")
    assert (panel.n == n).all() and panel.loc["t0", "mean"] == pytest.approx(px[:, :, :4].mean(), abs=1e-4)
    radial = detector.noise_radial(spark, d).toPandas()
    rr, cc = np.mgrid[0:8, 0:8]
    bins = (np.hypot(rr - 3.5, cc - 3.5) / 2).astype(int)
    assert (radial.n == n).all()
    for r in radial.itertuples():
        assert r.mean == pytest.approx(px[:, bins == r.bin].mean(), abs=1e-4)


def test_orphans_are_followed_to_the_end(spark):
    rows = [(k, k - 1) for k in range(1, 7)]  # row 1 refers to a row 0 that is not there
    e = {"t": Entity(spark.createDataFrame(rows, "k long, up long"), "k")}
    fk = [ForeignKey("t", "up", "t", "k")]
    assert sorted((r["row"], r["level"]) for r in find_orphans(e, fk).collect()) == [(str(k), k - 1) for k in range(1, 7)]
    assert find_orphans(e, fk, max_rounds=5).count() == 6
    with pytest.raises(RuntimeError):
        find_orphans(e, fk, max_rounds=3)
    assert inspect.signature(find_orphans).parameters["max_rounds"].default is None
