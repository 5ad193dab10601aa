"""Geometry, lattice, indexing, integration, sources, sinks and the whole run."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import lattice
from lumenframe.functions.geometry import Detector, Panel, detector_to_q, q_max, q_to_detector
from lumenframe.functions.scoring import poisson_tail
from lumenframe.operators import dense, indexing, reflections
from lumenframe.plans import detector
from lumenframe.plans.pipeline import Pipeline
from lumenframe.sinks import tables, text
from lumenframe.sources import frames as src
from lumenframe.sources import geom

GEOM = """; made up
clen = 0.10
photon_energy = 9537.246
res = 6666.6667
adu_per_eV = 0.0001
max_adu = 60000
0/min_fs = 0
0/max_fs = 255
0/min_ss = 0
0/max_ss = 255
0/corner_x = -127.5
0/corner_y = -127.5
0/fs = +1.0x +0.0y
0/ss = +0.0x +1.0y
bad_edge/min_fs = 0
bad_edge/max_fs = 3
bad_edge/min_ss = 0
bad_edge/max_ss = 255
"""
CELL_TEXT = "lattice_type = monoclinic\ncentering = P\nunique_axis = b\na = 48.3 A\nb = 61.9 A\nc = 73.1 A\nal = 90 deg\nbe = 104 deg\nga = 90 deg\n"


def test_parsers():
    g = geom.parse_geometry(GEOM)
    assert len(g.panels) == 1 and g.bad_regions[0]["max_fs"] == 3
    assert g.beam_row == 127.5 and g.wavelength == pytest.approx(1.3, rel=1e-4) and g.pixel_size == pytest.approx(150e-6)
    assert g.adu_per_photon == pytest.approx(0.9537246)
    assert geom.axis_vector("+1.2e-3x +0.99y") == (0.0012, 0.99) and geom.axis_vector("none") is None and geom.axis_vector("-y") == (0.0, -1.0)
    assert geom.mask_bits("0xFF") == 255 and geom.mask_bits(None, 3) == 3
    c = geom.parse_cell(CELL_TEXT)
    assert c.beta == pytest.approx(math.radians(104)) and c.in_degrees()["lattice_type"] == "monoclinic"
    with pytest.raises(ValueError):
        geom.parse_cell("a = 3 A")
    with pytest.raises(ValueError):
        geom.parse_geometry("clen = 0.1").detector()


def test_distance_from_values(spark):
    g = geom.parse_geometry(GEOM.replace("clen = 0.10", "clen = /LCLS/z") + "0/coffset = 0.583\n")
    v = spark.createDataFrame([(-500.0,), (float("nan"),), (None,)], "z double")
    assert geom.resolve_distance(g, v, "z", "clen").clen == pytest.approx(0.083)


def test_forward_and_back(spark):
    tilted = (Panel("a", 0, 99, 0, 199, -100.0, -100.0, 1.0, 0.02, -0.02, 1.0), Panel("b", 100, 199, 0, 199, 205.0, -95.0, 0.0, 1.0, -1.0, 0.0))
    for d in (Detector(0.1, 75e-6, 1.0, 99.5, 99.5), Detector(0.1, 75e-6, 1.0, 99.5, 99.5, tilted)):
        p = spark.createDataFrame([(float(r), float(c)) for r in (1, 50, 150, 198) for c in (1, 60, 98, 101, 180)], "row double, col double")
        q = p.select("*", *[x.alias(n) for n, x in zip("xyz", detector_to_q(F.col("row"), F.col("col"), d), strict=True)])
        back = q_to_detector(F.col("x"), F.col("y"), F.col("z"), d)
        got = q.select("row", "col", back[0].alias("r"), back[1].alias("c"), F.sqrt((F.col("x")) ** 2 + F.col("y") ** 2 + (F.col("z") + 1) ** 2).alias("one")).toPandas()
        assert np.allclose(got.one, 1) and np.allclose(got.row, got.r, atol=1e-6) and np.allclose(got.col, got.c, atol=1e-6)
    off = spark.range(1).select(q_to_detector(F.lit(0.5), F.lit(0.5), F.lit(0.0), Detector(0.1, 75e-6, 1.0, 99.5, 99.5, tilted))[0].alias("r")).first()
    assert off["r"] is None
    assert q_max(Detector(0.1, 75e-6, 1.0, 99.5, 99.5), 200, 200) == pytest.approx(2 * math.sin(math.atan2(99.5 * 2**0.5 * 75e-6, 0.1) / 2))


def test_lattice_round_trips():
    c = geom.parse_cell(CELL_TEXT)
    b = lattice.basis(c)
    assert np.allclose(lattice.cell_of(b), (c.a, c.b, c.c, c.alpha, c.beta, c.gamma))
    assert 1 / abs(np.linalg.det(b)) == pytest.approx(c.volume)
    skew = b @ np.linalg.inv(np.array([[1, 1, 0], [0, 1, 2], [0, 0, 1]], float)).T
    e = np.sort(lattice.cell_of(lattice.reduce_basis(skew))[:3])
    assert np.allclose(e, np.sort([c.a, c.b, c.c]), rtol=1e-6)
    rot = indexing.rotations(np.array([0.3, -0.8, 0.4]))
    u, _ = lattice.orientation(rot @ b, b)
    assert np.allclose(u, rot)
    with pytest.raises(ValueError):
        lattice.basis(lattice.Cell(1, 1, 1, 1, 1, 0.0))


def test_gradient_of_a_rotated_vector():
    rng = np.random.default_rng(0)
    for scale in (1e-9, 1e-3, 1.0):
        w, p = rng.normal(0, scale, 3), rng.normal(0, 1, 3)
        j = -indexing.cross_matrix(indexing.rotations(w) @ p) @ indexing.left_jacobian(w)
        num = np.stack([(indexing.rotations(w + h) @ p - indexing.rotations(w - h) @ p) / 2e-6 for h in np.eye(3) * 1e-6], axis=1)
        assert np.allclose(j, num, atol=1e-5)


def test_indexing_recovers_a_planted_crystal():
    rng = np.random.default_rng(1)
    c = geom.parse_cell(CELL_TEXT)
    rule = indexing.SearchRule(directions=1500, spins=60, top_directions=12, candidates=32, rounds=100)
    for k in range(3):
        a = indexing.rotations(rng.normal(0, 1, 3)) @ lattice.basis(c)
        hkl = rng.integers(-6, 7, (40, 3))
        q = np.concatenate([hkl @ a.T + rng.normal(0, 2e-4, (40, 3)), rng.uniform(-0.1, 0.1, (6, 3))])
        got = indexing.index_one(q, None, None, c, rule)
        assert got is not None and got[3] >= 36 and got[4] < 0.002
        assert np.allclose(np.sort(lattice.cell_of(got[0])[:3]), np.sort([c.a, c.b, c.c]), rtol=0.02)
    assert indexing.index_one(q[:3], None, None, c, rule) is None


def test_deblending(spark):
    """Two centres four pixels apart share the column between them; ties go to the first."""
    centres = spark.createDataFrame([(0, 0, 24.0, 22.0), (0, 1, 24.0, 26.0)], "frame_index long, refl int, row double, col double")
    spot = {(24, 22): 100.0, (24, 26): 80.0, (24, 24): 30.0}
    px = spark.createDataFrame([(0, r, c, spot.get((r, c), 0.0), 1.0, 0.0) for r in range(40) for c in range(40)], "frame_index long, row int, col int, excess double, var double, mean double")
    got = {r["refl"]: r for r in reflections.integrate_boxes(centres, px, 3, 40, 40).collect()}
    assert (got[0]["intensity"], got[1]["intensity"]) == (130.0, 80.0)
    n = got[0]["n"]
    assert got[0]["sigma"] == pytest.approx(math.sqrt(n * (1 + n / 280) + 130.0))
    img = np.zeros((40, 40))
    for (r, c), v in spot.items():
        img[r, c] = v
    one = np.ones((40, 40))
    s = {"z": img, "excess": img, "var": one, "mean": one * 0, "mask": one > 0}
    k = dense.integrate_image(s, np.array([24.0, 24.0]), np.array([22.0, 26.0]), 3, 1.0, 280)
    assert k[0, 0] == 130.0 and k[1, 0] == 80.0 and k[0, 1] == pytest.approx(got[0]["sigma"])


def test_poisson_tail(spark):
    df = spark.createDataFrame([(3, 2.0), (0, 5.0), (4, 0.0), (900, 800.0)], "k long, m double")
    got = [r[0] for r in df.select(poisson_tail(F.col("k"), F.col("m"))).collect()]
    assert got[0] == pytest.approx(0.323324, abs=1e-6) and got[1] == 1.0 and got[2] == 0.0 and 0 < got[3] < 1e-3


def test_limits(spark):
    rows = [("a", k / 10, 20.0 - k * 0.25) for k in range(100)] + [("few", 1.0, 5.0)] + [("all", k / 10, 9.0) for k in range(50)]
    df = spark.createDataFrame(rows, "f string, q double, s double")
    got = {r["f"]: r["limit"] for r in reflections.falloff_limit(df, "f", "q", "s").collect()}
    mid = [np.mean([20 - k * 0.25 for k in range(10 * i, 10 * i + 10)]) for i in range(10)]
    i = next(j for j, m in enumerate(mid) if m < 1)
    want = (10 * (i - 1) + 5) / 10 + 1.0 * (mid[i - 1] - 1) / (mid[i - 1] - mid[i])
    assert got["a"] == pytest.approx(want) and got["few"] is None and got["all"] == pytest.approx(4.9)
    assert {r["f"]: r["limit"] for r in reflections.percentile_limit(df, "f", "q").collect()}["a"] == 9.0


def test_locating_frames(spark):
    files = spark.createDataFrame([("x/a.h5", 0, 3), ("x/b.h5", 1, 0), ("x/c.h5", 2, 5000)], "filename string, pos int, n_frames long")
    r = src.frame_ranges(files)
    assert [(x["start"], x["stop"]) for x in r.orderBy("pos").collect()] == [(0, 3), (3, 3), (3, 5003)]
    df = spark.createDataFrame([(0,), (2,), (3,), (5002,), (5003,), (None,)], "frame_index long")
    got = {x["frame_index"]: (x["filename"], x["event"]) for x in src.locate_frames(df, r).collect()}
    assert got == {0: ("x/a.h5", 0), 2: ("x/a.h5", 2), 3: ("x/c.h5", 0), 5002: ("x/c.h5", 4999), 5003: ("unknown", 5003), None: ("unknown", 0)}
    assert src.resolve_frame(r, "c.h5", 7) == 10 and src.parse_event("run.h5//3") == ("run.h5", 3)
    with pytest.raises(KeyError):
        src.resolve_frame(r, "c.h5", 9999)


@pytest.mark.parametrize("total,blocks", [(810, 4), (10, 3), (7, 8), (100, 1), (256, 8)])
def test_blocks(spark, total, blocks):
    b = [r[0] for r in spark.range(total).orderBy("id").select(src.block_of(F.col("id"), total, blocks)).collect()]
    sizes = np.bincount(b, minlength=blocks)
    assert b == sorted(b) and sizes.max() - sizes.min() <= 1 and (np.diff(sizes) <= 0).all()


def test_masks(spark):
    w = spark.createDataFrame([(0,), (1,), (2,), (3,)], "w long")
    assert [r[0] for r in w.select(src.good_pixel(F.col("w"), 1, 2)).collect()] == [False, True, False, False]
    assert spark.range(1).select(src.good_pixel(F.lit(-1).cast("long"), 1 << 63, 0)).first()[0]


def test_tables_backfill_and_merge(spark, tmp_path):
    ev = spark.createDataFrame([(k, "a.h5", k) for k in range(4)], "frame_index long, filename string, event long")
    d = Detector(0.1, 75e-6, 1.0, 50.0, 50.0)
    for shard, lo in (("s0", 0), ("s1", 2)):
        mine = ev.where((F.col("frame_index") >= lo) & (F.col("frame_index") < lo + 2))
        solved = mine.where(F.col("frame_index") == lo).withColumn("indexed", F.lit(True)).withColumn("rmsd", F.lit(float("nan")))
        peaks = tables.peak_rows(solved.select("*", F.lit(10.0).alias("row"), F.lit(20.0).alias("col"), F.lit(5.0).alias("intensity")), d)
        refl = tables.reflection_rows(solved.withColumn("sigma", F.explode(F.array(F.lit(1.0), F.lit(0.0), F.lit(2.0)))).select("*", *[F.lit(1).alias(x) for x in "hkl"], F.lit(3.0).alias("intensity"), F.lit(1.0).alias("peak"), F.lit(0.0).alias("background"), F.lit(1.0).alias("row"), F.lit(2.0).alias("col")), d)
        t = {"frames": tables.frame_rows(solved, peaks, refl, mine), "peaks": peaks, "reflections": refl} | tables.metadata_tables(spark, geom.parse_geometry(GEOM), None)
        tables.write_tables(t, str(tmp_path / shard))
    merged, n = tables.merge_shards(spark, [str(tmp_path / s) for s in ("s0", "missing", "s1")])
    f = merged["frames"].orderBy("frame_index").collect()
    assert n == 2 and [r["indexed"] for r in f] == [True, False, True, False] and [r["serial"] for r in f] == [1, None, 2, None]
    assert f[0]["num_reflections"] == 2 and f[0]["n_peaks"] == 1 and f[0]["rmsd"] is None and f[1]["n_peaks"] is None
    assert merged["geometry"].count() == 1 and merged["cell"].count() == 0
    assert tables.duplicate_frame_ids(merged["frames"]).count() == 0
    assert f[3]["frame_id"] == spark.range(1).select(lattice.frame_id(F.lit("a.h5"), F.lit(3))).first()[0] == "29b7bf07023ea3e1"
    pad = text.padded_peaks(spark.createDataFrame([("a", 0, 1.0, 2.0, 3.0), ("a", 0, 4.0, 5.0, 6.0), ("a", 1, 7.0, 8.0, 9.0)], "filename string, event long, row double, col double, intensity double"))
    assert {r["event"]: r["peakXPosRaw"] for r in pad.collect()} == {0: [2.0, 5.0], 1: [8.0, 0.0]}


@pytest.fixture(scope="module")
def run(spark):
    """Eight noise frames and two with a crystal, as the run would see them."""
    g, c = geom.parse_geometry(GEOM), geom.parse_cell(CELL_TEXT)
    d = g.detector()
    rows = [(f, [float(x) for x in (indexing.rotations(np.array(w)) @ lattice.basis(c)).ravel()]) for f, w in ((8, (0.3, -0.5, 0.9)), (9, (-0.7, 0.2, 0.4)))]
    crystals = spark.createDataFrame(rows, "frame_index long, a array<double>")
    spots = reflections.predict_reflections(crystals, d, 0.12, 256, 256, eta=0.002, least=1.2e-3).select("frame_index", "row", "col", F.lit(350.0).alias("intensity"))
    frames = src.simulate_frames(spark, 10, 256, 256, spots, mean=100.0, sigma=10.0, psf=1.0, seed=11)
    return g, c, frames, spots


def test_whole_run(spark, run, tmp_path):
    g, c, frames, spots = run
    path = str(tmp_path / "frames.parquet")
    frames.write.parquet(path)
    p = Pipeline(src.read_frames(spark, path), g, 256, 256, c, search=indexing.SearchRule(directions=1500, spins=60, top_directions=12, candidates=32, rounds=80))
    with pytest.raises(RuntimeError):
        p.calibration  # noqa: B018
    k = p.calibrate(seed=8, target_noise_peaks=2)
    assert 3.0 <= k.threshold <= 8.0 and not k.background.valid[:, :4].any()
    found = p.peaks().df.groupBy("frame_index").count().toPandas().set_index("frame_index")["count"]
    planted = spots.groupBy("frame_index").count().toPandas().set_index("frame_index")["count"]
    assert all(found[f] >= 0.4 * planted[f] for f in (8, 9))
    solved = p.index(start=6)
    got = solved.df.toPandas().set_index("frame_index")
    assert set(got.index) == {8, 9} and (got["rmsd"] < 0.01).all() and (got["enrichment"] > 1).all()
    assert np.allclose(np.sort(got[["cell_a_A", "cell_b_A", "cell_c_A"]].to_numpy(), axis=1), np.sort([c.a, c.b, c.c]), rtol=0.02)
    out = str(tmp_path / "out")
    solved.to_db(out)
    t = {n: spark.read.parquet(f"{out}/{n}.parquet") for n in tables.SCHEMAS}
    assert t["frames"].count() == 4 and t["frames"].where("indexed").count() == 2
    assert t["reflections"].join(t["frames"], "frame_id").where("indexed").count() == t["reflections"].count() > 50
    solved.to_stream(str(tmp_path / "run.stream"))
    body = "\n".join(r[0] for r in spark.read.text(str(tmp_path / "run.stream")).collect())
    assert body.count("----- Begin chunk -----") == 2 == body.count("--- Begin crystal") and text.VERSION in body


def brute_prediction(m, d, limit, height, width, eta, size, bandwidth, sigma, least, keep=lambda h, k, l: True):  # noqa: E741
    """Every triple of the box, one after the other."""
    n = np.maximum(np.ceil(limit * np.linalg.norm(np.linalg.inv(m), axis=1)), 1).astype(int)
    hkl = np.stack(np.meshgrid(*[np.arange(-x, x + 1) for x in n], indexing="ij"), -1).reshape(-1, 3)
    q = hkl @ m.T
    qn, s = np.linalg.norm(q, axis=1), d.wavelength * q + [0, 0, 1]
    radius = size + 0.5 * eta * qn + 0.5 * d.wavelength * bandwidth * qn * qn if eta is not None else 0.0 * qn
    near = (qn > 0) & (qn <= limit) & (s[:, 2] > 0) & (np.abs(np.linalg.norm(s, axis=1) - 1) < np.maximum(d.wavelength * sigma * radius, least))
    far = d.clen / d.pixel_size
    row, col = d.beam_row + s[:, 1] / np.maximum(s[:, 2], 1e-9) * far, d.beam_col + s[:, 0] / np.maximum(s[:, 2], 1e-9) * far
    near &= (row >= 0) & (row <= height - 1) & (col >= 0) & (col <= width - 1)
    return {tuple(int(v) for v in x): (r, c) for x, r, c in zip(hkl[near], row[near], col[near], strict=True) if keep(*x)}


@pytest.mark.parametrize(
    "place,shape,eta,bandwidth,sigma,least,centering",
    [((512.0, 1040.0), (2076, 2080), 0.003, 0.0, 1.5, 5e-4, None), ((512.0, 1040.0), (2076, 2080), 0.003, 0.01, 1.5, 5e-4, "I"), ((-300.0, 900.0), (400, 300), 0.01, 0.0, 2.0, 1e-3, "F"), ((512.0, 1040.0), (1024, 2080), None, 0.0, 1.5, 2e-3, "R"), ((40.0, 40.0), (80, 80), 0.9, 0.0, 3.0, 1e-3, "C")],
)
def test_prediction_finds_what_the_whole_box_holds(spark, place, shape, eta, bandwidth, sigma, least, centering):
    """Skew, long and turned cells, with frames around and beside the beam; nothing but the reflections leaves the kernel."""
    d = Detector(0.1, 75e-6, 1.3, *place)
    limit = min(q_max(d, *shape), 0.6)
    cells = [(30.0, 41.0, 55.0, 90, 100, 90), (20.0, 22.0, 140.0, 80, 95, 110), (25.0, 25.0, 25.0, 60, 60, 60), (90.0, 18.0, 24.0, 90, 90, 120)]
    rng = np.random.default_rng(9)
    mats = [indexing.rotations(rng.normal(0, 2, 3)) @ lattice.basis(lattice.Cell(*c[:3], *[math.radians(x) for x in c[3:]])) for c in cells]
    rows = [(k, m.ravel().tolist()) for k, m in enumerate(mats)] + [(90, None), (91, [1.0] * 8 + [None])]
    rule = {None: lambda h, k, l: True, "I": lambda h, k, l: (h + k + l) % 2 == 0, "F": lambda h, k, l: (h + k) % 2 == 0 == (h + l) % 2, "R": lambda h, k, l: (k + l - h) % 3 == 0, "C": lambda h, k, l: (h + k) % 2 == 0}[centering]  # noqa: E741
    crystals = spark.createDataFrame(rows, "frame_index long, a array<double>")
    out = reflections.predict_reflections(crystals, d, limit, *shape, F.lit(eta).cast("double"), 5e-5, bandwidth, sigma, least, centering)
    assert out.columns[:2] == ["frame_index", "a"] and "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    got = {k: {(x.h, x.k, x.l): (x.row, x.col) for x in g.itertuples()} for k, g in out.toPandas().groupby("frame_index")}
    want = {k: w for k, m in enumerate(mats) if (w := brute_prediction(m, d, limit, *shape, eta, 5e-5, bandwidth, sigma, least, rule))}
    assert want and got.keys() == want.keys()
    for k in want:
        assert got[k].keys() == want[k].keys() and np.allclose([got[k][x] for x in want[k]], list(want[k].values()))


def test_prediction_goes_through_few_lines_beside_the_frame():
    """Of a large cell, some three candidates per reflection, not the lines of the whole box."""
    m, d = indexing.rotations(np.array([0.4, 1.1, -0.3])) @ lattice.basis(lattice.Cell(150.0, 170.0, 190.0, *[math.pi / 2] * 3)), Detector(0.1, 75e-6, 1.3, 512.0, 1040.0)
    limit = q_max(d, 2076, 2080)
    tol = 1.95 * (5e-5 + 0.0015 * limit)
    h, k, l = reflections.shell_candidates(m, limit, 1.3, tol, reflections.frame_corners((0.1 / 75e-6, 512.0, 1040.0, 2076, 2080)))  # noqa: E741
    want = brute_prediction(m, d, limit, 2076, 2080, 0.003, 5e-5, 0.0, 1.5, 5e-4)
    assert set(want) <= set(zip(h.astype(int).tolist(), k.astype(int).tolist(), l.astype(int).tolist(), strict=True)) and len(h) < 3 * len(want)
    assert len(reflections.shell_candidates(m, limit, 1.3, tol)[0]) > 1.5 * len(h)


def test_rounding_as_in_sql(spark):
    x = [0.5e-6, -0.5e-6, 1.5e-6, 2.5e-6, -2.5e-6, 0.0, -1e-9, 1234.5678905, 512.0, -0.25, 1e-3, None]
    got = [r[0] for r in detector.rounded_as_sql(spark.createDataFrame([(v,) for v in x], "x double"), 6).collect()]
    assert got == [None if v is None else math.copysign(math.floor(abs(v * 1e6) + 0.5), v) / 1e6 for v in x]
    assert math.copysign(1.0, got[6]) == 1.0 == math.copysign(1.0, got[5])


def test_blocks_of_peaks_fit_as_all_at_once():
    rng = np.random.default_rng(3)
    b = lattice.basis(lattice.Cell(21.0, 27.0, 33.0, 1.5, 1.8, 1.6))
    a, q = indexing.rotations(rng.normal(0, 1, (48, 3))) @ b, rng.uniform(-0.4, 0.4, (1500, 3))
    hkl, r2 = indexing.residuals(a, q)
    parts = [(p, h.copy(), r) for p, h, r in indexing.fits(a, q)]
    assert len(parts) > 1 and np.allclose(np.concatenate([r for _, _, r in parts], axis=1), r2)
    assert (np.concatenate([h for _, h, _ in parts], axis=2).transpose(1, 2, 0) == hkl).all()


def test_frames_that_come_together_are_not_shuffled(spark):
    """The same solutions, whether Spark brings the rows of a frame together or they come so; a lost row is an error."""
    rng = np.random.default_rng(2)
    c = lattice.Cell(21.0, 27.0, 33.0, math.radians(90), math.radians(105), math.radians(90))
    rows = []
    for f in range(3):
        a = indexing.rotations(rng.normal(0, 1, 3)) @ lattice.basis(c)
        q = rng.integers(-6, 7, (50, 3)) @ a.T
        rows += [(f, int(k), *map(float, v), 1.0, [21.0, 27.0, 33.0, 90.0, 105.0, 90.0], len(q)) for k, v in zip(rng.permutation(50), q, strict=True)]
    rows[7] = (0, 999, None, 0.1, 0.1, 1.0, *rows[7][6:])
    p = spark.createDataFrame(rows, "frame_index long, peak_id long, qx double, qy double, qz double, intensity double, cell array<double>, together int").coalesce(1)
    rule = indexing.SearchRule(directions=1500, spins=60, top_directions=12, candidates=32, rounds=60)
    with_shuffle = indexing.index_frames(p.drop("together"), None, rule).orderBy("frame_index").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        df = indexing.index_frames(p, None, rule)
        got = df.collect()
        with pytest.raises(Exception, match="do not follow one another"):
            indexing.index_frames(p.where("peak_id <> 999"), None, rule).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert got == with_shuffle and [r["n_peaks"] for r in got] == [49, 50, 50]
