"""Queries of geometry, lattice, prediction, integration and table operators, over the run's tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import geometry, lattice, scoring
from lumenframe.functions.geometry import Detector, Panel
from lumenframe.operators import indexing, noise, reflections as refl
from lumenframe.plans import detector as images
from lumenframe.plans.detector import rounded, rounded_as_sql
from lumenframe.session import spread, table
from lumenframe.sinks import tables as out_tables
from lumenframe.sinks import text
from lumenframe.sources import frames as src
from lumenframe.sources.geom import parse_cell, split_lines

DET = Detector(0.1, 75e-6, 1.3, 512.0, 1040.0)
TILTED = Detector(0.1, 75e-6, 1.3, 512.0, 1040.0, (Panel("west", 0, 1039, 0, 2075, -1040.0, -512.0, 1.0, 0.01, -0.01, 1.0), Panel("east", 1040, 2079, 0, 2075, 4.0, -512.0, 1.0, -0.02, 0.02, 1.0)))
SHAPE = (1024, 2080)


def _peaks(spark, d):
    return table(spark, d, "peaks").where("frame_index IS NOT NULL").select("peak_id", "frame_index", F.col("ss").alias("row"), F.col("fs").alias("col"), "intensity").distinct()


def _crystals(spark, d):
    """One matrix (1/Angstrom, row by row) per indexed frame."""
    f = table(spark, d, "frames").where("indexed AND astar_x IS NOT NULL")
    a = F.array(*[F.col(f"{v}_{x}") / 10.0 for x in "xyz" for v in ("astar", "bstar", "cstar")])
    return f.groupBy("frame_index").agg(F.min(a).alias("a"))


def _limits(spark, d) -> tuple[float, int, int]:
    """The largest q of the detector, and the height and width that hold all of its panels."""
    top = table(spark, d, "panels").agg(F.max("max_ss").alias("ss"), F.max("max_fs").alias("fs")).first()
    shape = max(SHAPE[0], (top["ss"] or 0) + 1), max(SHAPE[1], (top["fs"] or 0) + 1)
    return geometry.q_max(DET, *shape), *shape


def q_lift(spark, d):
    q = geometry.detector_to_q(F.col("row"), F.col("col"), DET)
    return rounded(_peaks(spark, d).select("peak_id", *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz"), strict=True)]), 6)


def q_lift_panels(spark, d):
    q = geometry.detector_to_q(F.col("row"), F.col("col"), TILTED)
    return rounded(_peaks(spark, d).select("peak_id", *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz"), strict=True)]), 6)


def q_project(spark, d):
    """Pixels lifted and projected again, by panels: the way back ends where it began, or is NULL
    where a place lies off the panels (in the half pixel around one, or between them)."""
    p = _peaks(spark, d)
    q = geometry.detector_to_q(F.col("row"), F.col("col"), TILTED)
    p = p.select("peak_id", *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz"), strict=True)])
    row, col = geometry.q_to_detector(F.col("qx"), F.col("qy"), F.col("qz"), TILTED)
    return rounded(p.select("peak_id", row.alias("row"), col.alias("col")), 3)


def q_max(spark, d):
    return spark.createDataFrame([(round(geometry.q_max(DET, *SHAPE), 9),)], "q_max double")


def flat_resolution(spark, d):
    return rounded(_peaks(spark, d).select("peak_id", geometry.flat_resolution(F.col("row"), F.col("col"), DET).alias("resolution")))


def _bounds(spark, d) -> list[Panel]:
    rows = table(spark, d, "panels").orderBy("name").collect()  # a detector's panels, of a fixed number whatever the run
    return [Panel(r["name"], r["min_fs"], r["max_fs"], r["min_ss"], r["max_ss"]) for r in rows]


def panel_assign_first(spark, d):
    p = _bounds(spark, d)
    return _peaks(spark, d).select("peak_id", F.coalesce(noise.panel_of(F.col("row"), F.col("col"), p), F.lit("p0")).alias("panel"))


def panel_assign_last(spark, d):
    wide = [Panel(p.name, p.min_fs - 3, p.max_fs + 3, p.min_ss - 3, p.max_ss + 3) for p in _bounds(spark, d)]
    return _peaks(spark, d).select("peak_id", noise.panel_of(F.col("row"), F.col("col"), wide, last=True).alias("panel"))


def _events(spark, d):
    return table(spark, d, "frames").select("frame_id", "frame_index", "filename", "event").distinct()


def frame_ranges(spark, d):
    return src.frame_ranges(_files(spark, d))


def _files(spark, d):
    """The files of the run in order of name, with their numbers of frames."""
    per = _events(spark, d).groupBy("filename").agg(F.count(F.lit(1)).alias("n_frames"))
    return per.withColumn("pos", F.row_number().over(Window.orderBy("filename")) - 1)


def frame_locate(spark, d):
    p = table(spark, d, "peaks").select("peak_id", "frame_index").distinct()
    return src.locate_frames(p, src.frame_ranges(_files(spark, d)))


def frame_id(spark, d):
    return _events(spark, d).select("frame_index", lattice.frame_id(F.col("filename"), F.col("event")).alias("made"), (lattice.frame_id(F.col("filename"), F.col("event")) == F.col("frame_id")).alias("same"))


def _cells(spark, d):
    c = ["cell_a_a", "cell_b_a", "cell_c_a", "cell_alpha_deg", "cell_beta_deg", "cell_gamma_deg"]
    ok = " AND ".join(f"{x} IS NOT NULL AND NOT isnan({x}) AND {x} > 0" for x in c)
    return table(spark, d, "frames").where(f"indexed AND {ok}").select("frame_index", *[F.col(x).alias(n) for x, n in zip(c, ("a", "b", "c", "al", "be", "ga"), strict=True)]).distinct()


def _six():
    return [F.col(x) for x in "abc"] + [F.radians(x) for x in ("al", "be", "ga")]


def cell_volume(spark, d):
    return rounded(_cells(spark, d).select("frame_index", lattice.cell_volume(*_six()).alias("volume")), 2)


def cell_to_b(spark, d):
    m = lattice.reciprocal_basis(*_six())
    return rounded(_cells(spark, d).select("frame_index", *[m[r][c].alias(f"b{r}{c}") for r in range(3) for c in range(3)]), 7)


def cell_match(spark, d):
    """Which cells agree with the target cell, in ascending edges and angles."""
    t = table(spark, d, "cell").select(F.array("a_a", "b_a", "c_a", "alpha_deg", "beta_deg", "gamma_deg").alias("t"))
    c = _cells(spark, d).join(F.broadcast(t))  # the target is one row
    cell = F.array("a", "b", "c", "al", "be", "ga")
    return c.select("frame_index", refl.cell_matches(cell, F.col("t")).alias("match"), refl.cell_matches(cell, F.col("t"), supplements=False).alias("literal"))


def rotation(spark, d):
    m = lattice.axis_angle_matrix(F.col("astar_x"), F.col("astar_y"), F.col("astar_z"))
    f = table(spark, d, "frames").where("indexed AND astar_x IS NOT NULL")
    return rounded(f.select("frame_index", *[m[r][c].alias(f"r{r}{c}") for r in range(3) for c in range(3)]).distinct(), 6)


def hkl_enumerate(spark, d):
    """Size and bounds of each frame's grid of indices. The grid is symmetric and whole, so both follow
    from the bounds; it is never laid out."""
    g = refl.index_bounds(_crystals(spark, d), _limits(spark, d)[0])
    n = (2 * F.col("h").cast("long") + 1) * (2 * F.col("k").cast("long") + 1) * (2 * F.col("l").cast("long") + 1) - 1
    return g.select("frame_index", n.alias("n"), "h", "k", "l")


def hkl_absences(spark, d):
    r = table(spark, d, "reflections").select("reflection_id", "h", "k", "l").distinct()
    h, k, l = (F.col(x) for x in "hkl")  # noqa: E741
    return r.agg(*[F.count_if(lattice.allowed(h, k, l, c)).alias(f"n_{c.lower()}") for c in "PABCIFRH"])


def _predicted(spark, d, *columns):
    return refl.predict_reflections(_crystals(spark, d), DET, *_limits(spark, d), eta=0.003, size=5e-5, columns=columns)


def ewald_shell(spark, d):
    return rounded_as_sql(_predicted(spark, d, "frame_index", "h", "k", "l", "qn", "excitation", "row", "col"), 6)


def rocking(spark, d):
    return rounded_as_sql(_predicted(spark, d, "frame_index", "h", "k", "l", "qn").select("frame_index", "h", "k", "l", lattice.rocking_radius(F.col("qn"), F.lit(0.003), 5e-5, DET.wavelength, 0.002).alias("radius")), 9)


def mosaicity(spark, d):
    return rounded(refl.mosaicity(_predicted(spark, d, "frame_index", "qn", "excitation"), "frame_index", DET.wavelength, 0.0017), 7)


def hkl_assign(spark, d):
    """Indexed peaks of each frame against its matrix."""
    q = geometry.detector_to_q(F.col("row"), F.col("col"), DET)
    p = _peaks(spark, d).select("peak_id", "frame_index", *[c.alias(n) for c, n in zip(q, ("qx", "qy", "qz"), strict=True)])
    got = refl.assign_hkl(p.join(_crystals(spark, d), "frame_index"), 0.005)
    return got.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("n_indexed"), F.sum("h").alias("h"))


def snap_nn(spark, d):
    pred = table(spark, d, "reflections").where("frame_id IS NOT NULL").select(F.lower(F.trim("frame_id")).alias("frame_index"), F.col("reflection_id").alias("refl"), F.col("ss").alias("row"), F.col("fs").alias("col")).distinct()
    obs = table(spark, d, "peaks").where("frame_id IS NOT NULL").select(F.lower(F.trim("frame_id")).alias("frame_index"), F.col("ss").alias("row"), F.col("fs").alias("col")).distinct()
    return refl.snap(pred, obs, 20.0).select(F.col("refl").alias("reflection_id"), F.round("row", 4).alias("row"), F.round("col", 4).alias("col"), "snapped")


def _centres(spark, d):
    """Two places per 8 x 8 frame, from its first four numbers."""
    e = table(spark, d, "embeddings")
    spot = lambda k, i, j: F.struct(F.lit(k).alias("refl"), *[(F.lit(3.5) + F.lit(8.0) * F.col("embedding")[n].cast("double")).alias(x) for n, x in ((i, "row"), (j, "col"))])
    return e.select(F.col("vec_id").alias("frame_index"), F.explode(F.array(spot(1, 0, 1), spot(2, 2, 3))).alias("s")).select("frame_index", "s.*")


def deblend(spark, d):
    return refl.owned_pixels(_centres(spark, d), 2, 8, 8)


def box_integrate(spark, d):
    px = images.whitened(spark, d)
    return rounded(refl.integrate_boxes(_centres(spark, d), px, 2, 8, 8, gain=1.5))


def enrichment(spark, d):
    px = images.whitened(spark, d).withColumn("bright", F.col("z") > 1.0)
    return rounded(refl.enrichment(_centres(spark, d), px.select("frame_index", "row", "col", "bright")), 6)


def enrich_gate(spark, d):
    return refl.enrich_gate(table(spark, d, "frames"), 1e-3).select("frame_index").distinct()


def falloff_limit(spark, d):
    r = table(spark, d, "reflections").where("intensity IS NOT NULL AND NOT isnan(intensity) AND sigma > 0 AND resolution_nm_inv >= 0 AND panel IS NOT NULL")
    r = r.select("reflection_id", F.lower(F.trim("panel")).alias("panel"), F.col("resolution_nm_inv").alias("q"), (F.col("intensity") / F.col("sigma")).alias("isig")).distinct()
    return rounded(refl.falloff_limit(r, "panel", "q", "isig", target=8.0), 6)


def percentile_limit(spark, d):
    p = table(spark, d, "peaks").where("frame_index IS NOT NULL").select("peak_id", "frame_index", "resolution_nm_inv").distinct()
    return refl.percentile_limit(p, "frame_index", "resolution_nm_inv")


def topk_seed_peaks(spark, d):
    """The 80 strongest peaks of each frame, from which orientations are searched."""
    w = Window.partitionBy("frame_index").orderBy(F.col("intensity").desc(), "peak_id")
    p = _peaks(spark, d).where("intensity IS NOT NULL AND NOT isnan(intensity)")
    return p.withColumn("r", F.row_number().over(w)).where("r <= 80").select("frame_index", "peak_id")


SEARCH = indexing.SearchRule()


def seed_fitness(spark, d):
    """The best direction of the hemisphere per frame: mean cosine of the strongest peaks along it."""
    w = Window.partitionBy("frame_index").orderBy(F.col("intensity").desc(), "peak_id")
    p = _peaks(spark, d).where("intensity IS NOT NULL AND NOT isnan(intensity)").withColumn("r", F.row_number().over(w)).where(F.col("r") <= SEARCH.seed_peaks)
    q = geometry.detector_to_q(F.col("row"), F.col("col"), DET)
    per = spread(p.select("frame_index", *[F.coalesce(c, F.lit(float("nan"))).alias(k) for c, k in zip(q, ("qx", "qy", "qz"), strict=True)]), "frame_index")
    per = per.groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct("qx", "qy", "qz"))).alias("q"))
    per = per.select("frame_index", *[F.col(f"q.{k}").alias(k) for k in ("qx", "qy", "qz")])
    rule = SEARCH

    def kernel(batches):
        for b in batches:
            out = []
            for f, *v in zip(b["frame_index"], b["qx"], b["qy"], b["qz"], strict=True):
                at = np.stack([np.asarray(x, float) for x in v], axis=1)
                at = at[np.isfinite(at).all(axis=1)]
                dirs, fit = indexing.axis_fitness(at, 48.31, None, rule)
                out.append((int(f), float(fit.max()) if len(at) else None, len(dirs)))
            yield pd.DataFrame(out, columns=["frame_index", "fitness", "n"]).astype({"fitness": float})

    return rounded(per.mapInPandas(kernel, "frame_index long, fitness double, n long"), 6)


def accept_rank(spark, d):
    li = table(spark, d, "lineitem")
    c = li.groupBy(F.col("l_orderkey").alias("frame_index"), F.col("l_linenumber").alias("cand")).agg(
        F.max("l_quantity").alias("soft"), F.max(F.col("l_discount") + 0.01).alias("rmsd"), F.max(F.col("l_quantity").cast("int")).alias("n_indexed"), F.every(F.col("l_returnflag") != "R").alias("match")
    )
    return refl.accept(c).select("frame_index", "cand", "soft")


def backfill(spark, d):
    """Frames that yielded no reflection get a row all the same."""
    seen = table(spark, d, "reflections").where("frame_id IS NOT NULL").select(F.lower(F.trim("frame_id")).alias("frame_id")).distinct()
    written = _events(spark, d).join(seen, "frame_id", "left_semi").withColumn("indexed", F.lit(True))
    return out_tables.backfill(written, _events(spark, d)).select("frame_index", "frame_id", "indexed", "n_peaks")


def indexed_rate(spark, d):
    f = table(spark, d, "frames")
    return rounded(f.agg(F.avg(F.col("indexed").cast("int")).alias("rate"), F.count(F.lit(1)).alias("frames"), F.sum(F.col("indexed").cast("int")).alias("indexed"), F.max("peak_resolution_nm_inv").alias("best")), 6)


def funnel(spark, d):
    """Frames, hits and indexed frames, with guarded rates."""
    f = table(spark, d, "frames").select("frame_index", "n_peaks", "indexed").distinct()
    s = f.agg(F.countDistinct("frame_index").alias("frames"), F.count_if(F.col("n_peaks") >= 5).alias("hits"), F.count_if(F.col("indexed") & (F.col("n_peaks") >= 5)).alias("indexed"))
    return rounded(s.select("*", scoring.ratio_or_zero(F.col("hits"), F.col("frames")).alias("hit_rate"), scoring.ratio_or_zero(F.col("indexed"), F.col("hits")).alias("index_rate_of_hits")), 6)


def shard_union(spark, d):
    """Four shards of frames, written apart in thought, and united."""
    f = _events(spark, d)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    at = src.serials(f, "frame_index").join(F.broadcast(n)).withColumn("shard", src.block_of(F.col("serial") - 1, F.col("n"), 4))
    parts = [at.where(F.col("shard") == k) for k in range(4)]
    union = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return union.groupBy("shard").agg(F.count(F.lit(1)).alias("frames"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))


def block_bounds(spark, d):
    f = _events(spark, d)
    n = f.agg(F.count(F.lit(1)).alias("n"))
    at = src.serials(f, "frame_index").join(F.broadcast(n))
    return at.select("frame_index", src.block_of(F.col("serial") - 1, F.col("n"), 7).alias("block"))


def serials(spark, d):
    return src.serials(_events(spark, d).select("frame_index"), "frame_index")


def join_reflections(spark, d):
    """Reflections beside their frame: count and mean sigma per source."""
    f = _events(spark, d).select("frame_id", "filename")
    r = table(spark, d, "reflections").select("frame_id", "sigma")
    return rounded(r.join(f, "frame_id").groupBy("filename").agg(F.count(F.lit(1)).alias("reflections"), F.avg("sigma").alias("sigma")))


def attach_scale(spark, d):
    """Scales of the frames of their own attached to solutions by a left join."""
    s = _events(spark, d).select("frame_index")
    k = table(spark, d, "frames").where("scale > 0").groupBy("frame_index").agg(F.max("scale").alias("scale"))
    return s.join(k, "frame_index", "left")


def best_resolution(spark, d):
    return table(spark, d, "peaks").where("frame_id IS NOT NULL").groupBy("frame_id").agg(F.max("resolution_nm_inv").alias("resolution"))


def mask_bits(spark, d):
    return table(spark, d, "events").select("event_id", src.good_pixel(F.col("event_id"), 0b100, 0b011).alias("good"))


def static_mask(spark, d):
    return src.static_mask(images.pixels(spark, d), 110.0, [{"min_ss": 2, "max_ss": 3, "min_fs": 1, "max_fs": 2}])


def assemble_panels(spark, d):
    """Frames as two 8 x 4 slabs, put side by side the other way round."""
    px = images.pixels(spark, d)
    slabs = px.select("frame_index", F.when(F.col("col") < 4, "a").otherwise("b").alias("panel"), F.col("row").alias("ss"), (F.col("col") % 4).alias("fs"), "adu")
    return rounded(src.assemble_panels(slabs, [Panel("b", 0, 3, 0, 7), Panel("a", 4, 7, 0, 7)]))


def assemble_physical(spark, d):
    """A gap between the tiles and a quarter turn of the second."""
    tiles = [Panel("t0", 0, 3, 0, 7, -6.0, -4.0), Panel("t1", 4, 7, 0, 7, 2.0, 3.0, 0.0, -1.0, 1.0, 0.0)]
    return rounded(src.assemble_physical(images.pixels(spark, d), tiles))


def radial_profile(spark, d):
    return rounded(src.radial_profile(images.pixels(spark, d), (3.5, 3.5)))


def render_scale(spark, d):
    return rounded(src.render_scale(images.pixels(spark, d)))


def resolution_histogram(spark, d):
    """Forty equal bins of the peaks' resolution; the largest value belongs to the last."""
    p = table(spark, d, "peaks").where("resolution_nm_inv >= 0").select("peak_id", "resolution_nm_inv").distinct()
    top = p.agg(F.max("resolution_nm_inv").alias("top"))
    at = p.join(F.broadcast(top)).select(F.least(F.floor(F.col("resolution_nm_inv") / (F.col("top") / 40.0)), F.lit(39)).cast("int").alias("bin"))
    return at.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


GEOMETRY_TEXT = """; a made-up two-tile detector
clen = 0.125 ; metres
photon_energy = 9500
res = 13333.3
west/min_fs = 0
west/max_fs = 31
west/corner_x = -32.5
east/min_fs = 32 ; next to it
shadow/min_ss = 4
not an assignment
"""


def geom_parse(spark, d):
    lines = spark.createDataFrame([(x,) for x in GEOMETRY_TEXT.splitlines()], "value string")
    return split_lines(lines).select("block", "key", F.col("text").try_cast("double").alias("number"))


CELL_TEXT = """; a made-up cell
lattice_type = orthorhombic
centering = I
a = 50.3 A
b = 104.2 A ; the long one
c = 87.9 A
al = 90.0 deg
be = 90.0 deg
ga = 90.0 deg
not an assignment
"""


def cell_parse(spark, d):
    c = parse_cell(CELL_TEXT).in_degrees()
    row = (c["a"], c["b"], c["c"], round(c["alpha"], 6), round(c["beta"], 6), round(c["gamma"], 6), round(c["volume"], 3), c["lattice_type"], c["centering"])
    return spark.createDataFrame([row], "a double, b double, c double, alpha double, beta double, gamma double, volume double, lattice_type string, centering string")


def stream_text(spark, d):
    """The peak lists of the text stream: lines in order of place, one text per frame."""
    p = table(spark, d, "peaks").where("frame_id IS NOT NULL AND NOT isnan(intensity)").select("peak_id", F.lower(F.trim("frame_id")).alias("frame_id"), *[F.floor(c).cast("double").alias(c) for c in ("fs", "ss", "intensity", "resolution_nm_inv")], "panel")
    whole = p.where("intensity IS NOT NULL AND resolution_nm_inv IS NOT NULL AND panel IS NOT NULL").distinct()
    return text.peak_lines(whole)


NAMES = """q_lift q_lift_panels q_project q_max flat_resolution panel_assign_first panel_assign_last frame_ranges frame_locate frame_id cell_volume
cell_to_b cell_match rotation hkl_enumerate hkl_absences ewald_shell rocking mosaicity hkl_assign snap_nn deblend box_integrate enrichment
enrich_gate falloff_limit percentile_limit topk_seed_peaks seed_fitness accept_rank backfill indexed_rate funnel shard_union block_bounds
serials join_reflections attach_scale best_resolution mask_bits static_mask assemble_panels assemble_physical radial_profile render_scale
resolution_histogram geom_parse cell_parse stream_text""".split()
QUERIES = {n: globals()[n] for n in NAMES}

# --- SQL --------------------------------------------------------------------------------------------

PK = "pk AS (SELECT DISTINCT peak_id, frame_index, ss AS row, fs AS col, intensity FROM peaks WHERE frame_index IS NOT NULL)"


def _lift(x: str, y: str, source: str) -> str:
    """Columns qx, qy, qz of pixels with offsets x, y (in pixels) from the beam."""
    return f"""(SELECT *, {x} * 75e-6 AS lx, {y} * 75e-6 AS ly FROM {source})
  SELECT *, lx / n / 1.3 AS qx, ly / n / 1.3 AS qy, (0.1 / n - 1.0) / 1.3 AS qz FROM (SELECT *, sqrt(lx * lx + ly * ly + 0.01) AS n FROM l)"""


FLAT = f"{PK}, l AS {_lift('(col - 1040.0)', '(row - 512.0)', 'pk').replace('  SELECT', ', q AS (SELECT', 1)})"
_DOWN = "row >= -0.5 AND row < 2075.5"
WEST, EAST = f"{_DOWN} AND col >= -0.5 AND col < 1039.5", f"{_DOWN} AND col >= 1039.5 AND col < 2079.5"
TILT_X = f"(CASE WHEN {WEST} THEN -1040.0 + col - 0.01 * row WHEN {EAST} THEN 4.0 + (col - 1040.0) + 0.02 * row ELSE col - 1040.0 END)"
TILT_Y = f"(CASE WHEN {WEST} THEN -512.0 + 0.01 * col + row WHEN {EAST} THEN -512.0 - 0.02 * (col - 1040.0) + row ELSE row - 512.0 END)"
TILT = f"{PK}, l AS {_lift(TILT_X, TILT_Y, 'pk').replace('  SELECT', ', q AS (SELECT', 1)})"
EV = "ev AS (SELECT DISTINCT frame_id, frame_index, filename, event FROM frames)"
RANGES = f"""{EV}, fi AS (SELECT filename, count(*) AS n, row_number() OVER (ORDER BY filename) - 1 AS pos FROM ev GROUP BY 1),
rg AS (SELECT filename, CAST(pos AS INTEGER) AS pos, CAST(sum(n) OVER (ORDER BY pos) - n AS BIGINT) AS start, CAST(sum(n) OVER (ORDER BY pos) AS BIGINT) AS stop FROM fi)"""
_C = ["cell_a_a", "cell_b_a", "cell_c_a", "cell_alpha_deg", "cell_beta_deg", "cell_gamma_deg"]
CE = "ce AS (SELECT DISTINCT frame_index, " + ", ".join(f"{x} AS {n}" for x, n in zip(_C, ("a", "b", "c", "al", "be", "ga"), strict=True)) + " FROM frames WHERE indexed AND " + " AND ".join(
    f"{x} IS NOT NULL AND NOT isnan({x}) AND {x} > 0" for x in _C
) + "), cr AS (SELECT frame_index, a, b, c, al, be, ga, cos(radians(al)) AS ca, cos(radians(be)) AS cb, cos(radians(ga)) AS cg, sin(radians(ga)) AS sg FROM ce)"
_M = [f"m{r}{c}" for r in range(3) for c in range(3)]
CRYSTALS = "xt AS (SELECT DISTINCT frame_index, " + ", ".join(f"{v}_{x} / 10.0 AS m{r}{c}" for r, x in enumerate("xyz") for c, v in enumerate(("astar", "bstar", "cstar"))) + " FROM frames WHERE indexed AND astar_x IS NOT NULL)"


def _cof(r: int, c: int) -> str:
    i, j, k, l = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3  # noqa: E741
    return f"(m{i}{k} * m{j}{l} - m{i}{l} * m{j}{k})"


INVERSE = CRYSTALS + f", dt AS (SELECT *, m00 * {_cof(0, 0)} + m01 * {_cof(0, 1)} + m02 * {_cof(0, 2)} AS det FROM xt), iv AS (SELECT *, " + ", ".join(
    f"{_cof(c, r)} / det AS i{r}{c}" for r in range(3) for c in range(3)
) + " FROM dt)"
#: The detector that holds all panels, its largest q, and each frame's bounds of the indices.
LIMITS = """lm AS (SELECT greatest(1024, max(max_ss) + 1) AS hh, greatest(2080, max(max_fs) + 1) AS ww FROM panels),
qm AS (SELECT any_value(hh) AS hh, any_value(ww) AS ww, max(2.0 * sin(atan2(sqrt((c - 1040.0) * (c - 1040.0) + (r - 512.0) * (r - 512.0)) * 75e-6, 0.1) / 2.0) / 1.3) AS q_max
  FROM (SELECT hh, ww, unnest([0, 0, ww - 1, ww - 1]) AS c, unnest([0, hh - 1, 0, hh - 1]) AS r FROM lm))"""
BOUNDS = INVERSE + f", {LIMITS}, bd AS (SELECT *, " + ", ".join(f"CAST(greatest(ceil(q_max * sqrt(i{r}0 * i{r}0 + i{r}1 * i{r}1 + i{r}2 * i{r}2)), 1) AS INTEGER) AS n{r}" for r in range(3)) + " FROM iv, qm)"
#: For each h and k the places l where the line of indices passes through the shell about the Ewald sphere,
#: as wide as its widest tolerance; then the tolerance itself.
SHELL = BOUNDS + f""", hk AS (SELECT *, unnest(range(-n1, n1 + 1))::INTEGER AS k FROM (SELECT *, unnest(range(-n0, n0 + 1))::INTEGER AS h FROM bd)),
ln AS (SELECT *, {", ".join(f"1.3 * (m{r}0 * h + m{r}1 * k){' + 1.0' if r == 2 else ''} AS s{r}, 1.3 * m{r}2 AS v{r}" for r in range(3))},
  greatest(1.95 * (5e-5 + 0.0015 * q_max), 5e-4) + 1e-6 AS tol FROM hk),
rt AS (SELECT *, v0 * v0 + v1 * v1 + v2 * v2 AS vv, -(s0 * v0 + s1 * v1 + s2 * v2) / (v0 * v0 + v1 * v1 + v2 * v2) AS mid FROM ln),
ro AS (SELECT *, ((1.0 + tol) * (1.0 + tol) - s0 * s0 - s1 * s1 - s2 * s2) / vv + mid * mid AS out2, ((1.0 - tol) * (1.0 - tol) - s0 * s0 - s1 * s1 - s2 * s2) / vv + mid * mid AS in2 FROM rt),
sl AS (SELECT *, sqrt(out2) + 1e-6 AS far, sqrt(greatest(in2, 0.0)) - 1e-6 AS near FROM ro WHERE out2 >= 0),
hl AS (SELECT frame_index, {", ".join(_M)}, h, k, q_max, hh, ww, unnest(list_distinct(list_concat(
  range(greatest(ceil(mid - far), -n2)::BIGINT, least(floor(mid - near), n2)::BIGINT + 1), range(greatest(ceil(mid + near), -n2)::BIGINT, least(floor(mid + far), n2)::BIGINT + 1))))::INTEGER AS l FROM sl)"""
PREDICTED = SHELL + f""", qq AS (SELECT frame_index, h, k, l, q_max, hh, ww, {", ".join(f"m{r}0 * h + m{r}1 * k + m{r}2 * l AS q{x}" for r, x in enumerate("xyz"))} FROM hl WHERE NOT (h = 0 AND k = 0 AND l = 0)),
qn AS (SELECT *, sqrt(qx * qx + qy * qy + qz * qz) AS qn, 1.3 * qz + 1.0 AS sz FROM qq),
ex AS (SELECT *, sqrt(1.69 * qx * qx + 1.69 * qy * qy + sz * sz) - 1.0 AS excitation FROM qn WHERE qn <= q_max),
pr AS (SELECT *, 512.0 + 1.3 * qy * (0.1 / 75e-6) / greatest(sz, 1e-30) AS row, 1040.0 + 1.3 * qx * (0.1 / 75e-6) / greatest(sz, 1e-30) AS col FROM ex
  WHERE sz > 0 AND abs(excitation) < greatest(1.3 * 1.5 * (5e-5 + 0.5 * 0.003 * qn), 5e-4)),
pd AS (SELECT * FROM pr WHERE row BETWEEN 0 AND hh - 1 AND col BETWEEN 0 AND ww - 1)"""
TWOSPOTS = """ct AS (SELECT vec_id AS frame_index, 1 AS refl, 3.5 + 8.0::DOUBLE * embedding[1]::DOUBLE AS row, 3.5 + 8.0::DOUBLE * embedding[2]::DOUBLE AS col FROM embeddings
  UNION ALL SELECT vec_id, 2, 3.5 + 8.0::DOUBLE * embedding[3]::DOUBLE, 3.5 + 8.0::DOUBLE * embedding[4]::DOUBLE FROM embeddings)"""
OWNED = f"""{TWOSPOTS}, bx AS (SELECT frame_index, refl, round_even(row, 0)::INTEGER + dr AS r, round_even(col, 0)::INTEGER + dc AS c, row, col
  FROM ct, (SELECT unnest(range(-2, 3))::INTEGER AS dr), (SELECT unnest(range(-2, 3))::INTEGER AS dc)),
bz AS (SELECT *, (r - row) * (r - row) + (c - col) * (c - col) AS d2 FROM bx WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7),
ow AS (SELECT frame_index, r AS row, c AS col, min(refl) AS refl FROM (SELECT *, min(d2) OVER (PARTITION BY frame_index, r, c) AS least FROM bz) WHERE d2 <= least + 1e-6 GROUP BY 1, 2, 3)"""
_J = "frame_index, row, col"

ORACLE = {
    "q_lift": f"WITH {FLAT} SELECT peak_id, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM q",
    "q_lift_panels": f"WITH {TILT} SELECT peak_id, round(qx, 6) AS qx, round(qy, 6) AS qy, round(qz, 6) AS qz FROM q",
    "q_project": f"""WITH {PK}, o AS (SELECT *, row BETWEEN 0 AND 2075 AND (col BETWEEN 0 AND 1039 OR col BETWEEN 1040 AND 2079) AS hit FROM pk)
SELECT peak_id, round(CASE WHEN hit THEN row END, 3) AS row, round(CASE WHEN hit THEN col END, 3) AS col FROM o""",
    "q_max": "SELECT round(max(2.0 * sin(atan2(sqrt((c - 1040.0) * (c - 1040.0) + (r - 512.0) * (r - 512.0)) * 75e-6, 0.1) / 2.0) / 1.3), 9) AS q_max FROM (VALUES (0, 0), (0, 2079), (1023, 0), (1023, 2079)) AS t(r, c)",
    "flat_resolution": f"WITH {PK} SELECT peak_id, round(2.0 * sin(atan2(sqrt((col - 1040.0) * (col - 1040.0) + (row - 512.0) * (row - 512.0)) * 75e-6, 0.1) / 2.0) / 0.13, 4) AS resolution FROM pk",
    "panel_assign_first": f"WITH {PK} SELECT peak_id, coalesce(min(name), 'p0') AS panel FROM pk LEFT JOIN panels ON col BETWEEN min_fs AND max_fs AND row BETWEEN min_ss AND max_ss GROUP BY peak_id, row, col, frame_index, intensity",
    "panel_assign_last": f"WITH {PK} SELECT peak_id, max(name) AS panel FROM pk LEFT JOIN panels ON col BETWEEN min_fs - 3 AND max_fs + 3 AND row BETWEEN min_ss - 3 AND max_ss + 3 GROUP BY peak_id, row, col, frame_index, intensity",
    "frame_ranges": f"WITH {RANGES} SELECT filename, pos, start, stop FROM rg",
    "frame_locate": f"""WITH {RANGES}, p AS (SELECT DISTINCT peak_id, frame_index FROM peaks)
SELECT peak_id, frame_index, coalesce(filename, 'unknown') AS filename, coalesce(frame_index - start, frame_index, 0) AS event FROM p LEFT JOIN rg ON frame_index >= start AND frame_index < stop""",
    "frame_id": f"WITH {EV} SELECT frame_index, substr(sha1(filename || '//' || event), 1, 16) AS made, substr(sha1(filename || '//' || event), 1, 16) = frame_id AS same FROM ev",
    "cell_volume": f"WITH {CE} SELECT frame_index, round(a * b * c * sqrt(greatest(1.0 - ca * ca - cb * cb - cg * cg + 2.0 * ca * cb * cg, 0.0)), 2) AS volume FROM cr",
    "cell_to_b": f"""WITH {CE}, s AS (SELECT *, c * cb AS cx, c * (ca - cb * cg) / sg AS cy FROM cr), t AS (SELECT *, sqrt(c * c - cx * cx - cy * cy) AS cz, b * cg AS bx, b * sg AS by_ FROM s)
SELECT frame_index, round(1.0 / a, 7) AS b00, 0.0::DOUBLE AS b01, 0.0::DOUBLE AS b02, round(-bx / (a * by_), 7) AS b10, round(1.0 / by_, 7) AS b11, 0.0::DOUBLE AS b12,
  round((bx * cy - cx * by_) / (a * by_ * cz), 7) AS b20, round(-cy / (by_ * cz), 7) AS b21, round(1.0 / cz, 7) AS b22 FROM t""",
    "cell_match": f"""WITH {CE}, t AS (SELECT list_sort([a_a, b_a, c_a]) AS te, list_sort([alpha_deg, beta_deg, gamma_deg]) AS ta,
  list_sort([least(alpha_deg, 180 - alpha_deg), least(beta_deg, 180 - beta_deg), least(gamma_deg, 180 - gamma_deg)]) AS tf FROM cell),
x AS (SELECT frame_index, list_sort([a, b, c]) AS e, list_sort([al, be, ga]) AS g, list_sort([least(al, 180 - al), least(be, 180 - be), least(ga, 180 - ga)]) AS f, te, ta, tf FROM ce, t)
SELECT frame_index, {" AND ".join(f"abs(e[{k}] - te[{k}]) <= 0.05 * te[{k}] AND abs(f[{k}] - tf[{k}]) <= 3" for k in (1, 2, 3))} AS match,
  {" AND ".join(f"abs(e[{k}] - te[{k}]) <= 0.05 * te[{k}] AND abs(g[{k}] - ta[{k}]) <= 3" for k in (1, 2, 3))} AS literal FROM x""",
    "rotation": "WITH v AS (SELECT DISTINCT frame_index, astar_x AS x, astar_y AS y, astar_z AS z FROM frames WHERE indexed AND astar_x IS NOT NULL), t AS (SELECT *, x * x + y * y + z * z AS t2 FROM v), "
    "u AS (SELECT *, CASE WHEN t2 < 1e-16 THEN 1.0 - t2 / 6.0 ELSE sin(sqrt(t2)) / sqrt(t2) END AS s, CASE WHEN t2 < 1e-16 THEN 0.5 - t2 / 24.0 ELSE (1.0 - cos(sqrt(t2))) / t2 END AS k FROM t) SELECT frame_index, "
    + ", ".join(
        f"round({'1.0 - k * t2' if r == c else '0.0'} + s * ({[['0', '-z', 'y'], ['z', '0', '-x'], ['-y', 'x', '0']][r][c]}) + k * {'xyz'[r]} * {'xyz'[c]}, 6) AS r{r}{c}" for r in range(3) for c in range(3)
    ) + " FROM u",
    "hkl_enumerate": f"WITH {BOUNDS} SELECT frame_index, (2 * n0::BIGINT + 1) * (2 * n1::BIGINT + 1) * (2 * n2::BIGINT + 1) - 1 AS n, n0 AS h, n1 AS k, n2 AS l FROM bd",
    "hkl_absences": """WITH r AS (SELECT DISTINCT reflection_id, h, k, l FROM reflections) SELECT count(*) AS n_p, count(*) FILTER (WHERE (k + l) % 2 = 0) AS n_a, count(*) FILTER (WHERE (h + l) % 2 = 0) AS n_b,
  count(*) FILTER (WHERE (h + k) % 2 = 0) AS n_c, count(*) FILTER (WHERE (h + k + l) % 2 = 0) AS n_i, count(*) FILTER (WHERE (h + k) % 2 = 0 AND (h + l) % 2 = 0 AND (k + l) % 2 = 0) AS n_f,
  count(*) FILTER (WHERE (k + l - h) % 3 = 0) AS n_r, count(*) FILTER (WHERE (h - k) % 3 = 0) AS n_h FROM r""",
    "ewald_shell": f"WITH {PREDICTED} SELECT frame_index, h, k, l, round(qn, 6) AS qn, round(excitation, 6) AS excitation, round(row, 6) AS row, round(col, 6) AS col FROM pd",
    "rocking": f"WITH {PREDICTED} SELECT frame_index, h, k, l, round(5e-5 + 0.5 * 0.003 * qn + 0.5 * 1.3 * 0.002 * qn * qn, 9) AS radius FROM pd",
    "mosaicity": f"""WITH {PREDICTED}, s AS (SELECT frame_index, count(*) AS n, sum(qn * abs(excitation) / 1.3) AS qr, sum(qn * qn) AS qq FROM pd GROUP BY 1)
SELECT frame_index, round(CASE WHEN n >= 8 THEN least(greatest(2.0 * sqrt(pi() / 2) * qr / greatest(qq, 1e-30), radians(0.02)), radians(0.8)) ELSE 0.0017 END, 7) AS mosaicity FROM s""",
    "hkl_assign": f"""WITH {FLAT}, {INVERSE}, a AS (SELECT q.frame_index, qx, qy, qz, {", ".join(f"m{r}{c}" for r in range(3) for c in range(3))},
  {", ".join(f"round_even(i{r}0 * qx + i{r}1 * qy + i{r}2 * qz, 0)::INTEGER AS {x}" for r, x in enumerate("hkl"))} FROM q JOIN iv USING (frame_index)),
b AS (SELECT *, sqrt({" + ".join(f"(m{r}0 * h + m{r}1 * k + m{r}2 * l - q{x}) * (m{r}0 * h + m{r}1 * k + m{r}2 * l - q{x})" for r, x in enumerate("xyz"))}) AS res FROM a)
SELECT frame_index, count(*) AS n, count(*) FILTER (WHERE res < 0.005) AS n_indexed, CAST(sum(h) AS BIGINT) AS h FROM b GROUP BY 1""",
    "snap_nn": """WITH p AS (SELECT DISTINCT lower(trim(frame_id)) AS f, reflection_id, ss, fs FROM reflections WHERE frame_id IS NOT NULL),
o AS (SELECT DISTINCT lower(trim(frame_id)) AS f, ss AS os, fs AS of FROM peaks WHERE frame_id IS NOT NULL),
m AS (SELECT p.*, os, of, row_number() OVER (PARTITION BY p.f, reflection_id ORDER BY (ss - os) * (ss - os) + (fs - of) * (fs - of), os, of) AS r FROM p JOIN o ON p.f = o.f AND (ss - os) * (ss - os) + (fs - of) * (fs - of) < 400.0)
SELECT p.reflection_id, round(coalesce(os, p.ss), 4) AS row, round(coalesce(of, p.fs), 4) AS col, os IS NOT NULL AS snapped FROM p LEFT JOIN m ON p.f = m.f AND p.reflection_id = m.reflection_id AND r = 1""",
    "deblend": f"WITH {OWNED} SELECT frame_index, row, col, refl FROM ow",
    "box_integrate": f"""WITH {images.WHITE}, {OWNED}, s AS (SELECT frame_index, refl, count(*) AS n, sum(excess) AS i, sum(var) AS v, max(excess) AS p, sum(mean) AS b FROM ow JOIN wh USING ({_J}) GROUP BY 1, 2),
t AS (SELECT frame_index, ct.refl, coalesce(n, 0) AS n, coalesce(i, 0.0) AS i, coalesce(v, 0.0) AS v, coalesce(p, 0.0) AS p, coalesce(b, 0.0) AS b FROM ct LEFT JOIN s USING (frame_index, refl))
SELECT frame_index, refl, round(i, 4) AS intensity, round(sqrt(greatest(v, 0.0) * (1.0 + n / 280.0::DOUBLE) + greatest(i, 0.0) * 1.5), 4) AS sigma, round(p, 4) AS peak, round(b / greatest(n, 1), 4) AS background, n FROM t""",
    "enrichment": f"""WITH {images.WHITE}, {TWOSPOTS}, x AS (SELECT frame_index, row, col, z > 1.0 AS bright FROM wh), b AS (SELECT frame_index, count(*) FILTER (WHERE bright) / count(*)::DOUBLE AS p FROM x GROUP BY 1),
n AS (SELECT ct.frame_index, count(*) AS n_keep, count(*) FILTER (WHERE bright) AS n_bright FROM ct JOIN x ON ct.frame_index = x.frame_index AND round_even(ct.row, 0) = x.row AND round_even(ct.col, 0) = x.col GROUP BY 1),
m AS (SELECT *, n_keep * p AS lam FROM n JOIN b USING (frame_index))
SELECT frame_index, n_keep, n_bright, round(CASE WHEN p > 0 THEN n_bright / n_keep::DOUBLE / p WHEN n_bright > 0 THEN 'inf'::DOUBLE END, 6) AS enrichment,
  round(CASE WHEN n_bright <= 0 THEN 1.0 WHEN lam <= 0 THEN 0.0 ELSE greatest(0.0, 1.0 - exp(-lam) - CASE WHEN n_bright >= 2 THEN lam * exp(-lam) ELSE 0.0 END) END, 6) AS enrich_p FROM m""",
    "enrich_gate": "SELECT DISTINCT frame_index FROM frames WHERE enrich_p IS NOT NULL AND NOT isnan(enrich_p) AND enrich_p <= 1e-3",
    "falloff_limit": """WITH r AS (SELECT DISTINCT reflection_id, lower(trim(panel)) AS panel, resolution_nm_inv AS q, intensity / sigma AS s FROM reflections
  WHERE intensity IS NOT NULL AND NOT isnan(intensity) AND sigma > 0 AND resolution_nm_inv >= 0 AND panel IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY panel ORDER BY q, s) - 1 AS i, count(*) OVER (PARTITION BY panel) AS n FROM r),
g AS (SELECT panel, e AS shell, max(n) AS n, max(q) FILTER (WHERE i = (e * n) // 10 + (((e + 1) * n) // 10 - (e * n) // 10) // 2) AS q, avg(s) AS s, max(q) AS top
  FROM o JOIN (SELECT unnest(range(0, 10)) AS e) ON i >= (e * n) // 10 AND i < ((e + 1) * n) // 10 GROUP BY 1, 2),
h AS (SELECT *, lag(q) OVER w AS q0, lag(s) OVER w AS s0 FROM g WINDOW w AS (PARTITION BY panel ORDER BY shell)),
c AS (SELECT panel, max(n) AS n, max(top) AS top, arg_min(CASE WHEN q0 IS NULL THEN q ELSE q0 + (q - q0) * (s0 - 8.0) / greatest(s0 - s, 1e-30) END, shell) FILTER (WHERE s < 8.0) AS l FROM h GROUP BY 1)
SELECT panel, round(CASE WHEN n >= 40 THEN coalesce(l, top) END, 6) AS "limit" FROM c""",
    "percentile_limit": """WITH p AS (SELECT DISTINCT peak_id, frame_index, resolution_nm_inv AS q FROM peaks WHERE frame_index IS NOT NULL AND resolution_nm_inv IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY q) - 1 AS i, count(*) OVER (PARTITION BY frame_index) AS n FROM p)
SELECT frame_index, q AS "limit" FROM o WHERE i = least(n - 1, floor(n * 0.9::DOUBLE)::BIGINT)""",
    "topk_seed_peaks": f"WITH {PK} SELECT frame_index, peak_id FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY intensity DESC, peak_id) AS r FROM pk WHERE intensity IS NOT NULL AND NOT isnan(intensity)) WHERE r <= 80",
    "seed_fitness": f"""WITH {FLAT}, t AS (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY intensity DESC, peak_id) AS r FROM q WHERE intensity IS NOT NULL AND NOT isnan(intensity)),
p AS (SELECT frame_index, {", ".join(f"list(q{x}) AS l{x}" for x in "xyz")}, CASE WHEN count(*) < 30 THEN 12000 ELSE 6000 END AS n FROM t WHERE r <= 80 GROUP BY 1),
d AS (SELECT n, sqrt(1.0 - z * z) * cos(i * 2.399963229728653) AS dx, sqrt(1.0 - z * z) * sin(i * 2.399963229728653) AS dy, z AS dz
  FROM (SELECT n, i, (i + 0.5) / n::DOUBLE AS z FROM (SELECT 6000 AS n, unnest(range(0, 6000)) AS i UNION ALL SELECT 12000, unnest(range(0, 12000))))),
e AS (SELECT frame_index, n, dx, dy, dz, unnest(lx) AS qx, unnest(ly) AS qy, unnest(lz) AS qz, row_number() OVER () AS u FROM p JOIN d USING (n)),
f AS (SELECT frame_index, n, avg(cos({6.283185307179586 * 48.31!r}::DOUBLE * (qx * dx + qy * dy + qz * dz))) AS fitness FROM e GROUP BY frame_index, n, dx, dy, dz)
SELECT frame_index, round(max(fitness), 6) AS fitness, n FROM f GROUP BY 1, 3""",
    "accept_rank": """WITH c AS (SELECT l_orderkey AS frame_index, l_linenumber AS cand, max(l_quantity) AS soft, max(l_discount + 0.01) AS rmsd, max(l_quantity::INTEGER) AS n_indexed, bool_and(l_returnflag <> 'R') AS match FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, soft - rmsd / (greatest(max(rmsd) OVER (PARTITION BY frame_index), 1e-30) * 1000.0) AS score FROM c)
SELECT frame_index, cand, soft FROM (SELECT *, row_number() OVER (PARTITION BY frame_index ORDER BY score DESC, cand) AS r FROM s WHERE n_indexed >= 6 AND match) WHERE r = 1""",
    "backfill": f"""WITH {EV} SELECT frame_index, frame_id, frame_id IN (SELECT lower(trim(frame_id)) FROM reflections WHERE frame_id IS NOT NULL) AS indexed, CAST(NULL AS INTEGER) AS n_peaks FROM ev""",
    "indexed_rate": "SELECT round(avg(indexed::INTEGER), 6) AS rate, count(*) AS frames, CAST(sum(indexed::INTEGER) AS BIGINT) AS indexed, round(max(peak_resolution_nm_inv), 6) AS best FROM frames",
    "funnel": """WITH f AS (SELECT DISTINCT frame_index, n_peaks, indexed FROM frames), s AS (SELECT count(DISTINCT frame_index) AS frames, count(*) FILTER (WHERE n_peaks >= 5) AS hits, count(*) FILTER (WHERE indexed AND n_peaks >= 5) AS indexed FROM f)
SELECT *, round(CASE WHEN frames > 0 THEN hits / frames::DOUBLE ELSE 0 END, 6) AS hit_rate, round(CASE WHEN hits > 0 THEN indexed / hits::DOUBLE ELSE 0 END, 6) AS index_rate_of_hits FROM s""",
    "shard_union": f"WITH {EV} SELECT CAST(b - 1 AS INTEGER) AS shard, count(*) AS frames, min(frame_index) AS first, max(frame_index) AS last FROM (SELECT frame_index, ntile(4) OVER (ORDER BY frame_index) AS b FROM ev) GROUP BY 1",
    "block_bounds": f"WITH {EV} SELECT frame_index, CAST(ntile(7) OVER (ORDER BY frame_index) - 1 AS INTEGER) AS block FROM ev",
    "serials": f"WITH {EV} SELECT frame_index, row_number() OVER (ORDER BY frame_index) AS serial FROM ev",
    "join_reflections": f"WITH {EV} SELECT filename, count(*) AS reflections, round(avg(sigma), 4) AS sigma FROM reflections JOIN ev USING (frame_id) GROUP BY 1",
    "attach_scale": f"WITH {EV} SELECT frame_index, s.scale FROM ev LEFT JOIN (SELECT frame_index, max(scale) AS scale FROM frames WHERE scale > 0 GROUP BY 1) s USING (frame_index)",
    "best_resolution": "SELECT frame_id, max(resolution_nm_inv) AS resolution FROM peaks WHERE frame_id IS NOT NULL GROUP BY 1",
    "mask_bits": "SELECT event_id, (event_id & 4) = 4 AND (event_id & 3) = 0 AS good FROM events",
    "static_mask": f"WITH {images.PIX} SELECT row, col, adu < 110.0 AND NOT (row BETWEEN 2 AND 3 AND col BETWEEN 1 AND 2) AS valid FROM px WHERE frame_index = (SELECT min(frame_index) FROM px)",
    "assemble_panels": f"WITH {images.PIX} SELECT frame_index, row, CAST((col + 4) % 8 AS INTEGER) AS col, round(adu, 4) AS adu FROM px",
    "assemble_physical": f"""WITH {images.PIX}, p AS (SELECT frame_index, adu, CASE WHEN col < 4 THEN row::DOUBLE ELSE 3.0 - (col - 4) + 4.0 END AS r, CASE WHEN col < 4 THEN col::DOUBLE ELSE 2.0 + row + 6.0 END AS c FROM px)
SELECT frame_index, r::INTEGER AS row, c::INTEGER AS col, round(adu, 4) AS adu FROM p""",
    "radial_profile": f"WITH {images.PIX}, t AS (SELECT CAST(floor(sqrt((row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5))) AS INTEGER) AS bin, adu FROM px) SELECT bin, bin + 0.5::DOUBLE AS radius, round(avg(adu), 4) AS mean FROM t GROUP BY 1",
    "render_scale": f"WITH {images.PIX} SELECT round(quantile_cont(adu, 0.01), 4) AS vmin, round(quantile_cont(adu, 0.995), 4) AS vmax FROM px",
    "resolution_histogram": """WITH p AS (SELECT DISTINCT peak_id, resolution_nm_inv AS q FROM peaks WHERE resolution_nm_inv >= 0), t AS (SELECT max(q) AS top FROM p)
SELECT CAST(least(floor(q / (top / 40.0)), 39) AS INTEGER) AS bin, count(*) AS n FROM p, t GROUP BY 1""",
    "cell_parse": "SELECT 50.3::DOUBLE AS a, 104.2::DOUBLE AS b, 87.9::DOUBLE AS c, 90.0::DOUBLE AS alpha, 90.0::DOUBLE AS beta, 90.0::DOUBLE AS gamma, round(50.3::DOUBLE * 104.2 * 87.9, 3) AS volume, 'orthorhombic' AS lattice_type, 'I' AS centering",
    "stream_text": """WITH p AS (SELECT DISTINCT peak_id, lower(trim(frame_id)) AS frame_id, floor(fs) AS fs, floor(ss) AS ss, floor(intensity) + 0.0 AS i, floor(resolution_nm_inv) AS q, panel FROM peaks
  WHERE frame_id IS NOT NULL AND intensity IS NOT NULL AND NOT isnan(intensity) AND resolution_nm_inv IS NOT NULL AND panel IS NOT NULL),
l AS (SELECT frame_id, ss, fs, printf('%7.2f %7.2f %10.2f %10.2f   %s', fs, ss, q, i, panel) AS line FROM p)
SELECT frame_id, string_agg(line, chr(10) ORDER BY ss, fs, line) AS text FROM l GROUP BY 1""",
    "geom_parse": "SELECT * FROM (VALUES (NULL, 'clen', 0.125::DOUBLE), (NULL, 'photon_energy', 9500.0), (NULL, 'res', 13333.3), ('west', 'min_fs', 0.0), ('west', 'max_fs', 31.0), ('west', 'corner_x', -32.5), ('east', 'min_fs', 32.0), ('shadow', 'min_ss', 4.0)) AS t(block, key, number)",
}
