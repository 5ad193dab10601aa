"""Queries of the image operators: noise, stencils, scoring, components, blobs and calibration.

The supplied tables hold no images, so ``embeddings`` stand in: 64 numbers are an 8 x 8 frame with
pixels 100 + 80 e, and ``events`` a stream of values per pixel (user) in time order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import scoring
from lumenframe.functions.geometry import Panel
from lumenframe.operators import blobs, calibrate, noise, stencil
from lumenframe.session import table

H = W = 8
SEED = 32
TILES = (Panel("t0", 0, 3, 0, 7), Panel("t1", 4, 7, 0, 7))
HOT = 1.2


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("frame_index"), F.transform("embedding", lambda x: F.lit(100.0) + F.lit(80.0) * x.cast("double")).alias("pixels"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    return noise.pixels_of(frames(spark, d), width=W)


def seed(spark: SparkSession, d: str) -> DataFrame:
    return pixels(spark, d).where(F.col("frame_index") < SEED)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def rounded_as_sql(df: DataFrame, digits: int) -> DataFrame:
    """``rounded`` for results of very many rows: the scaled number goes to the nearest whole one, halves away from 0, as
    in DuckDB's round. Spark's own goes by the decimal text of each number, at some twenty times the cost."""

    def near(c: str):
        x = F.col(c) * F.lit(10.0**digits)
        whole = F.rint(x)
        return (F.when(F.abs(x - whole) == 0.5, x + F.signum(x) * 0.5).otherwise(whole) / F.lit(10.0**digits) + F.lit(0.0)).alias(c)  # + 0.0: no negative zero

    return df.select(*[near(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def whitened(spark: SparkSession, d: str) -> DataFrame:
    """Every pixel with excess, variance and z against the seed's pixel statistics."""
    stats = noise.pixel_stats(seed(spark, d)).select("row", "col", "mean", "var")
    both = pixels(spark, d).join(F.broadcast(stats), ["row", "col"])  # one row per detector pixel
    return both.withColumn("excess", F.col("adu") - F.col("mean")).withColumn("z", scoring.z_score(F.col("adu"), F.col("mean"), F.col("var")))


def noise_pixel_stats(spark, d):
    return rounded(noise.pixel_stats(pixels(spark, d)))


def noise_radial(spark, d):
    return rounded(noise.radial_stats(pixels(spark, d), H, W))


def noise_panel(spark, d):
    return rounded(noise.panel_stats(pixels(spark, d), TILES))


def noise_panel_clipped(spark, d):
    """Panel statistics of the seed, of values clipped before they are learned, as calibration takes them."""
    keyed = seed(spark, d).withColumn("pix", F.col("row") * W + F.col("col"))
    x = noise.clipped_values(keyed, "pix", ["frame_index"], "adu", k=2.0)
    px = x.select("frame_index", F.floor(F.col("pix") / W).cast("int").alias("row"), (F.col("pix") % W).cast("int").alias("col"), F.col("x").alias("adu"))
    return rounded(noise.panel_stats(px, TILES))


def beamstop_hist(spark, d):
    """Counts of bright pixels and of all pixels of a frame in 40 equal bins of their distance from the centre."""
    r = lambda: F.sqrt((F.col("row") - 3.5) ** 2 + (F.col("col") - 3.5) ** 2)
    top = 24.5**0.5
    which = F.least(F.floor(r() / F.lit(top / 40)), F.lit(39)).cast("int")
    hot = whitened(spark, d).where("z > 2.5").groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("peaks"))
    all_ = pixels(spark, d).select("row", "col").distinct().groupBy(which.alias("bin")).agg(F.count(F.lit(1)).alias("pixels"))
    return all_.join(hot, "bin", "left").select("bin", F.coalesce("peaks", F.lit(0)).alias("peaks"), "pixels")


def noise_robust_fold(spark, d):
    return rounded(noise.robust_fold(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"))


def noise_ewma_fold(spark, d):
    return rounded(noise.ewma_fold(table(spark, d, "events"), "event_type", ["ts", "event_id"], "value"))


def noise_frame_mode(spark, d):
    return rounded(noise.frame_stats(table(spark, d, "events"), "user_id", ["ts", "event_id"], "value"))


def noise_dead_mask(spark, d):
    return noise.dead_mask(pixels(spark, d))


def noise_running(spark, d):
    return rounded(noise.running_stats(pixels(spark, d)))


def noise_drift(spark, d):
    # Against the zero state before the first record the divergence is astronomical: take its logarithm.
    got = noise.drift(pixels(spark, d))
    return rounded(got.withColumn("kl_log1p", F.log1p("kl_gaussian")).drop("kl_gaussian"))


def noise_shrinkage_z(spark, d):
    return rounded(noise.shrunk_background(pixels(spark, d), 8, H, W).select("frame_index", "row", "col", "mean", "z"))


def box_sum(spark, d):
    return rounded(stencil.box_sum(pixels(spark, d), {"s": F.col("adu")}, 2))


def annulus_background(spark, d):
    x = whitened(spark, d).withColumn("x", F.col("excess"))
    got = stencil.annulus_background(x, inner=1, outer=3)
    return rounded(got.select("frame_index", "row", "col", "local_count", "local_mean", "local_var"))


def gaussian_smooth(spark, d):
    return rounded(stencil.gaussian_mean(pixels(spark, d), "adu", 5, 1.0, H, W))


def matched_filter(spark, d):
    return rounded(stencil.matched_filter(whitened(spark, d), "z", [0.6, 1.0], H, W))


def local_maxima(spark, d):
    return rounded(stencil.local_maxima(whitened(spark, d).where("z IS NOT NULL"), "z").select("frame_index", "row", "col", "z"))


def dilation(spark, d):
    return stencil.box_max(whitened(spark, d), {"bright": F.when(F.col("z") > 2.5, 1).otherwise(0)}, 2).select("frame_index", "row", "col", "bright")


def _scored(spark, d):
    """Log Bayes factor and smoothed posterior of every pixel."""
    w = whitened(spark, d).withColumn("log_bf", scoring.log_bayes_factor(F.col("z")))
    w = w.withColumn("logit", F.col("log_bf") + scoring.prior_log_odds())
    smooth = stencil.gaussian_mean(w, "logit", 5, 1.0, H, W)
    return w.join(smooth, ["frame_index", "row", "col"]).withColumn("posterior", scoring.sigmoid(F.col("smooth")))


def score_posterior(spark, d):
    return rounded(_scored(spark, d).select("frame_index", "row", "col", "excess", "z", "log_bf", "posterior"))


def _labelled(spark, d):
    return blobs.label_components(_scored(spark, d).where(F.col("z") > HOT), W)


def components(spark, d):
    return _labelled(spark, d).groupBy("frame_index", "label").agg(F.count(F.lit(1)).alias("size"))


def blob_stats(spark, d):
    return rounded(blobs.blob_stats(_labelled(spark, d)).withColumn("eccentricity", scoring.finite_or_null(F.col("eccentricity"))))


def peaks(spark, d):
    """Blobs that pass the filters, on frames that do not blow up."""
    found = blobs.without_blowups(blobs.blob_stats(_labelled(spark, d)), 12)
    return rounded(found.where(blobs.keep_blobs()).select("frame_index", "label", "size", "row", "col", "intensity", "sigma"))


def frame_peaks(spark, d):
    """Which frames hold peaks, and how bright they are: local maxima of z above 2.5 per frame."""
    hot = stencil.local_maxima(whitened(spark, d).where("z IS NOT NULL"), "z").where("z > 2.5")
    got = hot.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n_peaks"), F.sum("excess").alias("intensity"), F.sqrt(F.sum("var")).alias("sigma"), F.max("z").alias("max_z"))
    return rounded(got)


def _sample(spark, d):
    """Seed pixels with the three background sources beside them."""
    s = seed(spark, d)
    own = noise.pixel_stats(s).select("row", "col", F.col("mean").alias("mu_pixel"), "var")
    own = own.withColumn("bin", noise.radial_bin(F.col("row"), F.col("col"), H, W)).withColumn("panel", noise.panel_of(F.col("row"), F.col("col"), TILES))
    own = own.join(noise.radial_stats(s, H, W).select("bin", F.col("mean").alias("mu_radial")), "bin").join(noise.panel_stats(s, TILES).select("panel", F.col("mean").alias("mu_panel")), "panel")
    return s.join(F.broadcast(own), ["row", "col"]).withColumnRenamed("adu", "x")


def blend_grid(spark, d):
    return rounded(calibrate.blend_grid(_sample(spark, d)))


def best_blend(spark, d):
    return rounded(calibrate.best_blend(calibrate.blend_grid(_sample(spark, d))))


def em_mixture(spark, d):
    pi, kappa = calibrate.em_mixture(whitened(spark, d), "z", iterations=5)
    return spark.createDataFrame([(round(pi, 6), round(kappa, 6))], "pi double, kappa double")


def photon_transfer(spark, d):
    shots = table(spark, d, "lineitem").select(F.col("l_quantity").alias("mean"), (F.lit(9.0) + 2.0 * F.col("l_quantity") + 10.0 * (F.col("l_discount") - 0.05)).alias("var"))
    return rounded(calibrate.photon_transfer(shots))


def empirical_null(spark, d):
    return rounded(calibrate.empirical_null(whitened(spark, d).withColumnRenamed("z", "t")))


CUTS = [1.0, 1.5, 2.0, 2.5, 3.0]


def threshold_sweep(spark, d):
    t = whitened(spark, d).select("frame_index", "row", "col", F.col("z").alias("t"))
    return calibrate.threshold_counts(t, CUTS, 2)


def threshold_calibration(spark, d):
    t = whitened(spark, d).select("frame_index", "row", "col", F.col("z").alias("t"))
    return rounded(calibrate.calibrate_threshold(t, target=1.0, lo=1.0, hi=3.0, step=0.5))


def scale_wls(spark, d):
    s = whitened(spark, d).select("frame_index", F.col("adu").alias("y"), F.col("mean").alias("t"), "var")
    return rounded(calibrate.weighted_scale(s, "frame_index", "t", "y", "var"))


def eigen_gram(spark, d):
    s = whitened(spark, d).where(F.col("frame_index") < SEED).withColumn("x", F.col("adu"))
    return rounded(calibrate.residual_gram(s))


def eigen_background(spark, d):
    """Share of the seed's residual power that two background modes explain."""
    s = whitened(spark, d).where(F.col("frame_index") < SEED).withColumn("x", F.col("adu"))
    c = calibrate.eigen_correction(s, calibrate.eigen_modes(s))
    both = s.join(c, ["frame_index", "row", "col"])
    return both.agg((1 - F.sum((F.col("x") - F.col("mean") - F.col("correction")) ** 2) / F.sum((F.col("x") - F.col("mean")) ** 2)).alias("explained"))


NAMES = """noise_pixel_stats noise_radial noise_panel noise_panel_clipped beamstop_hist noise_robust_fold noise_ewma_fold noise_frame_mode noise_dead_mask noise_running noise_drift
noise_shrinkage_z box_sum annulus_background gaussian_smooth matched_filter local_maxima dilation score_posterior components blob_stats peaks
frame_peaks blend_grid best_blend em_mixture photon_transfer empirical_null threshold_sweep threshold_calibration scale_wls eigen_gram
eigen_background""".split()
QUERIES = {n: globals()[n] for n in NAMES}

# --- SQL --------------------------------------------------------------------------------------------

PIX = """px AS (SELECT vec_id AS frame_index, CAST((i - 1) // 8 AS INTEGER) AS row, CAST((i - 1) % 8 AS INTEGER) AS col,
  100.0::DOUBLE + 80.0::DOUBLE * CAST(embedding[i] AS DOUBLE) AS adu FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
SEEDED = f"{PIX}, sd AS (SELECT * FROM px WHERE frame_index < {SEED})"
OWN = "SELECT row, col, count(adu) AS n, avg(adu) AS mean, coalesce(var_samp(adu), 0) AS var FROM {t} GROUP BY 1, 2"
STATS = f"{SEEDED}, st AS ({OWN.format(t='sd')})"
WHITE = f"""{STATS}, wh AS (SELECT px.*, st.mean, st.var, adu - mean AS excess, (adu - mean) / sqrt(greatest(var, 1e-12)) AS z
  FROM px JOIN st USING (row, col))"""
BIN = "CAST(floor(sqrt((row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5)) / 2.0) AS INTEGER)"
TWO = """SELECT {k}, count(*) AS n, avg(m) AS mean, coalesce(var_samp(m), 0) * max(size) AS var, max(size) AS pixels
  FROM (SELECT frame_index, {e} AS {k}, avg(adu) AS m, count(*) AS size FROM {t} GROUP BY 1, 2) GROUP BY 1"""
PANEL = "CASE WHEN col <= 3 THEN 't0' ELSE 't1' END"


def _r(columns: str, digits: int = 4) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _box(value: str, r: int, fold: str, source: str) -> str:
    return f"""SELECT frame_index, row, col, {fold}(s) OVER (PARTITION BY frame_index, col ORDER BY row RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS s
  FROM (SELECT frame_index, row, col, {fold}({value}) OVER (PARTITION BY frame_index, row ORDER BY col RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS s FROM {source})"""


def _kernel(side: int, sigma: float, scale: str = "sum") -> str:
    g = stencil.gaussian(side, sigma)
    if scale == "norm":
        n = sum(x * x for x in g) ** 0.5
        g = [x / n for x in g]
    return "(VALUES " + ", ".join(f"({k - side // 2}, {x!r}::DOUBLE)" for k, x in enumerate(g)) + ") AS k(o, w)"


def _conv(source: str, value: str, side: int, sigma: float, reflect: bool, square: bool = False) -> str:
    """Two-pass correlation in SQL: each target asks for its neighbours, mirrored or zero outside."""
    w = "w * w" if square else "w"
    fold = lambda c: f"(CASE WHEN {c} + o < 0 THEN -({c} + o) WHEN {c} + o > 7 THEN 14 - ({c} + o) ELSE {c} + o END)" if reflect else f"({c} + o)"
    k = _kernel(side, sigma, "sum" if reflect else "norm")
    first = f"SELECT a.frame_index, a.row, a.col, sum({w} * b.{value}) AS {value} FROM {source} a CROSS JOIN {k} JOIN {source} b ON a.frame_index = b.frame_index AND a.row = b.row AND b.col = {fold('a.col')} GROUP BY 1, 2, 3"
    return f"SELECT a.frame_index, a.row, a.col, sum({w} * b.{value}) AS v FROM ({first}) a CROSS JOIN {k} JOIN ({first}) b ON a.frame_index = b.frame_index AND a.col = b.col AND b.row = {fold('a.row')} GROUP BY 1, 2, 3"


def _ring(r: int) -> str:
    q = lambda v: _box(v, r, "sum", "ca")
    return f"SELECT a.frame_index, a.row, a.col, a.s AS m, b.s AS x, c.s AS q FROM ({q('1.0::DOUBLE')}) a JOIN ({q('x')}) b USING (frame_index, row, col) JOIN ({q('x * x')}) c USING (frame_index, row, col)"


SCORED = f"""{WHITE}, lb AS (SELECT *, CASE WHEN z > 0 THEN {-2.302585092994046!r} + {0.5 * (1 - 10.0**-2)!r}::DOUBLE * z * z ELSE 0.0 END AS log_bf FROM wh),
lg AS (SELECT *, log_bf + {scoring.prior_log_odds()!r}::DOUBLE AS v FROM lb), sm AS ({_conv("lg", "v", 5, 1.0, True)}),
sc AS (SELECT lb.*, 1.0 / (1.0 + exp(-sm.v)) AS posterior FROM lb JOIN sm USING (frame_index, row, col))"""
LABELLED = f"""RECURSIVE {SCORED}, fg AS (SELECT *, row * 8 + col AS pix FROM sc WHERE z > {HOT}),
ed AS (SELECT a.frame_index AS f, a.pix AS p, b.pix AS q FROM fg a JOIN fg b ON a.frame_index = b.frame_index AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1),
rc AS (SELECT f, p, q FROM ed UNION SELECT rc.f, rc.p, ed.q FROM rc JOIN ed ON rc.f = ed.f AND rc.q = ed.p),
rt AS (SELECT f, p, min(q) AS root FROM rc GROUP BY 1, 2),
lab AS (SELECT fg.*, CAST(dense_rank() OVER (PARTITION BY frame_index ORDER BY root) AS INTEGER) AS label FROM fg JOIN rt ON frame_index = f AND pix = p)"""
BLOBS = f"""{LABELLED}, b1 AS (SELECT frame_index, label, count(*) AS size, sum(greatest(excess, 0)) AS w, sum(greatest(excess, 0) * row) AS wr, sum(greatest(excess, 0) * col) AS wc,
  avg(row) AS mr, avg(col) AS mc, sum(excess) AS intensity, sqrt(sum(greatest(var, 0))) AS sigma, max(excess) AS max_excess, max(z) AS max_z, sum(log_bf) AS log_bf, avg(posterior) AS posterior,
  min(row) AS row_lo, max(row) + 1 AS row_hi, min(col) AS col_lo, max(col) + 1 AS col_hi, avg(excess) AS me FROM lab GROUP BY 1, 2),
b2 AS (SELECT *, CASE WHEN w > 0 THEN wr / w ELSE mr END AS r0, CASE WHEN w > 0 THEN wc / w ELSE mc END AS c0 FROM b1),
b3 AS (SELECT frame_index, label, sum(greatest(excess, 0) * (row - r0) * (row - r0)) AS rr, sum(greatest(excess, 0) * (col - c0) * (col - c0)) AS cc,
  sum(greatest(excess, 0) * (row - r0) * (col - c0)) AS rx FROM (SELECT lab.*, r0, c0 FROM lab JOIN b2 USING (frame_index, label)) GROUP BY 1, 2),
b4 AS (SELECT b2.*, rr / greatest(w, 1e-12) AS a, cc / greatest(w, 1e-12) AS b, rx / greatest(w, 1e-12) AS c FROM b2 JOIN b3 USING (frame_index, label)),
b5 AS (SELECT *, sqrt(greatest((a + b) * (a + b) - 4.0 * (a * b - c * c), 0.0)) AS root FROM b4),
bl AS (SELECT frame_index, label, size, r0 AS row, c0 AS col, intensity, sigma, max_excess, max_z, log_bf, posterior, row_lo, row_hi, col_lo, col_hi,
  CASE WHEN (a + b - root) / 2.0 > 1e-12 THEN ((a + b + root) / 2.0) / ((a + b - root) / 2.0) END AS eccentricity,
  CASE WHEN me > 1e-12 THEN max_excess / me ELSE 0.0 END AS peakedness FROM b5)"""
SAMPLE = f"""{STATS}, rd AS ({TWO.format(k="bin", e=BIN, t="sd")}), pn AS ({TWO.format(k="panel", e=PANEL, t="sd")}),
sa AS (SELECT (adu - st.mean) / sqrt(greatest(st.var, 1e-12)) AS r0, (adu - rd.mean) / sqrt(greatest(st.var, 1e-12)) AS r1, (adu - pn.mean) / sqrt(greatest(st.var, 1e-12)) AS r2
  FROM sd JOIN st USING (row, col) JOIN rd ON rd.bin = {BIN.replace("row", "sd.row").replace("col", "sd.col")} JOIN pn ON pn.panel = {PANEL.replace("col", "sd.col")}),
gr AS (SELECT row_number() OVER (ORDER BY i, j) - 1 AS ord, i / 10.0::DOUBLE AS w_pixel, j / 10.0::DOUBLE AS w_radial, (10 - i - j) / 10.0::DOUBLE AS w_panel
  FROM (SELECT unnest(range(0, 11)) AS i), (SELECT unnest(range(0, 11)) AS j) WHERE i + j <= 10),
mo AS (SELECT ord, w_pixel, w_radial, w_panel, avg(z) AS m, var_pop(z) AS v, avg(z * z * z * z) AS f FROM (
  SELECT gr.*, w_pixel * r0 + w_radial * r1 + w_panel * r2 AS z FROM sa, gr WHERE abs(r0) < 3.0) GROUP BY 1, 2, 3, 4),
lo AS (SELECT CAST(ord AS INTEGER) AS ord, w_pixel, w_radial, w_panel, m, v, f / (v * v) - 3.0 AS k4, m * m + (v - 1.0) * (v - 1.0) + 0.5 * (f / (v * v) - 3.0) * (f / (v * v) - 3.0) AS loss FROM mo)"""


def _em(rounds: int = 5) -> str:
    out = [f"{WHITE}", "e0 AS (SELECT 1e-3::DOUBLE AS pi, 10.0::DOUBLE AS kappa)"]
    for k in range(rounds):
        r = "(pi / kappa * exp(z * z * -0.5 / (kappa * kappa))) / ((1.0 - pi) * exp(z * z * -0.5) + pi / kappa * exp(z * z * -0.5 / (kappa * kappa)) + 1e-30)"
        out.append(f"e{k + 1} AS (SELECT least(greatest(avg(r), 1e-6), 0.5) AS pi, sqrt(greatest(sum(r * z * z) / greatest(sum(r), 1.0), 1.001)) AS kappa FROM (SELECT z, {r} AS r FROM wh, e{k}))")
    return "WITH " + ", ".join(out) + f" SELECT round(pi, 6) AS pi, round(kappa, 6) AS kappa FROM e{rounds}"


def _fold(key: str, init: str, step: str, final: str) -> str:
    return f"""WITH RECURSIVE ev AS (SELECT {key} AS k, value AS x, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
fo AS ({init} UNION ALL {step}), top AS (SELECT k, max(i) AS i FROM fo GROUP BY 1) {final}"""


ROBUST = _fold(
    "user_id", "SELECT k, i, 1::BIGINT AS n, x AS mean, 0.0::DOUBLE AS m2, 0::BIGINT AS clipped FROM ev WHERE i = 1",
    """SELECT k, i, n + 1, mean + (y - mean) / (n + 1), m2 + (y - mean) * (y - (mean + (y - mean) / (n + 1))), clipped + CAST(y < x AS BIGINT) FROM (
  SELECT f.k, e.i, f.n, f.mean, f.m2, f.clipped, e.x, CASE WHEN f.n >= 4 AND f.m2 > 0 THEN least(e.x, f.mean + 5.0 * sqrt(f.m2 / (f.n - 1))) ELSE e.x END AS y
  FROM fo f JOIN ev e ON e.k = f.k AND e.i = f.i + 1)""",
    "SELECT k AS user_id, n, round(mean, 4) AS mean, round(CASE WHEN n >= 2 THEN m2 / (n - 1) ELSE 0 END, 4) AS var, clipped FROM fo JOIN top USING (k, i)",
)
ROBUST_SCORES = (
    ROBUST.split(", top AS")[0].replace("value AS x,", "value AS x, event_id,")
    + """, va AS (SELECT *, CASE WHEN n >= 2 THEN m2 / (n - 1) ELSE 0 END AS var FROM fo), wu AS (SELECT k, var > 0 AS ok FROM va WHERE i = 16)
SELECT va.k AS user_id, ev.event_id, n, round(CASE WHEN i < 16 OR ok THEN (ev.x - mean) / sqrt(greatest(var, 1e-12)) END, 4) AS z FROM va JOIN ev USING (k, i) LEFT JOIN wu ON wu.k = va.k"""
)
EWMA = _fold(
    "event_type", "SELECT k, i, 1::BIGINT AS n, {a} * x AS mean, 0.95 * ({a} * x * x) AS var FROM ev WHERE i = 1".replace("{a}", repr(1.0 - 0.95) + "::DOUBLE"),
    "SELECT f.k, e.i, n + 1, mean + {a} * (x - mean), 0.95::DOUBLE * (var + {a} * (x - mean) * (x - mean)) FROM fo f JOIN ev e ON e.k = f.k AND e.i = f.i + 1".replace("{a}", repr(1.0 - 0.95) + "::DOUBLE"),
    "SELECT k AS event_type, n, round(mean, 4) AS mean, round(var, 4) AS var FROM fo JOIN top USING (k, i)",
)
SWEEP = f"""{WHITE}, nb AS (SELECT a.frame_index, a.row, a.col, a.z, max(b.z) AS near_max, list_sort(list(b.z), 'DESC') AS zs FROM wh a JOIN wh b
  ON a.frame_index = b.frame_index AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3, 4),
pk AS (SELECT frame_index, zs[2] AS t FROM nb WHERE z >= near_max), cu AS (SELECT unnest({CUTS})::DOUBLE AS cut),
sw AS (SELECT f.frame_index, cut, count(t) AS n FROM (SELECT DISTINCT frame_index FROM px) f CROSS JOIN cu LEFT JOIN pk ON pk.frame_index = f.frame_index AND pk.t > cut GROUP BY 1, 2)"""
NULL = """md AS (SELECT quantile_disc(z, 0.5) AS mu0 FROM wh), nu AS (SELECT mu0, sqrt(avg((z - mu0) * (z - mu0))) AS sigma0 FROM wh, md WHERE z < mu0 GROUP BY mu0)"""
RUN = "count(adu) OVER w AS n, avg(adu) OVER w AS mean, coalesce(var_samp(adu) OVER w, 0) AS var FROM {t} WINDOW w AS (PARTITION BY row, col ORDER BY frame_index ROWS UNBOUNDED PRECEDING)"

ORACLE = {
    "noise_pixel_stats": f"WITH {PIX}, st AS ({OWN.format(t='px')}) SELECT row, col, n, {_r('mean var')} FROM st",
    "noise_radial": f"WITH {PIX}, t AS ({TWO.format(k='bin', e=BIN, t='px')}) SELECT bin, n, {_r('mean var')}, pixels FROM t",
    "noise_panel": f"WITH {PIX}, t AS ({TWO.format(k='panel', e=PANEL, t='px')}) SELECT panel, n, {_r('mean var')}, pixels FROM t",
    "noise_panel_clipped": f"""WITH RECURSIVE {SEEDED}, ev AS (SELECT row * 8 + col AS k, adu AS x, row, col, frame_index, row_number() OVER (PARTITION BY row, col ORDER BY frame_index) AS i FROM sd),
fo AS (SELECT k, i, 1::BIGINT AS n, x AS mean, 0.0::DOUBLE AS m2, x AS y FROM ev WHERE i = 1 UNION ALL
  SELECT k, i, n + 1, mean + (y - mean) / (n + 1), m2 + (y - mean) * (y - (mean + (y - mean) / (n + 1))), y FROM (
  SELECT f.k, e.i, f.n, f.mean, f.m2, CASE WHEN f.n >= 4 AND f.m2 > 0 THEN least(e.x, f.mean + 2.0 * sqrt(f.m2 / (f.n - 1))) ELSE e.x END AS y FROM fo f JOIN ev e ON e.k = f.k AND e.i = f.i + 1)),
cx AS (SELECT frame_index, row, col, y AS adu FROM fo JOIN ev USING (k, i)), t AS ({TWO.format(k="panel", e=PANEL, t="cx")}) SELECT panel, n, {_r('mean var')}, pixels FROM t""",
    "beamstop_hist": f"""WITH {WHITE}, r AS (SELECT row, col, z > 2.5 AS hot, CAST(least(floor(sqrt((row - 3.5) * (row - 3.5) + (col - 3.5) * (col - 3.5)) / (sqrt(24.5::DOUBLE) / 40)), 39) AS INTEGER) AS bin FROM wh)
SELECT bin, count(*) FILTER (WHERE hot) AS peaks, count(DISTINCT row * 8 + col) AS pixels FROM r GROUP BY 1""",
    "noise_robust_fold": ROBUST,
    "noise_ewma_fold": EWMA,
    "noise_frame_mode": "SELECT user_id, 1::BIGINT AS n, round(arg_max(value, (ts, event_id)), 4) AS mean, 0.0::DOUBLE AS var FROM events WHERE value IS NOT NULL GROUP BY 1",
    "noise_dead_mask": f"WITH {PIX} SELECT row, col, coalesce(var_samp(adu), 0) > 0 AS valid FROM px WHERE frame_index < 16 GROUP BY 1, 2",
    "noise_running": f"WITH {PIX}, t AS (SELECT frame_index, row, col, adu, {RUN.format(t='px')}) SELECT frame_index, row, col, n, {_r('adu mean var')} FROM t",
    "noise_drift": f"""WITH {PIX}, t AS (SELECT row, col, {RUN.format(t="px")}), a AS (SELECT n AS step, mean, greatest(var, 1e-12) AS v, var > 0 AS ok,
  coalesce(lag(mean) OVER w, 0) AS m0, greatest(coalesce(lag(var) OVER w, 0), 1e-12) AS v0 FROM t WHERE n % 50 = 0 WINDOW w AS (PARTITION BY row, col ORDER BY n))
SELECT step, round(coalesce(avg(abs(mean - m0)) FILTER (WHERE ok), 0), 4) AS mean_shift, round(coalesce(avg(ln(v / v0)) FILTER (WHERE ok), 0), 4) AS var_ratio_log,
  round(ln(1.0 + coalesce(avg(0.5 * (ln(v0 / v) + (v + (mean - m0) * (mean - m0)) / v0 - 1.0)) FILTER (WHERE ok), 0)), 4) AS kl_log1p,
  round(step::DOUBLE, 4) AS effective_n, count(*) FILTER (WHERE NOT ok) AS n_masked FROM a GROUP BY step""",
    "noise_shrinkage_z": f"""WITH {PIX}, s8 AS (SELECT * FROM px WHERE frame_index < 8), rd AS ({TWO.format(k="bin", e=BIN, t="s8")}),
ow AS (SELECT row, col, {BIN} AS bin, count(*) AS n, avg(adu) AS m, greatest(coalesce(var_samp(adu), 0), 1e-12) AS var FROM s8 GROUP BY 1, 2, 3),
md AS (SELECT row, col, least(1.0, ow.n / 16.0::DOUBLE) * m + (1.0 - least(1.0, ow.n / 16.0::DOUBLE)) * rd.mean AS mean, ow.var FROM ow JOIN rd USING (bin))
SELECT frame_index, row, col, round(mean, 4) AS mean, round((adu - mean) / sqrt(var), 4) AS z FROM px JOIN md USING (row, col)""",
    "box_sum": f"WITH {PIX}, t AS ({_box('adu', 2, 'sum', 'px')}) SELECT frame_index, row, col, {_r('adu s')} FROM px JOIN t USING (frame_index, row, col)",
    "annulus_background": f"""WITH {WHITE}, ca AS (SELECT frame_index, row, col, least(excess, 5.0 * sqrt(greatest(var, 0))) AS x FROM wh), o AS ({_ring(3)}), i AS ({_ring(1)}),
t AS (SELECT frame_index, row, col, o.m - i.m AS n, (o.x - i.x) / greatest(o.m - i.m, 1.0) AS lm, (o.q - i.q) / greatest(o.m - i.m, 1.0) AS lq FROM o JOIN i USING (frame_index, row, col))
SELECT frame_index, row, col, round(n, 4) AS local_count, round(lm, 4) AS local_mean, round(greatest(lq - lm * lm, 0.0), 4) AS local_var FROM t""",
    "gaussian_smooth": f"WITH {PIX}, t AS ({_conv('px', 'adu', 5, 1.0, True)}) SELECT frame_index, row, col, round(v, 4) AS smooth FROM t",
    "matched_filter": "WITH " + WHITE + ", o AS (SELECT frame_index, row, col, z, 1.0::DOUBLE AS one FROM wh), " + ", ".join(
        f"n{k} AS ({_conv('o', 'z', stencil.matched_side(s), s, False)}), d{k} AS ({_conv('o', 'one', stencil.matched_side(s), s, False, True)})" for k, s in enumerate((0.6, 1.0))
    ) + """ SELECT frame_index, row, col, round(greatest(n0.v / sqrt(d0.v), n1.v / sqrt(d1.v)), 4) AS t FROM n0 JOIN d0 USING (frame_index, row, col)
  JOIN n1 USING (frame_index, row, col) JOIN d1 USING (frame_index, row, col)""",
    "local_maxima": f"WITH {WHITE}, t AS ({_box('z', 1, 'max', 'wh')}) SELECT frame_index, row, col, round(z, 4) AS z FROM wh JOIN t USING (frame_index, row, col) WHERE z >= s",
    "dilation": f"WITH {WHITE}, h AS (SELECT *, CASE WHEN z > 2.5 THEN 1 ELSE 0 END AS b FROM wh), t AS ({_box('b', 2, 'max', 'h')}) SELECT frame_index, row, col, s AS bright FROM t",
    "score_posterior": f"WITH {SCORED} SELECT frame_index, row, col, {_r('excess z log_bf posterior')} FROM sc",
    "components": f"WITH {LABELLED} SELECT frame_index, label, count(*) AS size FROM lab GROUP BY 1, 2",
    "blob_stats": f"WITH {BLOBS} SELECT frame_index, label, size, row_lo, row_hi, col_lo, col_hi, {_r('row col intensity sigma max_excess max_z log_bf posterior eccentricity peakedness')} FROM bl",
    "peaks": f"""WITH {BLOBS} SELECT frame_index, label, size, {_r("row col intensity sigma")} FROM bl WHERE size BETWEEN 2 AND 30 AND eccentricity <= 5.0 AND peakedness >= 1.2
  AND frame_index IN (SELECT frame_index FROM bl GROUP BY 1 HAVING count(*) <= 12)""",
    "frame_peaks": f"""WITH {WHITE}, t AS ({_box("z", 1, "max", "wh")}) SELECT frame_index, count(*) AS n_peaks, round(sum(excess), 4) AS intensity, round(sqrt(sum(var)), 4) AS sigma,
  round(max(z), 4) AS max_z FROM wh JOIN t USING (frame_index, row, col) WHERE z >= s AND z > 2.5 GROUP BY 1""",
    "blend_grid": f"WITH {SAMPLE} SELECT ord, {_r('w_pixel w_radial w_panel m v k4 loss')} FROM lo",
    "best_blend": f"WITH {SAMPLE} SELECT {_r('w_pixel w_radial w_panel m v k4 loss')}, round(sqrt(greatest(v, 1e-6)), 4) AS var_scale FROM lo ORDER BY lo.loss, lo.ord LIMIT 1",
    "em_mixture": _em(),
    "photon_transfer": """WITH s AS (SELECT l_quantity AS mean, 9.0 + 2.0 * l_quantity + 10.0 * (l_discount - 0.05) AS var FROM lineitem),
e AS (SELECT list_sort(list_distinct(quantile_cont(mean, [k / 24.0::DOUBLE for k in range(0, 25)]))) AS e FROM s),
b AS (SELECT mean, var, len(list_filter(e[2:-2], lambda x: x <= mean)) AS bin FROM s, e),
m AS (SELECT bin, quantile_disc(mean, 0.5) AS x, quantile_disc(var, 0.5) AS y FROM b GROUP BY 1 HAVING count(*) >= 500),
l AS (SELECT count(*) AS bins, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, quantile_disc(y / greatest(x, 1e-12), 0.5) AS r FROM m)
SELECT round(CASE WHEN a >= 0 AND b > 0 THEN a ELSE 0.0 END, 4) AS read_var, round(greatest(CASE WHEN a >= 0 AND b > 0 THEN b ELSE r END, 1e-6), 4) AS gain, bins FROM l""",
    "empirical_null": f"WITH {WHITE}, {NULL} SELECT round(mu0, 4) AS mu0, round(sigma0, 4) AS sigma0 FROM nu",
    "threshold_sweep": f"WITH {SWEEP} SELECT frame_index, cut, n FROM sw",
    "threshold_calibration": f"""WITH {SWEEP}, {NULL}, qa AS (SELECT frame_index, max(z) <= any_value(mu0) + any_value(sigma0) * sqrt(2.0 * ln(greatest(count(z), 2))) AS q FROM wh, nu GROUP BY 1),
me AS (SELECT cut, quantile_disc(n, 0.5) AS med FROM sw WHERE frame_index IN (SELECT frame_index FROM qa WHERE q) GROUP BY 1),
th AS (SELECT coalesce(min(cut) FILTER (WHERE med <= 1.0), max(cut)) AS threshold FROM me)
SELECT threshold, med::DOUBLE AS achieved, (SELECT count(*) FROM qa WHERE q) AS n_quiet, round(mu0, 4) AS mu0, round(sigma0, 4) AS sigma0 FROM th JOIN me ON cut = threshold, nu""",
    "scale_wls": f"""WITH {WHITE}, s AS (SELECT frame_index, sum(1 / var) AS s, sum(mean / var) AS sx, sum(mean * mean / var) AS sxx, sum(adu / var) AS sy, sum(mean * adu / var) AS sxy
  FROM wh WHERE var > 0 AND adu < mean + 5.0 * sqrt(var) GROUP BY 1), t AS (SELECT *, greatest(s * sxx - sx * sx, 1e-12) AS det FROM s)
SELECT frame_index, round((s * sxy - sx * sy) / det, 4) AS scale, round(sqrt(greatest(s / det, 0.0)), 4) AS sigma, round((sxx * sy - sx * sxy) / det, 4) AS "offset" FROM t""",
    "eigen_gram": f"""WITH {WHITE}, r AS (SELECT frame_index, row, col, least(excess, 5.0 * sqrt(greatest(var, 0))) AS r FROM wh WHERE frame_index < {SEED})
SELECT a.frame_index AS i, b.frame_index AS j, round(sum(a.r * b.r), 4) AS g FROM r a JOIN r b USING (row, col) WHERE a.frame_index <= b.frame_index GROUP BY 1, 2""",
}
