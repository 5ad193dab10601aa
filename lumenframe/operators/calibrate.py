"""Calibration from seed frames: blend, mixture, photon transfer, threshold, scale, modes, beam stop.

The large sides stay DataFrames; what reaches the driver are a handful of aggregates per step.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.stencil import box_max, box_sum
from lumenframe.session import cut


def lower_median_of(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """``keys…, median``: exact lower median per key, by counts of distinct values.

    Values are counted first (partial aggregation), so repeated values cost one row each.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*keys).orderBy("x")
    at = counts.select(*keys, "x", F.sum("c").over(w).alias("upto"), F.sum("c").over(Window.partitionBy(*keys)).alias("n"))
    return at.where(2 * F.col("upto") >= F.col("n")).groupBy(*keys).agg(F.min("x").alias("median"))


def simplex(step: float = 0.1) -> list[tuple[float, float, float]]:
    """All triples of multiples of ``step`` that sum to 1, in ascending order of the first two."""
    n = round(1 / step)
    return [(i / n, j / n, (n - i - j) / n) for i in range(n + 1) for j in range(n + 1 - i)]


def blend_grid(sample: DataFrame, robust_z: float = 3.0, step: float = 0.1, kurtosis_weight: float = 0.5) -> DataFrame:
    """``ord, w_pixel, w_radial, w_panel, m, v, k4, loss`` of each blend over the background sample.

    ``sample`` holds ``x, mu_pixel, mu_radial, mu_panel, var``. The background are values within
    ``robust_z`` of the pixel mean. Moments of z: mean, population variance, and the raw fourth
    moment over v² less 3. z is linear in the weights, so one pass gathers power sums of the three
    normalised residuals, and the grid is evaluated on those: the sample is not crossed with it.
    """
    s = F.sqrt(F.greatest("var", F.lit(1e-12)))
    r = [(F.col("x") - F.col(c)) / s for c in ("mu_pixel", "mu_radial", "mu_panel")]
    base = sample.select(*[c.alias(f"r{k}") for k, c in enumerate(r)]).where(F.abs("r0") < robust_z)
    powers = [(a, b, d - a - b) for d in (1, 2, 4) for a in range(d + 1) for b in range(d + 1 - a)]
    term = lambda a, b, c: F.pow("r0", F.lit(a)) * F.pow("r1", F.lit(b)) * F.pow("r2", F.lit(c))
    sums = base.agg(F.count(F.lit(1)).alias("n"), *[F.avg(term(*p)).alias(f"p{''.join(map(str, p))}") for p in powers])
    grid = sample.sparkSession.createDataFrame([(k, *w) for k, w in enumerate(simplex(step))], "ord int, w_pixel double, w_radial double, w_panel double")

    def moment(d: int) -> Column:
        out = F.lit(0.0)
        for a, b, c in powers:
            if a + b + c == d:
                times = math.factorial(d) // (math.factorial(a) * math.factorial(b) * math.factorial(c))
                out = out + times * F.pow("w_pixel", F.lit(a)) * F.pow("w_radial", F.lit(b)) * F.pow("w_panel", F.lit(c)) * F.col(f"p{a}{b}{c}")
        return out

    both = grid.crossJoin(F.broadcast(sums))  # 66 rows beside one row
    v = F.greatest(moment(2) - moment(1) * moment(1), F.lit(0.0))
    out = both.select("ord", "w_pixel", "w_radial", "w_panel", "n", moment(1).alias("m"), v.alias("v"), (moment(4) / (v * v) - 3.0).alias("k4"))
    loss = F.col("m") ** 2 + (F.col("v") - 1.0) ** 2 + kurtosis_weight * F.col("k4") ** 2
    return out.where("n >= 100").drop("n").withColumn("loss", loss)


def best_blend(grid: DataFrame) -> DataFrame:
    """The first blend of least loss, with ``var_scale``."""
    return grid.agg(F.min_by(F.struct("w_pixel", "w_radial", "w_panel", "m", "v", "k4", "loss"), F.struct("loss", "ord")).alias("b")).select(
        "b.*", F.sqrt(F.greatest("b.v", F.lit(1e-6))).alias("var_scale")
    )


def em_mixture(z: DataFrame, column: str = "z", iterations: int = 50, pi: float = 1e-3, kappa: float = 10.0) -> tuple[float, float]:
    """Share and width of the broad part of a mixture of N(0, 1) and N(0, kappa²), by EM.

    Each round is one aggregate of three sums over the cached sample.
    """
    data = cut(z.select((F.col(column) * F.col(column)).alias("z2")).where("z2 IS NOT NULL"))
    for _ in range(iterations):
        broad = F.lit(pi / kappa) * F.exp(F.col("z2") * F.lit(-0.5 / kappa**2))
        r = broad / (F.lit(1.0 - pi) * F.exp(F.col("z2") * F.lit(-0.5)) + broad + F.lit(1e-30))
        got = data.agg(F.avg(r), F.sum(r), F.sum(r * F.col("z2"))).first()
        if got[0] is None:
            break
        pi = min(max(got[0], 1e-6), 0.5)
        kappa = math.sqrt(max(got[2] / max(got[1], 1.0), 1.001))
    return pi, kappa


def photon_transfer(stats: DataFrame, bins: int = 24, least_pixels: int = 500) -> DataFrame:
    """``read_var, gain, bins`` from the variance of pixels against their mean (``mean, var``).

    Quantile bins of the mean; lower medians of mean and variance per bin of at least
    ``least_pixels``; a straight line through them. An impossible line (or fewer than two bins) is
    replaced by the median ratio through the origin.
    """
    edges = stats.agg(F.percentile("mean", F.array(*[F.lit(k / bins) for k in range(bins + 1)])).alias("e")).select(F.array_distinct("e").alias("e"))
    # One row of at most 25 edges; a value's bin is the number of inner edges not above it.
    binned = stats.join(F.broadcast(edges)).select(
        "mean", "var", F.size(F.filter(F.slice("e", 2, F.greatest(F.size("e") - 2, F.lit(0))), lambda x: x <= F.col("mean"))).alias("bin")
    )
    big = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_pixels)
    inside = binned.join(F.broadcast(big.select("bin")), "bin", "left_semi")
    mid = lower_median_of(inside, "mean", "bin").withColumnRenamed("median", "x").join(lower_median_of(inside, "var", "bin").withColumnRenamed("median", "y"), "bin")
    line = mid.agg(F.count(F.lit(1)).alias("bins"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    ratio = lower_median_of(mid.select((F.col("y") / F.greatest("x", F.lit(1e-12))).alias("r")), "r").withColumnRenamed("median", "bin_ratio")
    all_ratio = lower_median_of(stats.select((F.col("var") / F.greatest("mean", F.lit(1e-12))).alias("r")), "r").withColumnRenamed("median", "pixel_ratio")
    one = line.join(ratio, F.lit(True), "left").join(all_ratio, F.lit(True), "left")
    good = (F.col("bins") >= 2) & (F.col("a") >= 0) & (F.col("b") > 0)
    slope = F.when(good, F.col("b")).when(F.col("bins") >= 2, F.col("bin_ratio")).otherwise(F.col("pixel_ratio"))
    return one.select(F.greatest(F.when(good, F.col("a")).otherwise(0.0), F.lit(0.0)).alias("read_var"), F.greatest(slope, F.lit(1e-6)).alias("gain"), "bins")


def empirical_null(values: DataFrame, column: str = "t") -> DataFrame:
    """``mu0, sigma0``: lower median, and the spread of the left half about it (reflected)."""
    mid = lower_median_of(values, column).withColumnRenamed("median", "mu0")
    # One row.
    left = values.join(F.broadcast(mid)).where(F.col(column) < F.col("mu0"))
    return left.agg(F.sqrt(F.avg((F.col(column) - F.col("mu0")) ** 2)).alias("sigma0")).join(mid).select("mu0", F.coalesce("sigma0", F.lit(0.0)).alias("sigma0"))


def threshold_counts(t: DataFrame, cuts: list[float], size_min: int = 2) -> DataFrame:
    """``frame_index, cut, n``: local maxima above each cut whose 3x3 box holds enough pixels above it.

    Instead of a copy of the pixels per cut, each maximum carries the ``size_min``-th largest value
    of its box: it counts for all cuts below the smaller of that and itself.
    """
    near = box_max(t, {"near_max": F.col("t")}, 1).where("t >= near_max").select("frame_index", "row", "col", "t")
    if size_min > 1:
        offsets = F.explode(F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (-1, 0, 1) for c in (-1, 0, 1)]))
        asked = near.select("frame_index", F.col("row").alias("r0"), F.col("col").alias("c0"), F.col("t").alias("t0"), offsets.alias("o"))
        asked = asked.select("frame_index", "r0", "c0", "t0", (F.col("r0") + F.col("o.r")).alias("row"), (F.col("c0") + F.col("o.c")).alias("col"))
        box = asked.join(t.select("frame_index", "row", "col", "t"), ["frame_index", "row", "col"]).groupBy("frame_index", "r0", "c0").agg(F.sort_array(F.collect_list("t"), asc=False).alias("v"))
        near = box.select("frame_index", F.get("v", F.lit(size_min - 1)).alias("t")).where("t IS NOT NULL")
    steps = F.array(*[F.lit(float(c)) for c in cuts])
    hits = near.select("frame_index", F.explode(F.filter(steps, lambda c: c < F.col("t"))).alias("cut")).groupBy("frame_index", "cut").agg(F.count(F.lit(1)).alias("n"))
    frames = t.select("frame_index").distinct().select("frame_index", F.explode(steps).alias("cut"))
    return frames.join(hits, ["frame_index", "cut"], "left").select("frame_index", "cut", F.coalesce("n", F.lit(0)).alias("n"))


def quiet_frames(t: DataFrame, null: DataFrame, least: int = 4) -> DataFrame:
    """Frames whose largest value is what noise of that many pixels gives; else those with the lowest."""
    per = t.groupBy("frame_index").agg(F.max("t").alias("top"), F.count("t").alias("n")).join(F.broadcast(null))
    limit = F.col("mu0") + F.col("sigma0") * F.sqrt(2.0 * F.log(F.greatest(F.col("n"), F.lit(2)).cast("double")))
    judged = cut(per.select("frame_index", "top", (F.col("top") <= limit).alias("quiet")))
    n, quiet = judged.agg(F.count(F.lit(1)), F.count_if("quiet")).first()
    if quiet >= least:
        return judged.where("quiet").select("frame_index")
    return judged.orderBy("top", "frame_index").limit(max(least, round(0.5 * n))).select("frame_index")


def calibrate_threshold(t: DataFrame, target: float = 5.0, lo: float = 3.0, hi: float = 8.0, step: float = 0.1, size_min: int = 2) -> DataFrame:
    """``threshold, achieved, n_quiet, mu0, sigma0``: the first cut whose lower-median count on the
    quiet frames is within the target; the last cut if none is."""
    null = cut(empirical_null(t))
    quiet = cut(quiet_frames(t, null))
    cuts = [round(lo + k * step, 10) for k in range(round((hi - lo) / step) + 1)]
    counts = threshold_counts(t.join(quiet, "frame_index", "left_semi"), cuts, size_min)
    med = cut(lower_median_of(counts, "n", "cut"))
    pick = med.agg(F.coalesce(F.min(F.when(F.col("median") <= target, F.col("cut"))), F.max("cut")).alias("threshold"))
    return pick.join(med, F.col("threshold") == F.col("cut"), "left").join(quiet.agg(F.count(F.lit(1)).alias("n_quiet"))).join(null).select(
        "threshold", F.col("median").cast("double").alias("achieved"), "n_quiet", "mu0", "sigma0"
    )


def weighted_scale(df: DataFrame, key: str, t: str, y: str, var: str, k: float = 5.0) -> DataFrame:
    """``key, scale, sigma, offset``: weighted straight line of a frame against the background.

    Weights 1 / var; values more than ``k`` deviations above the background are left out.
    """
    ok = df.where(F.col(y).isNotNull() & F.col(t).isNotNull() & (F.col(var) > 0) & (F.col(y) < F.col(t) + F.lit(k) * F.sqrt(var)))
    w, x, v = F.lit(1.0) / F.col(var), F.col(t), F.col(y)
    s = ok.groupBy(key).agg(F.sum(w).alias("s"), F.sum(w * x).alias("sx"), F.sum(w * x * x).alias("sxx"), F.sum(w * v).alias("sy"), F.sum(w * x * v).alias("sxy"))
    det = F.greatest(F.col("s") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(1e-12))
    return s.select(
        key, ((F.col("s") * F.col("sxy") - F.col("sx") * F.col("sy")) / det).alias("scale"), F.sqrt(F.greatest(F.col("s") / det, F.lit(0.0))).alias("sigma"),
        ((F.col("sxx") * F.col("sy") - F.col("sx") * F.col("sxy")) / det).alias("offset"),
    )


def residual_gram(pixels: DataFrame, clip: float = 5.0) -> DataFrame:
    """``i, j, g``: inner products of the clipped residuals of seed frames, one row per pair i <= j.

    ``pixels`` holds ``frame_index, row, col, x, mean, var`` of the seed frames alone; their number
    is a parameter of the calibration, so the frames x frames result is small.
    """
    r = F.least(F.col("x") - F.col("mean"), F.lit(clip) * F.sqrt(F.greatest("var", F.lit(0.0))))
    per = pixels.select("row", "col", F.col("frame_index").alias("i"), r.alias("r"))
    rows = per.groupBy("row", "col").agg(F.collect_list(F.struct("i", "r")).alias("v"))
    pairs = rows.select(F.explode("v").alias("a"), "v").select("a", F.explode("v").alias("b")).where("a.i <= b.i")
    return pairs.groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.r") * F.col("b.r")).alias("g"))


def eigen_modes(pixels: DataFrame, modes: int = 2, clip: float = 5.0, passes: int = 2) -> DataFrame:
    """``mode, row, col, u``: unit-norm background modes, by trimmed principal components.

    The frame Gram matrix of the bounded seed is decomposed on the driver; the modes are formed and
    used where the pixels are. Later passes clip about what the modes of the former explain.
    """
    spark = pixels.sparkSession
    base = pixels.select("frame_index", "row", "col", "x", "mean", "var")
    out = None
    for _ in range(passes):
        gram = residual_gram(base, clip).toPandas()
        ids = sorted(set(gram["i"]) | set(gram["j"]))
        if not ids:
            return spark.createDataFrame([], "mode int, row int, col int, u double")
        pos = {f: k for k, f in enumerate(ids)}
        g = np.zeros((len(ids), len(ids)))
        for i, j, v in gram.itertuples(index=False):
            g[pos[i], pos[j]] = g[pos[j], pos[i]] = v
        val, vec = np.linalg.eigh(g)
        top = np.argsort(val)[::-1][:modes]
        rows = [(int(m), int(f), float(vec[k, t] / math.sqrt(max(val[t], 1e-12)))) for m, t in enumerate(top) for k, f in enumerate(ids)]
        weights = spark.createDataFrame(rows, "mode int, frame_index long, c double")  # modes x seed frames
        r = F.least(F.col("x") - F.col("mean"), F.lit(clip) * F.sqrt(F.greatest("var", F.lit(0.0))))
        out = cut(base.select("frame_index", "row", "col", r.alias("r")).join(F.broadcast(weights), "frame_index").groupBy("mode", "row", "col").agg(F.sum(F.col("c") * F.col("r")).alias("u")))
        base = cut(pixels.join(eigen_correction(pixels, out, clip), ["frame_index", "row", "col"]).withColumn("mean", F.col("mean") + F.col("correction")).drop("correction"))
    return out


def eigen_correction(pixels: DataFrame, modes: DataFrame, clip: float = 5.0) -> DataFrame:
    """``frame_index, row, col, correction``: each frame's clipped residual projected on the modes."""
    r = F.least(F.col("x") - F.col("mean"), F.lit(clip) * F.sqrt(F.greatest("var", F.lit(0.0))))
    seen = pixels.select("frame_index", "row", "col", r.alias("r")).join(modes, ["row", "col"])
    coef = seen.groupBy("frame_index", "mode").agg(F.sum(F.col("r") * F.col("u")).alias("c"))
    return seen.join(coef, ["frame_index", "mode"]).groupBy("frame_index", "row", "col").agg(F.sum(F.col("c") * F.col("u")).alias("correction"))


def beam_stop(peaks: DataFrame, pixels: DataFrame, bins: int = 40, least_peaks: int = 200, least_share: float = 0.05, spike: float = 50.0, least_bin: int = 5) -> float | None:
    """The q below which peaks are an artefact of the beam stop, or None.

    Histograms of q over [0, largest q] (the right edge in the last bin) of peaks and pixels; a spike
    of peak density in the inner quarter, widened to a tenth of its height. Only the bins, a fixed
    number, reach the driver.
    """
    top = pixels.agg(F.max("q")).first()[0]
    if not top:
        return None
    which = F.least(F.floor(F.col("q") / F.lit(top / bins)), F.lit(bins - 1)).cast("int")
    count = lambda df: {r["b"]: r["n"] for r in df.where(F.col("q").between(0.0, top)).groupBy(which.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    p, x = count(peaks), count(pixels)
    if sum(p.values()) < least_peaks:
        return None
    density = [p.get(b, 0) / max(x.get(b, 0), 1) if p.get(b, 0) >= least_bin else 0.0 for b in range(bins)]
    positive = sorted(v for v in density if v > 0)
    ref = max(density[: bins // 4])
    if not positive or ref < spike * positive[(len(positive) - 1) // 2] or ref <= 0:
        return None
    hi = density.index(ref)
    while hi + 1 < bins and density[hi + 1] >= 0.1 * ref:
        hi += 1
    q_min = (hi + 1) * top / bins
    below = peaks.where(F.col("q") < q_min).count()
    return q_min if below >= least_share * sum(p.values()) else None


def bright_neighbourhood(z: DataFrame, threshold: float, radius: int = 2) -> DataFrame:
    """Pixels with ``bright``: some pixel within the box is above the threshold."""
    return box_sum(z, {"above": F.when(F.col("z") > threshold, 1).otherwise(0)}, radius).withColumn("bright", F.col("above") > 0).drop("above")
