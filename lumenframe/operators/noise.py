"""The background noise model: statistics per pixel, radial bin and panel, and ordered folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Panel


def pixels_of(frames: DataFrame, pixels: str = "pixels", width: int | str = "w") -> DataFrame:
    """One row per pixel (``frame_index, row, col, adu``) of dense frames with a flat pixel array."""
    w = F.lit(width) if isinstance(width, int) else F.col(width)
    long = frames.select("frame_index", w.alias("w"), F.posexplode(pixels).alias("pos", "adu"))
    return long.select("frame_index", F.floor(F.col("pos") / F.col("w")).cast("int").alias("row"), (F.col("pos") % F.col("w")).cast("int").alias("col"), F.col("adu").cast("double").alias("adu"))


def spread(x: Column) -> Column:
    """Unbiased variance, 0 for fewer than two values."""
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def pixel_stats(pixels: DataFrame) -> DataFrame:
    """``row, col, n, mean, var``; NULL values do not take part."""
    return pixels.groupBy("row", "col").agg(F.count("adu").alias("n"), F.avg("adu").alias("mean"), spread(F.col("adu")).alias("var"))


def radial_bin(row: Column, col: Column, height: int, width: int, bin_width: float = 2.0, center: tuple[float, float] | None = None) -> Column:
    r0, c0 = center if center else ((height - 1) / 2.0, (width - 1) / 2.0)
    dr, dc = row - F.lit(r0), col - F.lit(c0)
    return F.floor(F.sqrt(dr * dr + dc * dc) / F.lit(bin_width)).cast("int")


def _two_level(keyed: DataFrame, key: str) -> DataFrame:
    """Mean per frame and key, then over the frames; the variance of one pixel from that of the means."""
    per = keyed.groupBy("frame_index", key).agg(F.avg("adu").alias("m"), F.count(F.lit(1)).alias("size"))
    return per.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean"), (spread(F.col("m")) * F.max("size")).alias("var"), F.max("size").alias("pixels")
    )


def radial_stats(pixels: DataFrame, height: int, width: int, bin_width: float = 2.0, center: tuple[float, float] | None = None) -> DataFrame:
    """``bin, n, mean, var, pixels`` of rings around the centre (of the frame, unless given)."""
    return _two_level(pixels.withColumn("bin", radial_bin(F.col("row"), F.col("col"), height, width, bin_width, center)), "bin")


def panel_of(row: Column, col: Column, panels: Sequence[Panel], last: bool = False) -> Column:
    """Name of the first (or last) panel whose bounds, inclusive, hold the point; NULL for none."""
    out = None
    for p in panels if last else reversed(panels):
        inside = (col >= p.min_fs) & (col <= p.max_fs) & (row >= p.min_ss) & (row <= p.max_ss)
        out = F.when(inside, F.lit(p.name)) if out is None else F.when(inside, F.lit(p.name)).otherwise(out)
    return out if out is not None else F.lit(None).cast("string")


def panel_stats(pixels: DataFrame, panels: Sequence[Panel]) -> DataFrame:
    """``panel, n, mean, var, pixels``; pixels of no panel are left out."""
    return _two_level(pixels.withColumn("panel", panel_of(F.col("row"), F.col("col"), panels, last=True)).where("panel IS NOT NULL"), "panel")


def dead_mask(pixels: DataFrame, warmup: int = 16) -> DataFrame:
    """``row, col, valid``: a pixel is dead if it does not vary over the first frames."""
    return pixels.where(F.col("frame_index") < warmup).groupBy("row", "col").agg((spread(F.col("adu")) > 0).alias("valid"))


def _ordered(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__x")))).alias("s"))


def robust_fold(df: DataFrame, key: str, order: Sequence[str], value: str, k: float = 5.0, least: int = 4) -> DataFrame:
    """``key, n, mean, var, clipped``: the online update that clips before it learns.

    In order, a value above mean + k standard deviations is cut down to that once ``least`` values
    have been learned and they vary; then it updates mean and variance. The recursion depends on the
    order, so a key's values are folded as one array; keys are pixels or the like, whose number of
    values is the number of frames. NULL values are skipped.
    """
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.lit(0).cast("long").alias("clipped"))

    def step(s: Column, e: Column) -> Column:
        std = F.when(s["n"] >= 2, F.sqrt(s["m2"] / (s["n"] - 1))).otherwise(F.lit(0.0))
        top = s["mean"] + F.lit(k) * std
        cut = (s["n"] >= least) & (std > 0) & (e["__x"] > top)
        x = F.when(cut, top).otherwise(e["__x"])
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"), (s["clipped"] + cut.cast("long")).alias("clipped"))

    folded = _ordered(df, key, order, value).select(key, F.aggregate("s", zero, step).alias("f"))
    var = F.when(F.col("f.n") >= 2, F.col("f.m2") / (F.col("f.n") - 1)).otherwise(F.lit(0.0))
    return folded.select(key, F.col("f.n").alias("n"), F.col("f.mean").alias("mean"), var.alias("var"), F.col("f.clipped").alias("clipped"))


def clipped_values(df: DataFrame, key: str, order: Sequence[str], value: str, k: float = 5.0, least: int = 4) -> DataFrame:
    """``key, order…, x``: each value as ``robust_fold`` learns it, cut down where it lies too high.

    For seed frames, whose number is a parameter: a key's values and their clipped ones are two arrays.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"), F.array().cast("array<double>").alias("out"))

    def step(s: Column, e: Column) -> Column:
        std = F.when(s["n"] >= 2, F.sqrt(s["m2"] / (s["n"] - 1))).otherwise(F.lit(0.0))
        top = s["mean"] + F.lit(k) * std
        x = F.when((s["n"] >= least) & (std > 0) & (e["__x"] > top), top).otherwise(e["__x"])
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["m2"] + (x - s["mean"]) * (x - mean)).alias("m2"), F.concat(s["out"], F.array(x)).alias("out"))

    folded = _ordered(df, key, order, value).select(key, "s", F.aggregate("s", start, step)["out"].alias("out"))
    return folded.select(key, F.explode(F.arrays_zip("s", "out")).alias("e")).select(key, *[F.col(f"e.s.{o}").alias(o) for o in order], F.col("e.out").alias("x"))


def ewma_fold(df: DataFrame, key: str, order: Sequence[str], value: str, decay: float = 0.95) -> DataFrame:
    """``key, n, mean, var`` with exponentially fading memory, both starting at 0."""
    if not 0 < decay < 1:
        raise ValueError("decay must lie between 0 and 1")
    a = 1.0 - decay
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("var"))

    def step(s: Column, e: Column) -> Column:
        d = e["__x"] - s["mean"]
        return F.struct((s["n"] + 1).alias("n"), (s["mean"] + F.lit(a) * d).alias("mean"), (F.lit(decay) * (s["var"] + F.lit(a) * d * d)).alias("var"))

    return _ordered(df, key, order, value).select(key, F.aggregate("s", zero, step).alias("f")).select(key, "f.n", "f.mean", "f.var")


def frame_stats(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """``key, n, mean, var`` of the mode that forgets after each frame: the last value alone."""
    last = df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(F.col(value).cast("double"), F.struct(*order)).alias("mean"))
    return last.select(key, F.lit(1).cast("long").alias("n"), "mean", F.lit(0.0).alias("var"))


def running_stats(pixels: DataFrame) -> DataFrame:
    """Each pixel with the statistics of all frames up to and including its own."""
    w = Window.partitionBy("row", "col").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.select("*", F.count("adu").over(w).alias("n"), F.avg("adu").over(w).alias("mean"), F.coalesce(F.var_samp("adu").over(w), F.lit(0.0)).alias("var"))


def drift(pixels: DataFrame, every: int = 50) -> DataFrame:
    """``step, mean_shift, var_ratio_log, kl_gaussian, effective_n, n_masked`` every so many frames,
    against the previous record (zeros before the first)."""
    least = F.lit(1e-12)
    at = running_stats(pixels).where(F.col("n") % every == 0)
    w = Window.partitionBy("row", "col").orderBy("n")
    both = at.select(
        F.col("n").alias("step"), "mean", F.greatest("var", least).alias("v"), (F.col("var") > 0).alias("valid"),
        F.coalesce(F.lag("mean").over(w), F.lit(0.0)).alias("mean0"), F.greatest(F.coalesce(F.lag("var").over(w), F.lit(0.0)), least).alias("v0"),
    )
    dm = F.col("mean") - F.col("mean0")
    kl = 0.5 * (F.log(F.col("v0") / F.col("v")) + (F.col("v") + dm * dm) / F.col("v0") - 1.0)
    mean_valid = lambda x: F.coalesce(F.avg(F.when(F.col("valid"), x)), F.lit(0.0))
    return both.groupBy("step").agg(
        mean_valid(F.abs(dm)).alias("mean_shift"), mean_valid(F.log(F.col("v") / F.col("v0"))).alias("var_ratio_log"), mean_valid(kl).alias("kl_gaussian"),
        F.max("step").cast("double").alias("effective_n"), F.count_if(~F.col("valid")).alias("n_masked"),
    )


def shrunk_background(pixels: DataFrame, seed: int, height: int, width: int, warmup: int = 16) -> DataFrame:
    """Each pixel with the mean that shrinks from its ring to itself as frames accrue, and z.

    The statistics are those of the first ``seed`` frames: w = min(1, n / warmup).
    """
    first = pixels.where(F.col("frame_index") < seed)
    ring = radial_stats(first, height, width).select("bin", F.col("mean").alias("ring_mean"))
    own = pixel_stats(first).withColumn("bin", radial_bin(F.col("row"), F.col("col"), height, width))
    # One row per pixel of the detector: of fixed size, whatever the number of frames.
    model = own.join(F.broadcast(ring), "bin").withColumn("w", F.least(F.lit(1.0), F.col("n") / F.lit(float(max(1, warmup)))))
    model = model.select("row", "col", (F.col("w") * F.col("mean") + (1.0 - F.col("w")) * F.col("ring_mean")).alias("mean"), F.greatest("var", F.lit(1e-12)).alias("var"))
    return pixels.join(model, ["row", "col"]).withColumn("z", (F.col("adu") - F.col("mean")) / F.sqrt("var"))
