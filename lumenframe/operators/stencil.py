"""Stencils over pixels: as range windows on the long form, and as a kernel on dense frames.

The window form of boxes sums rows, then columns (two sorts, no neighbour explosion) and minds missing
pixels, because it works on ranges of coordinates. Weighted stencils and labels of the long form go
frame by frame through a kernel (``by_frames``): one shuffle, no copy of a pixel per tap. The dense form takes one frame per row and is the
one for large detectors: millions of pixels per frame never become rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.session import spread


def _range(across: str, along: str, r: int):
    return Window.partitionBy("frame_index", across).orderBy(along).rangeBetween(-r, r)


def _two_pass(pixels: DataFrame, values: dict[str, Column], r: int, fold: Callable[[Column], Column]) -> DataFrame:
    first = pixels.select("*", *[fold(v).over(_range("row", "col", r)).alias(f"__{n}") for n, v in values.items()])
    second = first.select("*", *[fold(F.col(f"__{n}")).over(_range("col", "row", r)).alias(n) for n in values])
    return second.drop(*[f"__{n}" for n in values])


def box_sum(pixels: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """``pixels`` with the sums of ``values`` over the (2 radius + 1)² box, nothing beyond the frame."""
    return _two_pass(pixels, values, radius, F.sum)


def box_max(pixels: DataFrame, values: dict[str, Column], radius: int) -> DataFrame:
    """``pixels`` with the maxima over the box: a dilation; NULLs are passed over."""
    return _two_pass(pixels, values, radius, F.max)


def annulus_background(pixels: DataFrame, residual: str = "x", var: str = "var", inner: int = 4, outer: int = 9, clip: float = 5.0) -> DataFrame:
    """``local_count, local_mean, local_var`` of the residual in the ring between two boxes.

    The residual is capped at ``clip`` standard deviations above 0; a NULL residual is masked.
    """
    capped = F.least(F.col(residual), F.lit(clip) * F.sqrt(F.greatest(F.col(var), F.lit(0.0))))
    on = F.col(residual).isNotNull()
    terms = {"m": F.when(on, 1.0).otherwise(0.0), "s": F.when(on, capped).otherwise(0.0), "q": F.when(on, capped * capped).otherwise(0.0)}
    wide = box_sum(pixels, {f"o_{k}": v for k, v in terms.items()}, outer)
    both = box_sum(wide, {f"i_{k}": v for k, v in terms.items()}, inner)
    n = F.greatest(F.col("o_m") - F.col("i_m"), F.lit(1.0))
    mean = (F.col("o_s") - F.col("i_s")) / n
    out = both.withColumn("local_count", F.col("o_m") - F.col("i_m")).withColumn("local_mean", mean)
    out = out.withColumn("local_var", F.greatest((F.col("o_q") - F.col("i_q")) / n - F.col("local_mean") * F.col("local_mean"), F.lit(0.0)))
    return out.drop(*[f"{s}_{k}" for s in "oi" for k in terms])


def gaussian(side: int, sigma: float) -> list[float]:
    """Normalised one-dimensional kernel of an odd side."""
    if side % 2 == 0:
        raise ValueError("the side of a kernel must be odd")
    half = side // 2
    g = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-half, half + 1)]
    return [x / sum(g) for x in g]


def matched_side(sigma: float) -> int:
    return 2 * math.ceil(3 * sigma) + 1


def by_frames(df: DataFrame, fn: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` applied to whole frames of the long form (``frame_index, row, col``, …), in that order.

    One shuffle by frame. ``fn`` gets one or more frames at a time as an Arrow table, as many as are
    complete; what is held is one frame more, so memory depends on the detector and not on the run.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            f = b.column("frame_index").to_numpy(zero_copy_only=False)
            start = int(np.searchsorted(f, f[-1]))  # rows come in order of the frame
            if start == 0 and (not held or held[-1].column("frame_index")[-1].as_py() == f[0]):
                held.append(b)
                continue
            yield from fn(pa.Table.from_batches([*held, b.slice(0, start)]).combine_chunks()).to_batches()
            held = [b.slice(start)]
        if held:
            yield from fn(pa.Table.from_batches(held).combine_chunks()).to_batches()

    whole = df.where("frame_index IS NOT NULL AND row IS NOT NULL AND col IS NOT NULL")
    return spread(whole, "frame_index").sortWithinPartitions("frame_index", "row", "col").mapInArrow(kernel, schema)


def _images(t: pa.Table, columns: Sequence[str], height: int, width: int) -> tuple[tuple[np.ndarray, ...], list[np.ndarray]]:
    """The places of the rows in a stack of their frames, and the columns as such stacks (0 where no row is)."""
    f = np.unique(t["frame_index"].to_numpy(), return_inverse=True)[1]
    at = f, t["row"].to_numpy(), t["col"].to_numpy()
    out = []
    for c in columns:
        x = np.zeros((int(f.max()) + 1, height, width))
        x[at] = t[c].to_numpy()
        out.append(x)
    return at, out


def _masked(pixels: DataFrame, value: str, mask: Column | None) -> DataFrame:
    m = F.when(mask if mask is not None else F.col(value).isNotNull(), 1.0).otherwise(0.0)
    return pixels.select(F.col("frame_index").cast("long").alias("frame_index"), F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), m.alias("m"), (F.coalesce(F.col(value).cast("double"), F.lit(0.0)) * m).alias("s"))


def gaussian_mean(pixels: DataFrame, value: str, side: int, sigma: float, height: int, width: int, mask: Column | None = None) -> DataFrame:
    """``frame_index, row, col, smooth`` of the pixels there are: Gaussian mean weighted by the mask,
    mirrored at the edges (without repeating them); 0 where the mask is empty all around."""
    k = gaussian(side, sigma)

    def smooth(t: pa.Table) -> pa.Table:
        at, (m, s) = _images(t, ("m", "s"), height, width)
        m, s = correlate_dense(m, k, "reflect"), correlate_dense(s, k, "reflect")
        got = np.where(m > 0, s / np.maximum(m, 1e-12), 0.0)
        return t.select(["frame_index", "row", "col"]).append_column("smooth", pa.array(got[at]))

    return by_frames(_masked(pixels, value, mask), smooth, "frame_index long, row int, col int, smooth double")


def matched_filter(pixels: DataFrame, z: str, scales: Sequence[float], height: int, width: int, mask: Column | None = None) -> DataFrame:
    """``frame_index, row, col, t`` of the pixels there are: the largest response over the scales of a
    unit-norm Gaussian, nothing beyond the frame."""

    def respond(t: pa.Table) -> pa.Table:
        at, (m, s) = _images(t, ("m", "s"), height, width)
        return t.select(["frame_index", "row", "col"]).append_column("t", pa.array(matched_dense(s, m > 0, scales)[at]))

    return by_frames(_masked(pixels, z, mask), respond, "frame_index long, row int, col int, t double")


def local_maxima(pixels: DataFrame, value: str) -> DataFrame:
    """Pixels that reach the maximum of their 3x3 neighbourhood."""
    return box_max(pixels, {"near_max": F.col(value)}, 1).where(F.col(value) >= F.col("near_max")).drop("near_max")


# --- dense frames -----------------------------------------------------------------------------------


def shift_sum(x: np.ndarray, r: int) -> np.ndarray:
    """Box sums of a stack (…, H, W) by running sums along each axis."""
    for axis in (-1, -2):
        n = x.shape[axis]
        total = np.concatenate([np.zeros_like(np.take(x, [0], axis)), np.cumsum(x, axis=axis)], axis=axis)
        i = np.arange(n)
        x = np.take(total, np.minimum(i + r + 1, n), axis) - np.take(total, np.maximum(i - r, 0), axis)
    return x


def correlate_dense(x: np.ndarray, kernel: Sequence[float], mode: str) -> np.ndarray:
    """Separable correlation of a stack; ``mode`` is a padding mode of numpy ('reflect', 'constant')."""
    half = len(kernel) // 2
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (half, half)
        p = np.pad(x, pad, mode=mode)
        x = sum(k * np.take(p, np.arange(i, i + x.shape[axis]), axis) for i, k in enumerate(kernel))
    return x


def dilate(x: np.ndarray, r: int) -> np.ndarray:
    """Maximum over the box, -inf beyond the frame."""
    for axis in (-1, -2):
        pad = [(0, 0)] * x.ndim
        pad[axis] = (r, r)
        p = np.pad(x, pad, constant_values=-np.inf)
        x = np.max([np.take(p, np.arange(i, i + x.shape[axis]), axis) for i in range(2 * r + 1)], axis=0)
    return x


def annulus_dense(residual: np.ndarray, var: np.ndarray, mask: np.ndarray, inner: int = 4, outer: int = 9, clip: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Local mean and variance of a residual image in the ring, like ``annulus_background``."""
    m = mask.astype(float)
    x = np.minimum(residual, clip * np.sqrt(np.maximum(var, 0.0))) * m
    s = np.stack([m, x, x * x])
    ring = shift_sum(s, outer) - shift_sum(s, inner)
    n = np.maximum(ring[0], 1.0)
    mean = ring[1] / n
    return mean, np.maximum(ring[2] / n - mean * mean, 0.0)


def matched_dense(z: np.ndarray, mask: np.ndarray, scales: Sequence[float]) -> np.ndarray:
    m, best = mask.astype(float), None
    for sigma in scales:
        g = np.array(gaussian(matched_side(sigma), sigma))
        u = g / np.sqrt((g * g).sum())
        t = correlate_dense(z * m, u, "constant") / np.sqrt(np.maximum(correlate_dense(m, u * u, "constant"), 1e-12))
        best = t if best is None else np.maximum(best, t)
    return best
