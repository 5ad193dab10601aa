"""Scoring and integrating dense frames: the image operators as kernels over one frame per row.

The learned background is one image per statistic; it is broadcast, and its size is that of the
detector, not of the run (checked against ``MODEL_BYTES``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from lumenframe.functions.scoring import prior_log_odds
from lumenframe.operators.blobs import BLOB_FIELDS, array_blobs, label_array
from lumenframe.operators.stencil import annulus_dense, correlate_dense, dilate, gaussian, matched_dense

MODEL_BYTES = 1 << 30


@dataclass(frozen=True)
class FinderRule:
    """Parameters of scoring, candidate selection and blob filters."""

    kappa: float = 10.0
    prior: float = 1e-3
    posterior_threshold: float = 0.5
    matched: bool = True
    scales: tuple[float, ...] = (1.0, 1.6, 2.4)
    threshold: float = 5.0
    inner: int = 4
    outer: int = 9
    local: bool = True
    flux: tuple[float, float] | None = None
    flux_floor: float = 0.15
    size_min: int = 2
    size_max: int = 30
    eccentricity_max: float = 5.0
    peakedness_min: float = 1.2
    connectivity: int = 2
    max_peaks: int = 1000

    def __post_init__(self):
        if self.kappa <= 1 or not 0 < self.prior < 1 or not 0 < self.posterior_threshold < 1:
            raise ValueError("kappa must exceed 1, prior and posterior threshold lie between 0 and 1")
        if not 0 < self.inner < self.outer:
            raise ValueError("the inner radius must be positive and smaller than the outer")


@dataclass(frozen=True)
class Background:
    """Mean, variance and validity of each pixel, and unit-norm background modes (mode, row, col)."""

    mean: np.ndarray
    var: np.ndarray
    valid: np.ndarray
    modes: np.ndarray | None = None

    def __post_init__(self):
        if sum(x.nbytes for x in (self.mean, self.var, self.valid, self.modes) if x is not None) > MODEL_BYTES:
            raise ValueError("the detector is too large to broadcast its background")


def background_of(stats: DataFrame, height: int, width: int, valid: DataFrame | None = None) -> Background:
    """Collect per-pixel statistics (``row, col, mean, var``) into images; unseen pixels are invalid."""
    p = stats.select("row", "col", "mean", "var").toPandas()
    mean, var, ok = np.zeros((height, width)), np.zeros((height, width)), np.zeros((height, width), bool)
    mean[p["row"], p["col"]], var[p["row"], p["col"]], ok[p["row"], p["col"]] = p["mean"], p["var"], True
    if valid is not None:
        v = valid.where("NOT valid").select("row", "col").toPandas()
        ok[v["row"], v["col"]] = False
    return Background(mean, var, ok)


def score_image(x: np.ndarray, bg: Background, rule: FinderRule) -> dict[str, np.ndarray]:
    """Excess, z, log Bayes factor, posterior, effective mean and variance, and filter response."""
    m, v0 = bg.valid & np.isfinite(x), np.maximum(bg.var, 1e-12)
    x = np.where(m, x, bg.mean)
    mean, var = bg.mean, v0
    if bg.modes is not None:
        clipped = np.minimum(x - mean, 5.0 * np.sqrt(v0)) * m
        mean = mean + np.tensordot(np.tensordot(bg.modes, clipped, 2), bg.modes, 1)
    if rule.local:
        local, spread = annulus_dense(x - mean, v0, m, rule.inner, rule.outer)
        mean = mean + local
        if rule.flux:
            read, gain = rule.flux
            var = np.maximum(np.maximum(np.maximum(read + gain * np.maximum(mean, 0), rule.flux_floor * v0), 1e-12), spread)
        else:
            var = np.maximum(v0, spread)
    excess = x - mean
    z = np.where(m, excess / np.sqrt(var), 0.0)
    bf = np.where(m & (excess > 0), -np.log(rule.kappa) + 0.5 * (1 - rule.kappa**-2) * z * z, 0.0)
    k = gaussian(5, 1.0)
    mm = m.astype(float)
    smooth = correlate_dense((bf + prior_log_odds(rule.prior)) * mm, k, "reflect") / np.maximum(correlate_dense(mm, k, "reflect"), 1e-12)
    posterior = np.where(m, 1 / (1 + np.exp(-smooth)), 0.0)
    out = {"excess": np.where(m, excess, 0.0), "z": z, "log_bf": bf, "posterior": posterior, "mean": mean, "var": var, "mask": m}
    if rule.matched:
        out["t"] = matched_dense(z, m, rule.scales)
    return out


def candidates(s: dict[str, np.ndarray], rule: FinderRule) -> np.ndarray:
    return ((s["t"] > rule.threshold) if rule.matched else (s["posterior"] > rule.posterior_threshold)) & s["mask"]


def find_in_image(x: np.ndarray, bg: Background, rule: FinderRule) -> pd.DataFrame:
    """Kept blobs of one image; none if there are too many to be peaks."""
    s = score_image(x, bg, rule)
    blobs = array_blobs(label_array(candidates(s, rule), rule.connectivity), s["excess"], s["var"], s["z"], s["log_bf"], s["posterior"])
    if len(blobs) > rule.max_peaks:
        return blobs.iloc[:0]
    ok = blobs["size"].between(rule.size_min, rule.size_max) & (blobs["eccentricity"] <= rule.eccentricity_max) & (blobs["peakedness"] >= rule.peakedness_min)
    return blobs[ok]


PEAK_SCHEMA = "frame_index long, label int, " + BLOB_FIELDS


def find_peaks(frames: DataFrame, bg: Background, rule: FinderRule = FinderRule()) -> DataFrame:
    """Peaks of dense frames (``frame_index, pixels``): one row per kept blob. Frozen background, so
    frames are independent; frames without peaks give no rows, a NULL image neither."""
    shared = frames.sparkSession.sparkContext.broadcast(bg)
    shape = bg.mean.shape
    names = [c.split()[0] for c in PEAK_SCHEMA.split(", ")]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, p in zip(b["frame_index"], b["pixels"], strict=True):
                if p is not None and len(p) == shape[0] * shape[1]:
                    got = find_in_image(np.asarray(p, float).reshape(shape), shared.value, rule)
                    got.insert(0, "frame_index", int(f))
                    out.append(got)
            yield pd.concat(out)[names] if out else pd.DataFrame({n: pd.Series(dtype=object) for n in names})

    return frames.select("frame_index", "pixels").mapInPandas(kernel, PEAK_SCHEMA)


def integrate_image(s: dict[str, np.ndarray], rows: np.ndarray, cols: np.ndarray, radius: int, gain: float, n_bg: int) -> np.ndarray:
    """Intensity, sigma, peak and background of boxes, each pixel owned by its nearest centre."""
    h, w = s["z"].shape
    d = np.arange(-radius, radius + 1)
    dr, dc = (x.ravel() for x in np.meshgrid(d, d, indexing="ij"))
    r, c = np.rint(rows).astype(int)[:, None] + dr, np.rint(cols).astype(int)[:, None] + dc
    ok = (r >= 0) & (r < h) & (c >= 0) & (c < w)
    which = np.broadcast_to(np.arange(len(rows))[:, None], r.shape)[ok]
    dist = ((r - rows[:, None]) ** 2 + (c - cols[:, None]) ** 2)[ok]
    pix = r[ok] * w + c[ok]
    least = np.full(h * w, np.inf)
    np.minimum.at(least, pix, dist)
    near = dist <= least[pix] + 1e-6
    owner = np.full(h * w, len(rows))
    np.minimum.at(owner, pix[near], which[near])
    mine = (owner[pix] == which) & s["mask"].ravel()[pix]
    which, pix = which[mine], pix[mine]
    n = np.bincount(which, minlength=len(rows))
    total = lambda x: np.bincount(which, x.ravel()[pix], len(rows))
    intensity, var = total(s["excess"]), total(s["var"])
    peak = np.full(len(rows), -np.inf)
    np.maximum.at(peak, which, s["excess"].ravel()[pix])
    sigma = np.sqrt(np.maximum(var, 0) * (1 + n / n_bg) + np.maximum(intensity, 0) * gain)
    return np.stack([intensity, sigma, np.where(n > 0, peak, 0.0), total(s["mean"]) / np.maximum(n, 1)], axis=1)


BOX_SCHEMA = "frame_index long, refl long, row double, col double, intensity double, sigma double, peak double, background double, bright boolean, bright_rate double"


def integrate_frames(frames: DataFrame, predicted: DataFrame, bg: Background, rule: FinderRule = FinderRule(), radius: int = 3, gain: float = 1.0, n_bg: int = 280) -> DataFrame:
    """Integrated reflections of dense frames, with whether their place is bright and the frame's rate.

    ``predicted`` holds ``frame_index, refl, row, col``; a frame's predictions are bounded by its
    lattice and detector.
    """
    from pyspark.sql import functions as F

    wanted = predicted.select("frame_index").distinct()
    frames = frames.join(wanted, "frame_index", "left_semi")  # only images with predictions move, if any do
    lists = predicted.groupBy("frame_index").agg(F.sort_array(F.collect_list(F.struct("refl", "row", "col"))).alias("p"))
    shared = frames.sparkSession.sparkContext.broadcast(bg)
    shape = bg.mean.shape
    names = [c.split()[0] for c in BOX_SCHEMA.split(", ")]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, x, p in zip(b["frame_index"], b["pixels"], b["p"], strict=True):
                s = score_image(np.asarray(x, float).reshape(shape), shared.value, rule)
                refl, rows, cols = (np.array([e[k] for e in p]) for k in ("refl", "row", "col"))
                got = integrate_image(s, rows.astype(float), cols.astype(float), radius, gain, n_bg)
                hot = (dilate(np.where(s["mask"], s["z"], -np.inf), 2) > rule.threshold) & s["mask"]
                at = np.clip(np.rint(rows).astype(int), 0, shape[0] - 1), np.clip(np.rint(cols).astype(int), 0, shape[1] - 1)
                rate = float(hot.sum() / max(s["mask"].sum(), 1))
                bright = [bool(v) if ok else None for v, ok in zip(hot[at], s["mask"][at], strict=True)]
                out.append(pd.DataFrame({"frame_index": int(f), "refl": refl, "row": rows, "col": cols, **dict(zip(names[4:8], got.T, strict=True)), "bright": pd.Series(bright, dtype=object), "bright_rate": rate}))
            yield pd.concat(out)[names] if out else pd.DataFrame({n: pd.Series(dtype=object) for n in names})

    return frames.select("frame_index", "pixels").join(lists, "frame_index").mapInPandas(kernel, BOX_SCHEMA)


def frame_scales(frames: DataFrame, bg: Background, k: float = 5.0) -> DataFrame:
    """``frame_index, scale, sigma, offset``: each frame's weighted straight line against the background.

    Five weighted sums over the valid pixels of an image, taken where it is; weights 1 / variance, pixels
    more than ``k`` deviations above the background left out. An image that is NULL or of another size
    gives no row, one without a usable pixel neither.
    """
    shared, shape = frames.sparkSession.sparkContext.broadcast(bg), bg.mean.shape

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bg = shared.value
        good = bg.valid & (bg.var > 0)
        top = bg.mean + k * np.sqrt(np.maximum(bg.var, 0))
        for b in batches:
            out = []
            for f, p in zip(b["frame_index"], b["pixels"], strict=True):
                if p is None or len(p) != shape[0] * shape[1]:
                    continue
                y = np.asarray(p, float).reshape(shape)
                ok = good & np.isfinite(y) & (y < top)
                if not ok.any():
                    continue
                w, x, y = 1.0 / bg.var[ok], bg.mean[ok], y[ok]
                s, sx, sxx, sy, sxy = w.sum(), w @ x, w @ (x * x), w @ y, w @ (x * y)
                det = max(s * sxx - sx * sx, 1e-12)
                out.append((int(f), (s * sxy - sx * sy) / det, np.sqrt(max(s / det, 0.0)), (sxx * sy - sx * sxy) / det))
            yield pd.DataFrame(out, columns=["frame_index", "scale", "sigma", "offset"])

    return frames.select("frame_index", "pixels").mapInPandas(kernel, "frame_index long, scale double, sigma double, offset double")
