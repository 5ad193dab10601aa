"""From scored pixels to peaks: components of foreground pixels, their statistics and filters."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.stencil import by_frames

BLOB_FIELDS = (
    "size long, row double, col double, intensity double, sigma double, max_excess double, max_z double, log_bf double, posterior double, "
    "row_lo int, row_hi int, col_lo int, col_hi int, eccentricity double, peakedness double"
)


def label_rows(frame: np.ndarray, row: np.ndarray, col: np.ndarray, connectivity: int = 2) -> np.ndarray:
    """Labels 1, 2, … per frame of distinct pixels in (frame, row, col) order, by their first pixel.

    Pixels that touch (8- or 4-fold) find each other by their place; then minimum labels spread along
    the edges, with pointer jumping, over all frames at once.
    """
    n = len(row)
    f = np.cumsum(np.concatenate([[0], frame[1:] != frame[:-1]]))
    tall, wide = int(row.max()) - int(row.min()) + 2, int(col.max()) - int(col.min()) + 3
    place = (f * tall + (row - row.min())) * wide + (col - col.min()) + 1  # a margin on each side, so no row runs into the next
    ends = []
    for step in (1, wide, *((wide - 1, wide + 1) if connectivity == 2 else ())):
        at = np.minimum(np.searchsorted(place, place + step), n - 1)
        hit = np.flatnonzero(place[at] == place + step)
        ends.append((hit, at[hit]))
    a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
    label = np.arange(n)
    while True:
        was = label.copy()
        least = np.minimum(label[a], label[b])
        for side in (a, b):
            np.minimum.at(label, label[side], least)
            np.minimum.at(label, side, least)
        label = label[label]
        if (label == was).all():
            break
    first = np.cumsum(label == np.arange(n))
    start = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
    return (first[label] - (first[start] - 1)[f]).astype(np.int32)


def label_components(fg: DataFrame, width: int, connectivity: int = 2) -> DataFrame:
    """``fg`` with ``label``: components of each frame numbered 1, 2, … by their first pixel in raster order.

    ``fg`` holds ``frame_index, row, col`` of the foreground pixels alone, once each; rows with a
    NULL there are left out, other columns pass through. Components never leave a frame, so one
    shuffle by frame is all; graphs that span tasks have ``components.connected_components``.
    """

    def number(t: pa.Table) -> pa.Table:
        got = label_rows(*(t[c].to_numpy() for c in ("frame_index", "row", "col")), connectivity)
        return t.append_column("label", pa.array(got))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fg.schema.fields if f.name != "label")
    return by_frames(fg.drop("label"), number, schema + ", label int")


def label_array(mask: np.ndarray, connectivity: int = 2) -> np.ndarray:
    """Labels of one image by union-find over its foreground pixels; 0 is background."""
    h, w = mask.shape
    pix = np.flatnonzero(mask)
    parent = {int(p): int(p) for p in pix}

    def find(p: int) -> int:
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        return p

    steps = [(0, -1), (-1, 0)] + ([(-1, -1), (-1, 1)] if connectivity == 2 else [])
    for p in pix.tolist():
        r, c = divmod(p, w)
        for dr, dc in steps:
            if r + dr >= 0 and 0 <= c + dc < w and (q := p + dr * w + dc) in parent:
                a, b = find(p), find(q)
                if a != b:
                    parent[max(a, b)] = min(a, b)
    roots = np.array([find(p) for p in pix.tolist()], np.int64)
    out = np.zeros(h * w, np.int32)
    if len(pix):
        out[pix] = np.unique(roots, return_inverse=True)[1] + 1
    return out.reshape(h, w)


def blob_stats(labelled: DataFrame) -> DataFrame:
    """One row per (frame, label) with the fields of a peak candidate.

    Needs ``frame_index, label, row, col, excess, var, z`` and, if there, ``log_bf`` and
    ``posterior``. Positions are weighted by the excess above 0 (plain means where there is none).
    Second moments are taken about the centroid in a second pass, not from raw moments.
    """
    have = labelled.columns
    lbf = F.col("log_bf") if "log_bf" in have else F.lit(0.0)
    post = F.col("posterior") if "posterior" in have else F.lit(None).cast("double")
    w = F.greatest(F.col("excess"), F.lit(0.0))
    keys = ["frame_index", "label"]
    first = labelled.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("size"), F.sum(w).alias("w"), F.sum(w * F.col("row")).alias("wr"), F.sum(w * F.col("col")).alias("wc"),
        F.avg("row").alias("mr"), F.avg("col").alias("mc"), F.sum("excess").alias("intensity"), F.sqrt(F.sum(F.greatest("var", F.lit(0.0)))).alias("sigma"),
        F.max("excess").alias("max_excess"), F.max("z").alias("max_z"), F.sum(lbf).alias("log_bf"), F.avg(post).alias("posterior"),
        F.min("row").alias("row_lo"), (F.max("row") + 1).alias("row_hi"), F.min("col").alias("col_lo"), (F.max("col") + 1).alias("col_hi"), F.avg("excess").alias("mean_excess"),
    )
    first = first.select("*", F.when(F.col("w") > 0, F.col("wr") / F.col("w")).otherwise(F.col("mr")).alias("r0"), F.when(F.col("w") > 0, F.col("wc") / F.col("w")).otherwise(F.col("mc")).alias("c0"))
    dr, dc = F.col("row") - F.col("r0"), F.col("col") - F.col("c0")
    second = (
        labelled.select(*keys, "row", "col", w.alias("pw"))
        .join(first.select(*keys, "r0", "c0"), keys)
        .groupBy(*keys)
        .agg(F.sum(F.col("pw") * dr * dr).alias("rr"), F.sum(F.col("pw") * dc * dc).alias("cc"), F.sum(F.col("pw") * dr * dc).alias("rc"))
    )
    t = F.greatest(F.col("w"), F.lit(1e-12))
    both = first.join(second, keys).withColumn("a", F.col("rr") / t).withColumn("b", F.col("cc") / t).withColumn("c", F.col("rc") / t)
    root = F.sqrt(F.greatest((F.col("a") + F.col("b")) ** 2 - 4.0 * (F.col("a") * F.col("b") - F.col("c") * F.col("c")), F.lit(0.0)))
    big, small = (F.col("a") + F.col("b") + root) / 2.0, (F.col("a") + F.col("b") - root) / 2.0
    return both.select(
        *keys, "size", F.col("r0").alias("row"), F.col("c0").alias("col"), "intensity", "sigma", "max_excess", "max_z", "log_bf", "posterior", "row_lo", "row_hi", "col_lo", "col_hi",
        F.when(small > 1e-12, big / small).otherwise(F.lit(float("inf"))).alias("eccentricity"),
        F.when(F.col("mean_excess") > 1e-12, F.col("max_excess") / F.col("mean_excess")).otherwise(0.0).alias("peakedness"),
    )


def keep_blobs(size_min: int = 2, size_max: int = 30, eccentricity_max: float = 5.0, peakedness_min: float = 1.2):
    """The condition of an acceptable blob; all bounds inclusive."""
    return F.col("size").between(size_min, size_max) & (F.col("eccentricity") <= eccentricity_max) & (F.col("peakedness") >= peakedness_min)


def without_blowups(blobs: DataFrame, max_peaks: int = 1000) -> DataFrame:
    """Drop all blobs of frames that have more than ``max_peaks`` of them: such frames are no diffraction.

    Counts are pre-aggregated per frame and joined, so a frame with very many blobs meets no window.
    """
    fine = blobs.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_peaks)
    return blobs.join(fine.select("frame_index"), "frame_index", "left_semi")


def array_blobs(labels: np.ndarray, excess: np.ndarray, var: np.ndarray, z: np.ndarray, log_bf: np.ndarray, posterior: np.ndarray) -> pd.DataFrame:
    """``blob_stats`` of one labelled image."""
    at = np.flatnonzero(labels)
    if not len(at):
        return pd.DataFrame({c.split()[0]: [] for c in ("label int", *BLOB_FIELDS.split(", "))})
    rr, cc = np.divmod(at, labels.shape[1])
    e, v, zz, bf, po = (x.ravel()[at] for x in (excess, var, z, log_bf, posterior))
    g = pd.DataFrame({"label": labels.ravel()[at], "r": rr, "c": cc, "e": e, "v": np.maximum(v, 0), "z": zz, "bf": bf, "po": po, "w": np.maximum(e, 0)})
    g["wr"], g["wc"] = g.w * g.r, g.w * g.c
    s = g.groupby("label").agg(
        size=("e", "size"), w=("w", "sum"), wr=("wr", "sum"), wc=("wc", "sum"), mr=("r", "mean"), mc=("c", "mean"), intensity=("e", "sum"), v=("v", "sum"),
        max_excess=("e", "max"), max_z=("z", "max"), log_bf=("bf", "sum"), posterior=("po", "mean"), row_lo=("r", "min"), row_hi=("r", "max"), col_lo=("c", "min"), col_hi=("c", "max"), mean_e=("e", "mean"),
    )
    with np.errstate(all="ignore"):
        s["row"] = np.where(s.w > 0, s.wr / s.w, s.mr)
        s["col"] = np.where(s.w > 0, s.wc / s.w, s.mc)
        dr, dc = g.r - g.label.map(s["row"]), g.c - g.label.map(s["col"])
        t = np.maximum(s.w, 1e-12)
        a, b, c = ((g.w * x).groupby(g.label).sum() / t for x in (dr * dr, dc * dc, dr * dc))
        root = np.sqrt(np.maximum((a + b) ** 2 - 4 * (a * b - c * c), 0))
        big, small = (a + b + root) / 2, (a + b - root) / 2
        s["eccentricity"] = np.where(small > 1e-12, big / np.where(small > 1e-12, small, 1), np.inf)
        s["peakedness"] = np.where(s.mean_e > 1e-12, s.max_excess / np.where(s.mean_e > 1e-12, s.mean_e, 1), 0.0)
    s["sigma"] = np.sqrt(s.v)
    s["row_hi"] += 1
    s["col_hi"] += 1
    return s.reset_index()[["label", *[c.split()[0] for c in BLOB_FIELDS.split(", ")]]]
