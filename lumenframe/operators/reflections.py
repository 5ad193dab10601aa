"""Predicting, snapping, integrating and judging reflections."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions.geometry import Detector, q_to_detector
from lumenframe.functions.scoring import poisson_tail
from lumenframe.session import spread


def _a(name: str, r: int, c: int) -> Column:
    return F.col(name)[3 * r + c]


def inverse_rows(name: str) -> list[list[Column]]:
    """Rows of the inverse of a 3x3 matrix column, by cofactors."""
    m = [[_a(name, r, c) for c in range(3)] for r in range(3)]
    cof = lambda r, c: m[(r + 1) % 3][(c + 1) % 3] * m[(r + 2) % 3][(c + 2) % 3] - m[(r + 1) % 3][(c + 2) % 3] * m[(r + 2) % 3][(c + 1) % 3]
    det = m[0][0] * cof(0, 0) + m[0][1] * cof(0, 1) + m[0][2] * cof(0, 2)
    return [[cof(c, r) / det for c in range(3)] for r in range(3)]


def index_bounds(crystals: DataFrame, q_max: float, a: str = "a") -> DataFrame:
    """``crystals`` with ``h, k, l``: the largest index in each direction that the resolution sphere can
    hold, at least 1; it follows from the rows of the inverse matrix."""
    bound = [F.greatest(F.ceil(F.lit(q_max) * F.sqrt(sum((x * x for x in row[1:]), row[0] * row[0]))), F.lit(1)).cast("int") for row in inverse_rows(a)]
    return crystals.select("*", *[b.alias(n) for n, b in zip("hkl", bound, strict=True)])


def enumerate_hkl(crystals: DataFrame, q_max: float, a: str = "a") -> DataFrame:
    """``crystals`` with ``h, k, l``: every index triple within ``index_bounds``, without 0 0 0.

    For grids that are wanted whole; prediction solves for the shell instead (``shell_candidates``).
    """
    out = index_bounds(spread(crystals, a), q_max, a)
    for name in "hkl":
        out = out.withColumn(name, F.explode(F.sequence(-F.col(name), F.col(name))))
    return out.where("NOT (h = 0 AND k = 0 AND l = 0)")


#: Bits and offset of an index in a packed triple.
_BITS, _HALF = 21, 1 << 20


#: Tiles of the frame along each side, and directions in the plane of two indices, by which the lines that can meet the frame are bounded.
_TILES, _TURNS = 16, 32


def frame_corners(frame: tuple[float, ...]) -> tuple[np.ndarray, float]:
    """Directions to the corners of the frame's tiles, one pixel wider than the frame, and the largest secant of a tile:
    with weights from r to r times it, their convex hull holds every vector of length r that hits the frame."""
    far, row, col, height, width = frame
    r, c = np.meshgrid(np.linspace(-1.5, height + 0.5, _TILES + 1) - row, np.linspace(-1.5, width + 0.5, _TILES + 1) - col, indexing="ij")
    u = np.stack([c, r, np.full(c.shape, far)], axis=-1)
    u /= np.linalg.norm(u, axis=-1, keepdims=True)
    each = np.stack([u[:-1, :-1], u[1:, :-1], u[:-1, 1:], u[1:, 1:]])
    axis = each.sum(axis=0)
    axis /= np.linalg.norm(axis, axis=-1, keepdims=True)
    return u.reshape(-1, 3), 1.0 / float((each * axis).sum(axis=-1).min())


def shell_candidates(a: np.ndarray, q_max: float, wavelength: float, tol: float, corners: tuple[np.ndarray, float] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index triples (as numbers) among which are all with norm <= ``q_max`` and excitation < ``tol``, of those, with
    ``corners``, that hit the frame.

    For each pair of the two shorter indices the third lies in at most two short intervals, the roots of |s| = 1 + tol
    and |s| = 1 - tol. Only pairs are gone through whose line can meet the resolution sphere and the frame's part of the
    shell: a polygon bounds them, by the largest values along a few directions.
    """
    inv = np.linalg.inv(a)
    bound = np.maximum(np.ceil(q_max * np.linalg.norm(inv, axis=1)), 1).astype(int)
    if bound.max() >= _HALF:
        raise ValueError("an index bound beyond 2 ** 20")
    last = int(np.argmax(bound))
    first, second = [k for k in range(3) if k != last]
    t = tol * (1 + 1e-6) + 1e-9
    turn = math.pi * (np.arange(_TURNS) + 0.5) / _TURNS
    across, along = np.cos(turn) / bound[first], np.sin(turn) / bound[second]
    ahead = np.concatenate([across[:, None] * inv[first] + along[:, None] * inv[second], inv[[first, last]]])
    ahead = np.concatenate([ahead, -ahead])
    most = q_max * np.linalg.norm(ahead, axis=1)
    if corners is not None:
        reach = (ahead @ corners[0].T).max(axis=1)
        most = np.minimum(most, (np.maximum(reach * max(1 - t, 0.0), reach * ((1 + t) * corners[1])) - ahead[:, 2]) / wavelength)
    most = most * (1 + np.sign(most) * 1e-9) + 1e-9
    up, down = most[: _TURNS + 2], -most[_TURNS + 2 :]
    x = np.arange(math.ceil(down[_TURNS]), math.floor(up[_TURNS]) + 1.0)
    top = np.floor(((up[:_TURNS, None] - across[:, None] * x) / along[:, None]).min(axis=0))
    low = np.ceil(((down[:_TURNS, None] - across[:, None] * x) / along[:, None]).max(axis=0))
    n = np.maximum(top - low + 1, 0).astype(int)
    least, greatest = math.ceil(down[_TURNS + 1]), math.floor(up[_TURNS + 1])
    if not n.sum() or least > greatest:
        return (np.empty(0),) * 3
    v = wavelength * a[:, last]
    vv = float(v @ v)
    x, low = np.repeat(x, n), np.repeat(low - (np.cumsum(n) - n), n)
    y = low + np.arange(len(x))
    # The beam and the two shorter vectors across the line: in a plane with the first of them as an axis.
    side = [wavelength * a[:, first], wavelength * a[:, second], np.array([0.0, 0.0, 1.0])]
    slip = [float(w @ v) / vv for w in side]
    side = [w - k * v for w, k in zip(side, slip, strict=True)]
    e1 = side[0] / np.linalg.norm(side[0])
    e2 = np.cross(e1, v / math.sqrt(vv))
    off = x * float(side[0] @ e1) + y * float(side[1] @ e1)
    off += float(side[2] @ e1)
    off *= off
    other = y * float(side[1] @ e2) + float(side[2] @ e2)
    other *= other
    off += other  # squared distance of the line from the sphere's centre
    mid = x * -slip[0] - y * slip[1]
    mid -= slip[2]
    off /= -vv
    out = np.sqrt(np.maximum(off + (1 + t) ** 2 / vv, 0.0))
    out += 1e-6
    inner = np.sqrt(np.maximum(off + (1 - t) ** 2 / vv, 0.0)) if t < 1 else np.zeros(len(off))
    inner -= 1e-6
    lo1, hi1 = np.maximum(np.ceil(mid - out), least), np.minimum(np.floor(mid - inner), greatest)
    hi2 = np.minimum(np.floor(mid + out), greatest)
    lo2 = np.maximum(np.maximum(np.ceil(mid + inner), least), hi1 + 1)
    found = []
    for lo, hi in ((lo1, hi1), (lo2, hi2)):
        at = np.flatnonzero(hi >= lo)
        m = (hi[at] - lo[at]).astype(int) + 1
        if m.size and m.max() > 1:
            at, step = np.repeat(at, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            found.append((at, lo[at] + step))
        else:
            found.append((at, lo[at]))
    at = np.concatenate([f[0] for f in found])
    out = [np.empty(0)] * 3
    out[first], out[second], out[last] = x[at], y[at], np.concatenate([f[1] for f in found])
    return tuple(out)


def shell_triples(a: np.ndarray, q_max: float, wavelength: float, tol: float) -> np.ndarray:
    """Packed index triples of one matrix with norm <= ``q_max`` and excitation < ``tol`` (a hair more)."""
    h, k, l = shell_candidates(a, q_max, wavelength, tol)  # noqa: E741
    hkl = np.stack([h, k, l], axis=1)
    q = hkl @ a.T
    s = wavelength * q + np.array([0.0, 0.0, 1.0])
    keep = (np.sqrt((q * q).sum(axis=1)) <= q_max * (1 + 1e-9)) & (hkl != 0).any(axis=1)
    keep &= np.abs(np.sqrt((s * s).sum(axis=1)) - 1.0) < tol * (1 + 1e-6) + 1e-9
    hkl = hkl[keep].astype(np.int64) + _HALF
    return (hkl[:, 0] << 2 * _BITS) | (hkl[:, 1] << _BITS) | hkl[:, 2]


def _allowed(h: np.ndarray, k: np.ndarray, l: np.ndarray, centering: str | None) -> np.ndarray | None:  # noqa: E741
    """``lattice.allowed`` for the kernel; None keeps all."""
    even, third = (lambda x: x % 2 == 0), (lambda x: x % 3 == 0)
    rules = {
        "A": lambda: even(k + l), "B": lambda: even(h + l), "C": lambda: even(h + k), "I": lambda: even(h + k + l),
        "F": lambda: even(h + k) & even(h + l) & even(k + l), "R": lambda: third(-h + k + l), "H": lambda: third(h - k),
    }
    return rules.get((centering or "P").strip()[:1].upper(), lambda: None)()


#: Columns that prediction adds, and about how many rows its kernel hands on at a time.
PREDICTED = {"h": "int", "k": "int", "l": "int", "qx": "double", "qy": "double", "qz": "double", "qn": "double", "excitation": "double", "row": "double", "col": "double"}
_ROWS = 32768


def predict_reflections(
    crystals: DataFrame, d: Detector, q_max: float, height: int, width: int, eta: Column | float, size: float = 5e-5, bandwidth: float = 0.0,
    sigma: float = 1.5, least: float = 5e-4, centering: str | None = None, a: str = "a", columns: Sequence[str] | None = None,
) -> DataFrame:
    """``crystals`` × reflections near the Ewald sphere that hit the frame: h k l, q, excitation, position.

    ``columns`` names those wanted, of ``crystals`` and of the result; all by default, except ``together``: the number of
    the crystal's rows, which follow one another in one partition (flat detectors only). A matrix with a NULL gives no row.
    Without ``eta`` the tolerance is ``least``. One kernel solves for the triples, tests them and computes their
    columns, frame by frame, so that only reflections leave it.
    """
    wanted = list(columns) if columns else [*crystals.columns, *PREDICTED]
    made = [c for c in PREDICTED if c in wanted]
    if d.by_panels:  # Spark places them
        made = [c for c in PREDICTED if c in ("qx", "qy", "qz") or c in made and c not in ("row", "col")]
    elif "together" in wanted:
        made.append("together")
    kinds = PREDICTED | {"together": "int"}
    carried = [c for c in crystals.columns if c in wanted and c not in kinds]
    frame = None if d.by_panels else (d.clen / d.pixel_size, d.beam_row, d.beam_col, height, width)
    lam = d.wavelength

    def one(m: np.ndarray, eta: float | None, corners: tuple[np.ndarray, float] | None) -> list[np.ndarray]:
        radius = lambda q: 0.0 if eta is None else size + 0.5 * eta * q + 0.5 * lam * bandwidth * q * q
        h, k, l = shell_candidates(m, q_max, lam, max(lam * sigma * radius(0.0), lam * sigma * radius(q_max), least), corners)  # noqa: E741
        got = {"h": h, "k": k, "l": l}

        def drop(keep: np.ndarray) -> None:
            at = np.flatnonzero(keep)
            for c in got:
                got[c] = got[c][at]

        for r, c in enumerate(("qx", "qy", "qz")):
            got[c] = m[r, 0] * h + m[r, 1] * k + m[r, 2] * l
        got["qn"] = np.sqrt(got["qx"] * got["qx"] + got["qy"] * got["qy"] + got["qz"] * got["qz"])
        sx, sy, got["sz"] = lam * got["qx"], lam * got["qy"], lam * got["qz"] + 1.0
        got["excitation"] = np.sqrt(sx * sx + sy * sy + got["sz"] * got["sz"]) - 1.0
        keep = np.abs(got["excitation"]) < np.maximum(lam * sigma * radius(got["qn"]), least)
        keep &= (got["qn"] <= q_max) & (got["sz"] > 0) & ((h != 0) | (k != 0) | (l != 0))
        if (ok := _allowed(h, k, l, centering)) is not None:
            keep &= ok
        drop(keep)
        if frame:
            far, row0, col0, *_ = frame
            sz = np.maximum(got["sz"], 1e-30)
            got["row"], got["col"] = row0 + lam * got["qy"] * far / sz, col0 + lam * got["qx"] * far / sz
            drop((got["row"] >= 0) & (got["row"] <= height - 1) & (got["col"] >= 0) & (got["col"] <= width - 1))
        got["together"] = np.full(len(got["h"]), len(got["h"]))
        return [got[c].astype(np.int32) if kinds[c] == "int" else got[c] for c in made] if made else [got["h"]]

    def kernel(batches):
        corners = frame_corners(frame) if frame else None
        for b in batches:
            held, at, rows = [], [], 0
            mats, etas = b.column("__a").to_pylist(), b.column("__eta").to_pylist()
            for i, (m, eta) in enumerate(zip(mats, etas, strict=True)):
                if m is not None and len(m) == 9 and None not in m and np.isfinite(m).all() and not (eta is not None and math.isnan(eta)):
                    held.append(one(np.array(m).reshape(3, 3), eta, corners))
                    at.append(i)
                    rows += len(held[-1][0])
                if held and (rows >= _ROWS or i == len(mats) - 1):
                    back = pa.array(np.repeat(at, [len(x[0]) for x in held]))
                    new = [pa.array(np.concatenate([x[c] for x in held])) for c in range(len(made))]
                    yield pa.RecordBatch.from_arrays([*[b.column(c).take(back) for c in carried], *new], names=[*carried, *made])
                    held, at, rows = [], [], 0

    eta = eta if isinstance(eta, Column) else F.lit(float(eta))
    given = spread(crystals, a).select(*carried, F.col(a).cast("array<double>").alias("__a"), eta.cast("double").alias("__eta"))
    schema = T.StructType([*[crystals.schema[c] for c in carried], *[T.StructField(c, {"int": T.IntegerType(), "double": T.DoubleType()}[kinds[c]]) for c in made]])
    out = given.mapInArrow(kernel, schema)
    if d.by_panels:
        row, col = q_to_detector(F.col("qx"), F.col("qy"), F.col("qz"), d)
        out = out.withColumn("row", row).withColumn("col", col).where(f"row >= 0 AND row <= {height - 1} AND col >= 0 AND col <= {width - 1}")
    return out.select(*wanted)


def snap(predicted: DataFrame, observed: DataFrame, radius: float = 5.0) -> DataFrame:
    """``predicted`` (``frame_index, refl, row, col``) moved to the nearest observed peak within the radius.

    Candidates meet in cells of the radius' size (an equi-join), not by comparing all with all; of
    equally near peaks the first in (row, col) counts. Unmatched predictions stay; ``snapped`` tells.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    p = predicted.select("frame_index", "refl", "row", "col").withColumn("i", F.explode(F.array(*[cell("row") + s for s in (-1, 0, 1)]))).withColumn("j", F.explode(F.array(*[cell("col") + s for s in (-1, 0, 1)])))
    o = observed.select("frame_index", F.col("row").alias("orow"), F.col("col").alias("ocol"), cell("row").alias("i"), cell("col").alias("j"))
    d2 = (F.col("row") - F.col("orow")) ** 2 + (F.col("col") - F.col("ocol")) ** 2
    best = p.join(o, ["frame_index", "i", "j"]).where(d2 < radius * radius).groupBy("frame_index", "refl").agg(F.min(F.struct(d2.alias("d2"), "orow", "ocol")).alias("n"))
    out = predicted.join(best, ["frame_index", "refl"], "left")
    return out.select(
        *[c for c in predicted.columns if c not in ("row", "col")], F.coalesce("n.orow", "row").alias("row"), F.coalesce("n.ocol", "col").alias("col"), F.col("n").isNotNull().alias("snapped")
    )


def owned_pixels(centres: DataFrame, radius: int, height: int, width: int) -> DataFrame:
    """``frame_index, refl, row, col``: the box pixels of each centre (``frame_index, refl, row, col``),
    each pixel of a frame given to its nearest centre (to 1e-6), then to the smallest ``refl``."""
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    r0, c0 = F.rint("row").cast("int"), F.rint("col").cast("int")
    box = centres.select("frame_index", "refl", F.col("row").alias("cr"), F.col("col").alias("cc"), r0.alias("r0"), c0.alias("c0"))
    box = box.withColumn("dr", F.explode(steps)).withColumn("dc", F.explode(steps)).withColumn("row", F.col("r0") + F.col("dr")).withColumn("col", F.col("c0") + F.col("dc"))
    box = box.where(f"row >= 0 AND row < {height} AND col >= 0 AND col < {width}").withColumn("d2", (F.col("row") - F.col("cr")) ** 2 + (F.col("col") - F.col("cc")) ** 2)
    w = Window.partitionBy("frame_index", "row", "col")  # as many rows as boxes overlap in a pixel
    near = box.withColumn("least", F.min("d2").over(w)).where("d2 <= least + 1e-6")
    return near.groupBy("frame_index", "row", "col").agg(F.min("refl").alias("refl"))


def integrate_boxes(centres: DataFrame, pixels: DataFrame, radius: int, height: int, width: int, gain: float = 1.0, n_bg: int = 280) -> DataFrame:
    """``frame_index, refl, intensity, sigma, peak, background, n`` over the owned valid pixels.

    ``pixels`` holds ``frame_index, row, col, excess, var, mean`` of valid pixels. A centre that owns
    no pixel gets zeros.
    """
    own = owned_pixels(centres, radius, height, width)
    s = own.join(pixels.select("frame_index", "row", "col", "excess", "var", "mean"), ["frame_index", "row", "col"]).groupBy("frame_index", "refl").agg(
        F.count(F.lit(1)).alias("n"), F.sum("excess").alias("i"), F.sum("var").alias("v"), F.max("excess").alias("peak"), F.sum("mean").alias("b")
    )
    all_ = centres.select("frame_index", "refl").join(s, ["frame_index", "refl"], "left")
    zero = F.lit(0.0)
    n, i, v = F.coalesce("n", F.lit(0)), F.coalesce("i", zero), F.coalesce("v", zero)
    sigma = F.sqrt(F.greatest(v, zero) * (1.0 + n / F.lit(float(n_bg))) + F.greatest(i, zero) * F.lit(gain))
    return all_.select("frame_index", "refl", i.alias("intensity"), sigma.alias("sigma"), F.coalesce("peak", zero).alias("peak"), (F.coalesce("b", zero) / F.greatest(n, F.lit(1))).alias("background"), n.alias("n"))


def mosaicity(reflections: DataFrame, key: str, wavelength: float, prior: float, bandwidth: float = 0.0, lo_deg: float = 0.02, hi_deg: float = 0.8, least: int = 8) -> DataFrame:
    """``key, mosaicity``: twice the slope of the excitation against q, times sqrt(pi / 2), clamped.

    ``reflections`` holds ``qn`` and ``excitation`` of the indexed ones; too few give the prior.
    """
    r = F.greatest(F.abs("excitation") / wavelength - F.lit(0.5 * wavelength * bandwidth) * F.col("qn") ** 2, F.lit(0.0))
    s = reflections.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("qn") * r).alias("qr"), F.sum(F.col("qn") ** 2).alias("qq"))
    eta = F.least(F.greatest(2.0 * math.sqrt(math.pi / 2) * F.col("qr") / F.greatest("qq", F.lit(1e-30)), F.lit(math.radians(lo_deg))), F.lit(math.radians(hi_deg)))
    return s.select(key, F.when(F.col("n") >= least, eta).otherwise(F.lit(prior)).alias("mosaicity"))


def falloff_limit(reflections: DataFrame, key: str, q: str, isig: str, target: float = 1.0, shells: int = 10, least: int = 40) -> DataFrame:
    """``key, limit``: q at which the mean I / sigma of equal-count shells first falls below the target.

    Shell edges are floor(i n / shells); a shell's q is its upper median. Between the last shell above
    and the first below, linear interpolation; all above gives the largest q; fewer than ``least``
    reflections give NULL.
    """
    w = Window.partitionBy(key).orderBy(q, isig)
    r = reflections.where(F.col(q).isNotNull()).select(key, F.col(q).alias("q"), F.col(isig).alias("s"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    shell = F.floor(((F.col("i") + 1) * shells - 1) / F.col("n"))
    r = r.withColumn("shell", shell)
    lo, hi = F.floor(F.col("shell") * F.col("n") / shells), F.floor((F.col("shell") + 1) * F.col("n") / shells)
    r = r.withColumn("mid", F.col("i") == lo + F.floor((hi - lo) / 2))
    g = r.groupBy(key, "shell").agg(F.max("n").alias("n"), F.max(F.when(F.col("mid"), F.col("q"))).alias("q"), F.avg("s").alias("s"), F.max("q").alias("top"))
    ws = Window.partitionBy(key).orderBy("shell")
    g = g.withColumn("q0", F.lag("q").over(ws)).withColumn("s0", F.lag("s").over(ws))
    below = F.col("s") < target
    cross = F.when(F.col("q0").isNull(), F.col("q")).otherwise(F.col("q0") + (F.col("q") - F.col("q0")) * (F.col("s0") - target) / F.greatest(F.col("s0") - F.col("s"), F.lit(1e-30)))
    out = g.groupBy(key).agg(F.max("n").alias("n"), F.min_by(F.when(below, cross), F.when(below, F.col("shell"))).alias("limit"), F.max("top").alias("top"))
    return out.select(key, F.when(F.col("n") >= least, F.coalesce("limit", "top")).alias("limit"))


def percentile_limit(peaks: DataFrame, key: str, q: str, percentile: float = 0.9) -> DataFrame:
    """``key, limit``: the value at index min(n - 1, floor(percentile n)) in ascending order."""
    w = Window.partitionBy(key).orderBy(q)
    r = peaks.where(F.col(q).isNotNull()).select(key, F.col(q).alias("limit"), (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(key)).alias("n"))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(percentile)))
    return r.where(F.col("i") == at).select(key, "limit")


def enrichment(predicted: DataFrame, pixels: DataFrame) -> DataFrame:
    """``frame_index, n_keep, n_bright, enrichment, enrich_p``: are predicted places brighter than chance?

    ``pixels`` holds ``frame_index, row, col, bright`` of valid pixels; predictions on invalid ones do
    not count. With p the bright share of the frame: (n_bright / n_keep) / p, and the Poisson chance
    of at least n_bright.
    """
    base = pixels.groupBy("frame_index").agg((F.count_if("bright") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("p"))
    at = predicted.select("frame_index", F.rint("row").cast("int").alias("row"), F.rint("col").cast("int").alias("col")).join(pixels.select("frame_index", "row", "col", "bright"), ["frame_index", "row", "col"])
    n = at.groupBy("frame_index").agg(F.count(F.lit(1)).alias("n_keep"), F.count_if("bright").alias("n_bright")).join(base, "frame_index")
    mean = F.col("n_keep") * F.col("p")
    rate = F.when(F.col("p") > 0, F.col("n_bright") / F.col("n_keep") / F.col("p")).when(F.col("n_bright") > 0, F.lit(float("inf")))
    return n.select("frame_index", "n_keep", "n_bright", rate.alias("enrichment"), poisson_tail(F.col("n_bright"), mean).alias("enrich_p"))


def enrich_gate(solutions: DataFrame, alpha: float = 1e-3) -> DataFrame:
    """Solutions whose enrichment is significant; those never scored are dropped."""
    return solutions.where(F.col("enrich_p").isNotNull() & ~F.isnan("enrich_p") & (F.col("enrich_p") <= alpha))


def assign_hkl(peaks: DataFrame, tolerance: float, a: str = "a") -> DataFrame:
    """Peaks (``qx, qy, qz`` and the matrix column) with ``h, k, l, residual, indexed``."""
    inv = inverse_rows(a)
    frac = [row[0] * F.col("qx") + row[1] * F.col("qy") + row[2] * F.col("qz") for row in inv]
    out = peaks.select("*", *[F.rint(f).cast("int").alias(n) for f, n in zip(frac, "hkl", strict=True)])
    back = [_a(a, r, 0) * F.col("h") + _a(a, r, 1) * F.col("k") + _a(a, r, 2) * F.col("l") for r in range(3)]
    r2 = sum(((b - F.col(n)) ** 2 for b, n in zip(back[1:], ("qy", "qz"), strict=True)), (back[0] - F.col("qx")) ** 2)
    return out.withColumn("residual", F.sqrt(r2)).withColumn("indexed", F.col("residual") < tolerance)


def cell_matches(cell: Column, target: Column, edge: float = 0.05, angle_deg: float = 3.0, supplements: bool = True) -> Column:
    """Sorted edges within a relative, sorted angles within an absolute tolerance (arrays of six, degrees).

    With ``supplements`` an angle and 180 degrees less it count as the same, because the reduction of
    a hexagonal cell gives either.
    """
    fold = (lambda x: F.least(x, 180.0 - x)) if supplements else (lambda x: x)
    edges = lambda c: F.array_sort(F.slice(c, 1, 3))
    angles = lambda c: F.array_sort(F.transform(F.slice(c, 4, 3), fold))
    near_e = F.forall(F.zip_with(edges(cell), edges(target), lambda x, t: F.abs(x - t) <= edge * t), lambda ok: ok)
    near_a = F.forall(F.zip_with(angles(cell), angles(target), lambda x, t: F.abs(x - t) <= angle_deg), lambda ok: ok)
    return near_e & near_a


def accept(candidates: DataFrame, least: int = 6) -> DataFrame:
    """The first acceptable candidate of each frame by soft inliers less a rmsd tie-break.

    ``candidates`` holds ``frame_index, cand, soft, rmsd, n_indexed, match``.
    """
    worst = candidates.groupBy("frame_index").agg(F.greatest(F.max("rmsd"), F.lit(1e-30)).alias("worst"))
    ranked = candidates.join(worst, "frame_index").withColumn("rank_score", F.col("soft") - F.col("rmsd") / (F.col("worst") * 1000.0))
    good = ranked.where((F.col("n_indexed") >= least) & F.col("match"))
    first = good.groupBy("frame_index").agg(F.max(F.struct("rank_score", (-F.col("cand")).alias("neg"))).alias("b"))
    return good.join(first.select("frame_index", (-F.col("b.neg")).alias("cand")), ["frame_index", "cand"]).drop("worst")
