"""Detector pixels to reciprocal space and back, as column expressions (rows and columns in pixels)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Photon energy in eV times wavelength in Angstrom.
EV_ANGSTROM = 12398.419843320026


@dataclass(frozen=True)
class Panel:
    name: str
    min_fs: int
    max_fs: int
    min_ss: int
    max_ss: int
    corner_x: float = 0.0
    corner_y: float = 0.0
    fs_x: float | None = 1.0
    fs_y: float | None = 0.0
    ss_x: float | None = 0.0
    ss_y: float | None = 1.0

    @property
    def usable(self) -> bool:
        return None not in (self.fs_x, self.fs_y, self.ss_x, self.ss_y) and abs(self.fs_x * self.ss_y - self.fs_y * self.ss_x) >= 1e-9


@dataclass(frozen=True)
class Detector:
    """What the forward model needs: distance and pixel size in metres, wavelength in Angstrom."""

    clen: float
    pixel_size: float
    wavelength: float
    beam_row: float
    beam_col: float
    panels: tuple[Panel, ...] = field(default=())

    @property
    def by_panels(self) -> bool:
        """One unusable panel makes the whole detector flat."""
        return bool(self.panels) and all(p.usable for p in self.panels)

    @property
    def photon_energy(self) -> float | None:
        return EV_ANGSTROM / self.wavelength if self.wavelength else None


def lab_xy(row: Column, col: Column, d: Detector) -> tuple[Column, Column]:
    """Position relative to the beam, in pixels. Of overlapping panels the last one counts."""
    x, y = col - F.lit(d.beam_col), row - F.lit(d.beam_row)
    if not d.by_panels:
        return x, y
    for p in d.panels:
        inside = (col >= p.min_fs - 0.5) & (col < p.max_fs + 0.5) & (row >= p.min_ss - 0.5) & (row < p.max_ss + 0.5)
        u, v = col - F.lit(float(p.min_fs)), row - F.lit(float(p.min_ss))
        x = F.when(inside, F.lit(p.corner_x) + p.fs_x * u + p.ss_x * v).otherwise(x)
        y = F.when(inside, F.lit(p.corner_y) + p.fs_y * u + p.ss_y * v).otherwise(y)
    return x, y


def detector_to_q(row: Column, col: Column, d: Detector) -> tuple[Column, Column, Column]:
    """Scattering vector (1/Angstrom, no 2 pi) of a pixel: (unit direction - beam) / wavelength."""
    x, y = (c * F.lit(d.pixel_size) for c in lab_xy(row, col, d))
    norm = F.sqrt(x * x + y * y + F.lit(d.clen * d.clen))
    inv = F.lit(1.0 / d.wavelength)
    return x / norm * inv, y / norm * inv, (F.lit(d.clen) / norm - 1.0) * inv


def q_to_detector(qx: Column, qy: Column, qz: Column, d: Detector) -> tuple[Column, Column]:
    """(row, col) at which a vector on the sphere hits the detector; NULL beside it or backwards."""
    lam = F.lit(d.wavelength)
    sz = lam * qz + 1.0
    t = F.lit(d.clen / d.pixel_size) / F.greatest(sz, F.lit(1e-30))
    x, y = lam * qx * t, lam * qy * t
    if not d.by_panels:
        return F.when(sz > 0, y + F.lit(d.beam_row)), F.when(sz > 0, x + F.lit(d.beam_col))
    row = col = None
    for p in reversed(d.panels):  # the first panel that is hit is tested last and so wins
        det = p.fs_x * p.ss_y - p.fs_y * p.ss_x
        dx, dy = x - F.lit(p.corner_x), y - F.lit(p.corner_y)
        u, v = (dx * p.ss_y - dy * p.ss_x) / det, (dy * p.fs_x - dx * p.fs_y) / det
        hit = (sz > 0) & (u >= 0) & (u <= p.max_fs - p.min_fs) & (v >= 0) & (v <= p.max_ss - p.min_ss)
        here_r, here_c = v + F.lit(float(p.min_ss)), u + F.lit(float(p.min_fs))
        row = F.when(hit, here_r) if row is None else F.when(hit, here_r).otherwise(row)
        col = F.when(hit, here_c) if col is None else F.when(hit, here_c).otherwise(col)
    return row, col


def q_norm(row: Column, col: Column, d: Detector) -> Column:
    x, y, z = detector_to_q(row, col, d)
    return F.sqrt(x * x + y * y + z * z)


def flat_resolution(row: Column, col: Column, d: Detector) -> Column:
    """1/nm of the flat model, whatever the panels: what the output tables state."""
    r = F.sqrt(F.pow(col - F.lit(d.beam_col), 2) + F.pow(row - F.lit(d.beam_row), 2)) * F.lit(d.pixel_size)
    return F.lit(2.0) * F.sin(F.atan2(r, F.lit(d.clen)) / 2.0) / F.lit(0.1 * d.wavelength)


def q_max(d: Detector, height: int, width: int) -> float:
    """The largest norm at a corner of the frame."""
    import math

    best = 0.0
    for r in (0.0, height - 1.0):
        for c in (0.0, width - 1.0):
            x, y = c - d.beam_col, r - d.beam_row
            if d.by_panels:
                for p in d.panels:
                    if p.min_fs <= c <= p.max_fs and p.min_ss <= r <= p.max_ss:
                        u, v = c - p.min_fs, r - p.min_ss
                        x, y = p.corner_x + p.fs_x * u + p.ss_x * v, p.corner_y + p.fs_y * u + p.ss_y * v
            angle = math.atan2(math.hypot(x, y) * d.pixel_size, d.clen)
            best = max(best, 2.0 * math.sin(angle / 2.0) / d.wavelength)
    return best
