"""Parsers of geometry and cell files, as DataFrame steps over their lines.

Grammar: ``key = value`` for the run, ``name/key = value`` for a panel or a bad region, ``;`` starts a
comment. A named block with corner and bounds is a panel, one with bounds alone a bad region.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.geometry import EV_ANGSTROM, Detector, Panel
from lumenframe.functions.lattice import Cell

BOUNDS = ("min_fs", "max_fs", "min_ss", "max_ss")


def split_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """``block, key, text`` of each assignment; ``block`` is NULL for the run's own keys.

    Blank lines, comments and lines without ``=`` give no row; NULL lines neither.
    """
    bare = F.trim(F.split_part(F.col(column), F.lit(";"), F.lit(1)))
    key, text = F.trim(F.split_part(bare, F.lit("="), F.lit(1))), F.trim(F.regexp_extract(bare, r"^[^=]*=(.*)$", 1))
    got = lines.select(bare.alias("bare"), key.alias("k"), text.alias("text")).where(F.col("bare").contains("=") & (F.col("k") != ""))
    named = F.col("k").contains("/")
    return got.select(
        F.when(named, F.regexp_extract("k", r"^(.*)/[^/]*$", 1)).alias("block"), F.when(named, F.regexp_extract("k", r"([^/]*)$", 1)).otherwise(F.col("k")).alias("key"), "text"
    )


def coerced(text: str) -> Column:
    """A struct of a text column as whole number, as float where it is one, and as text."""
    return F.struct(F.col(text).try_cast("bigint").alias("whole"), F.col(text).try_cast("double").alias("real"), F.col(text).alias("text"))


def axis_vector(spec: str | None) -> tuple[float, float] | None:
    """(x, y) of a direction such as ``+1.0x -0.02y``; None if it names neither axis."""
    if spec is None:
        return None
    parts = re.findall(r"([+-]?\s*(?:\d+\.?\d*|\.\d+)?(?:[eE][+-]?\d+)?)\s*([xy])", str(spec))
    if not parts:
        return None
    out = {"x": 0.0, "y": 0.0}
    for number, axis in parts:
        n = number.replace(" ", "")
        out[axis] += float(n + "1" if n in ("", "+", "-") else n)
    return out["x"], out["y"]


def mask_bits(value, default: int = 0) -> int:
    """Bit flags given as a whole number or in hexadecimal."""
    if value is None:
        return default
    return int(str(value).strip(), 0)


@dataclass(frozen=True)
class MaskRule:
    path: str | None = None
    file: str | None = None
    good: int = 0
    bad: int = 0


@dataclass(frozen=True)
class Geometry:
    """A parsed geometry: run parameters, panels in file order, bad regions, axis roles."""

    parameters: dict
    panels: tuple[Panel, ...]
    bad_regions: tuple[dict, ...] = ()
    overrides: dict = field(default_factory=dict)
    clen: float | None = None
    wavelength: float | None = None
    pixel_size: float | None = None
    adu_per_photon: float | None = None
    beam_row: float | None = None
    beam_col: float | None = None
    layout: dict = field(default_factory=dict)
    mask: MaskRule = MaskRule()
    text: str = ""

    def detector(self) -> Detector:
        """The forward model's numbers; names all that are missing."""
        missing = [n for n in ("clen", "pixel_size", "wavelength", "beam_row", "beam_col") if getattr(self, n) is None]
        if missing:
            raise ValueError("geometry lacks " + ", ".join(missing))
        return Detector(self.clen, self.pixel_size, self.wavelength, self.beam_row, self.beam_col, self.panels)


def _number(v):
    try:
        return int(v)
    except (TypeError, ValueError):
        try:
            return float(v)
        except (TypeError, ValueError):
            return v


def _real(v) -> float | None:
    return float(v) if isinstance(v, (int, float)) else None


def parse_geometry(text: str) -> Geometry:
    """Parse the text of a geometry file (a few kilobytes, so on the driver)."""
    run: dict = {}
    blocks: dict[str, dict] = {}
    order: list[str] = []
    defaults: dict = {}
    for line in text.splitlines():
        bare = line.split(";", 1)[0].strip()
        if "=" not in bare:
            continue
        key, value = (x.strip() for x in bare.split("=", 1))
        if "/" in key and not key.startswith("/"):
            name, _, key = key.rpartition("/")
            if name not in blocks:
                # A block starts from what the run said before it.
                blocks[name] = {k: v for k, v in run.items() if k in defaults or k.startswith("dim") or k in ("fs", "ss", "corner_x", "corner_y", "coffset", "data", "mask", "mask_file", "mask_good", "mask_bad")}
                order.append(name)
            blocks[name][key] = _number(value)
        else:
            run[key] = _number(value)
    panels, regions = [], []
    for name in order:
        b = blocks[name]
        if not all(k in b for k in BOUNDS):
            continue
        if "corner_x" in b and "corner_y" in b:
            fs, ss = axis_vector(b.get("fs")), axis_vector(b.get("ss"))
            fs, ss = fs or (None, None), ss or (None, None)
            panels.append(Panel(name, *(int(b[k]) for k in BOUNDS), float(b["corner_x"]), float(b["corner_y"]), *fs, *ss))
        else:
            regions.append({"name": name} | {k: int(b[k]) for k in BOUNDS})
    energy, wave, res = _real(run.get("photon_energy")), _real(run.get("wavelength")), _real(run.get("res"))
    wavelength = wave if wave is not None else (EV_ANGSTROM / energy if energy else None)
    if energy is None and wavelength:
        energy = EV_ANGSTROM / wavelength
    gain = _real(run.get("adu_per_photon"))
    if gain is None and _real(run.get("adu_per_eV")) is not None and energy:
        gain = float(run["adu_per_eV"]) * energy
    offsets = [float(v) for p in panels if (v := _real(blocks[p.name].get("coffset"))) is not None]
    offset = sum(offsets) / len(offsets) if offsets else 0.0
    clen = _real(run.get("clen"))
    mean = lambda v: sum(v) / len(v) if v else None
    dims = {k: v for k, v in run.items() if re.fullmatch(r"dim\d+", k)}
    return Geometry(
        parameters=run, panels=tuple(panels), bad_regions=tuple(regions), overrides={n: blocks[n] for n in order},
        clen=clen + offset if clen is not None else None, wavelength=wavelength, pixel_size=1.0 / res if res else None, adu_per_photon=gain,
        beam_row=mean([p.min_ss - p.corner_y for p in panels]), beam_col=mean([p.min_fs - p.corner_x for p in panels]), layout=dims,
        mask=MaskRule(run.get("mask"), run.get("mask_file"), mask_bits(run.get("mask_good")), mask_bits(run.get("mask_bad"))), text=text,
    )


def resolve_distance(geometry: Geometry, values: DataFrame | None, column: str, what: str) -> Geometry:
    """Fill ``clen`` or the wavelength from per-frame values: the mean of the finite ones.

    A distance above 2 in size is in millimetres. No finite value leaves the geometry as it is.
    """
    got = values.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double")) & (F.abs(F.col(column)) < float("inf"))).agg(F.avg(F.col(column).cast("double"))).first()[0] if values is not None else None
    if got is None:
        return geometry
    if what == "clen":
        offsets = [float(v["coffset"]) for v in geometry.overrides.values() if _real(v.get("coffset")) is not None]
        return replace(geometry, clen=(got / 1000.0 if abs(got) > 2 else got) + (sum(offsets) / len(offsets) if offsets else 0.0))
    return replace(geometry, wavelength=EV_ANGSTROM / got)


#: Names that a cell file may use for the six numbers.
CELL_KEYS = {"a": "a", "b": "b", "c": "c", "al": "alpha", "alpha": "alpha", "be": "beta", "beta": "beta", "ga": "gamma", "gamma": "gamma"}


def parse_cell(text: str) -> Cell:
    """Parse the text of a unit-cell file: numbers with a unit token, angles in degrees."""
    got: dict = {}
    for line in text.splitlines():
        bare = line.split(";", 1)[0].strip()
        if "=" not in bare:
            continue
        key, value = (x.strip() for x in bare.split("=", 1))
        if key in CELL_KEYS:
            got[CELL_KEYS[key]] = float(value.split()[0])
        elif key in ("lattice_type", "unique_axis", "centering"):
            got[key] = value.split()[0]
    missing = [k for k in ("a", "b", "c", "alpha", "beta", "gamma") if k not in got]
    if missing:
        raise ValueError("cell file lacks " + ", ".join(missing))
    for k in ("alpha", "beta", "gamma"):
        got[k] = math.radians(got[k])
    return Cell(**got)


def read_text(spark: SparkSession, path: str) -> str:
    """The text of a small file on any file system Spark reads."""
    return spark.read.text(path, wholetext=True).first()[0]
