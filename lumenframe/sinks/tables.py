"""The six output tables: rows of solutions and peaks, backfill, writing and merging."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Detector, flat_resolution
from lumenframe.functions.lattice import Cell, frame_id
from lumenframe.functions.scoring import finite_or_null
from lumenframe.operators.noise import panel_of
from lumenframe.sources.frames import serials
from lumenframe.sources.geom import Geometry

#: Names and types of the output tables, in the order of their columns.
_AXES = ", ".join(f"{v}_{x} double" for v in ("astar", "bstar", "cstar") for x in "xyz")
SCHEMAS = {
    "geometry": "beam_center_row double, beam_center_col double, clen double, pixel_size double, wavelength double, photon_energy_eV double, adu_per_photon double, n_panels int, geometry_file string",
    "panels": "name string, min_fs int, max_fs int, min_ss int, max_ss int",
    "cell": "a_A double, b_A double, c_A double, alpha_deg double, beta_deg double, gamma_deg double, volume_A3 double, lattice_type string, centering string, unique_axis string",
    "frames": "frame_id string, frame_index bigint, filename string, event bigint, indexed boolean, serial bigint, n_peaks int, n_indexed int, rmsd double, scale double, scale_sigma double, "
    "mosaicity_deg double, profile_radius_nm_inv double, enrichment double, n_bright int, enrich_p double, diffraction_limit_nm_inv double, peak_resolution_nm_inv double, num_reflections int, "
    "cell_a_A double, cell_b_A double, cell_c_A double, cell_alpha_deg double, cell_beta_deg double, cell_gamma_deg double, " + _AXES,
    "reflections": "frame_id string, h int, k int, l int, intensity double, sigma double, peak double, background double, fs double, ss double, panel string, resolution_nm_inv double",
    "peaks": "frame_id string, fs double, ss double, intensity double, resolution_nm_inv double, panel string",
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Columns of a table in order and type; absent ones are NULL, non-finite numbers too."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for part in SCHEMAS[table].split(", "):
        name, kind = part.split()
        c = F.col(f"`{have[name.lower()]}`").cast(kind) if name.lower() in have else F.lit(None).cast(kind)
        out.append((finite_or_null(c) if kind == "double" else c).alias(name))
    return df.select(*out)


def metadata_tables(spark: SparkSession, geometry: Geometry, cell: Cell | None) -> dict[str, DataFrame]:
    """The tables geometry (one row), panels and cell (at most one row)."""
    energy = 12398.419843320026 / geometry.wavelength if geometry.wavelength else None
    g = [(geometry.beam_row, geometry.beam_col, geometry.clen, geometry.pixel_size, geometry.wavelength, energy, geometry.adu_per_photon, len(geometry.panels), geometry.text)]
    p = [(x.name, x.min_fs, x.max_fs, x.min_ss, x.max_ss) for x in geometry.panels]
    c = []
    if cell is not None:
        d = cell.in_degrees()
        c = [(d["a"], d["b"], d["c"], d["alpha"], d["beta"], d["gamma"], d["volume"], cell.lattice_type, cell.centering, cell.unique_axis)]
    make = lambda rows, t: conform(spark.createDataFrame(rows, SCHEMAS[t]), t)
    return {"geometry": make(g, "geometry"), "panels": make(p, "panels"), "cell": make(c, "cell")}


def peak_rows(peaks: DataFrame, d: Detector, label: str = "p0") -> DataFrame:
    """The table peaks from ``frame_index, filename, event, row, col, intensity``."""
    panel = F.coalesce(panel_of(F.col("row"), F.col("col"), d.panels), F.lit(label))
    return conform(
        peaks.select(frame_id(F.col("filename"), F.col("event")).alias("frame_id"), F.col("col").alias("fs"), F.col("row").alias("ss"), "intensity", flat_resolution(F.col("row"), F.col("col"), d).alias("resolution_nm_inv"), panel.alias("panel")), "peaks"
    )


def reflection_rows(refl: DataFrame, d: Detector, label: str = "p0") -> DataFrame:
    """The table reflections from integrated ones with position; only a finite sigma above 0 counts."""
    ok = F.col("sigma").isNotNull() & ~F.isnan("sigma") & (F.col("sigma") < float("inf")) & (F.col("sigma") > 0)
    panel = F.coalesce(panel_of(F.col("row"), F.col("col"), d.panels), F.lit(label))
    out = refl.where(ok).select(
        frame_id(F.col("filename"), F.col("event")).alias("frame_id"), "h", "k", "l", "intensity", "sigma", "peak", "background",
        F.col("col").alias("fs"), F.col("row").alias("ss"), panel.alias("panel"), flat_resolution(F.col("row"), F.col("col"), d).alias("resolution_nm_inv"),
    )
    return conform(out, "reflections")


def with_observed(reflections: DataFrame, observed: DataFrame) -> DataFrame:
    """``reflections`` and, for frames that have none, their indexed peaks (``frame_index, h, k, l, row,
    col, intensity, sigma``) with peak and background 0; other columns are NULL there."""
    rest = observed.join(reflections.select("frame_index").distinct(), "frame_index", "left_anti")
    have = set(rest.columns)
    fill = {"peak": F.lit(0.0), "background": F.lit(0.0)}
    cols = [(F.col(f.name) if f.name in have else fill.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in reflections.schema.fields]
    return reflections.unionByName(rest.select(*cols))


def backfill(written: DataFrame, events: DataFrame) -> DataFrame:
    """The frames table completed: events (``frame_index, filename, event``) that were not written get a
    row with their identity, indexed = false and NULL for all else."""
    rest = events.select("frame_index", "filename", "event").join(written.select("frame_index"), "frame_index", "left_anti")
    ids = rest.select("*", frame_id(F.col("filename"), F.col("event")).alias("frame_id"), F.lit(False).alias("indexed"))
    return conform(written, "frames").unionByName(conform(ids, "frames"))


def frame_rows(solutions: DataFrame, peaks: DataFrame, reflections: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """The frames table of solved frames (or of frames with peaks alone), with counts, serials and backfill.

    ``solutions`` holds ``frame_index, filename, event`` and any frame columns; ``peaks`` and
    ``reflections`` are the output tables.
    """
    fid = frame_id(F.col("filename"), F.col("event"))
    p = peaks.groupBy("frame_id").agg(F.count(F.lit(1)).cast("int").alias("__np"), F.max("resolution_nm_inv").alias("__pr"))
    r = reflections.groupBy("frame_id").agg(F.count(F.lit(1)).cast("int").alias("__nr"))
    base = solutions.drop("frame_id").withColumn("frame_id", fid).join(p, "frame_id", "left").join(r, "frame_id", "left")
    have = set(base.columns)
    base = base.withColumn("n_peaks", F.coalesce(*([F.col("n_peaks")] if "n_peaks" in have else []), F.col("__np"), F.lit(0)))
    base = base.withColumn("peak_resolution_nm_inv", F.col("__pr")).withColumn("num_reflections", F.coalesce("__nr", F.lit(0)))
    if "indexed" not in have:
        base = base.withColumn("indexed", F.lit(False))
    out = conform(serials(base.drop("serial"), "frame_index"), "frames")
    return out if events is None else backfill(out, events)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One Parquet folder per table. All tables are written beside the former ones first, which are then
    replaced by renaming, so a failed write leaves them as they were. Frame ids must be unique."""
    fresh = f"{path}/.new-{uuid.uuid4().hex}"
    names = [n for n in SCHEMAS if n in tables]
    for name in names:
        tables[name].write.parquet(f"{fresh}/{name}.parquet")
    if not names:
        return
    spark = tables[names[0]].sparkSession
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in names:
        target = jvm(f"{path}/{name}.parquet")
        fs.delete(target, True)
        if not fs.rename(jvm(f"{fresh}/{name}.parquet"), target):
            raise OSError(f"cannot put {name} in place")
    fs.delete(jvm(fresh), True)


#: Counters of a run that shards add up.
STATS = ("frames", "hits", "indexed", "peaks", "reflections")


def write_stats(spark: SparkSession, counts: dict[str, int], path: str) -> None:
    """The counters of one shard as a JSON record beside its tables."""
    row = tuple(int(counts.get(c, 0)) for c in STATS)
    spark.createDataFrame([row], ", ".join(f"{c} long" for c in STATS)).coalesce(1).write.mode("overwrite").json(f"{path}/stats.json")


def merge_stats(spark: SparkSession, shards: Sequence[str]) -> dict[str, int]:
    """The sums of the counters of all shards; a shard without a record adds nothing."""
    have = [f"{s}/stats.json" for s in shards]
    fs = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(p))
    have = [p for p in have if fs(p)]
    if not have:
        return dict.fromkeys(STATS, 0)
    got = spark.read.schema(", ".join(f"{c} long" for c in STATS)).json(have).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in STATS]).first()
    return got.asDict()


def duplicate_frame_ids(frames: DataFrame) -> DataFrame:
    """Frame ids that stand in more than one row: the check that a primary key would be."""
    return frames.groupBy("frame_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def merge_shards(spark: SparkSession, shards: Sequence[str], out: str | None = None) -> tuple[dict[str, DataFrame], int]:
    """Union of shard outputs and the number of indexed frames. Metadata come from the first readable
    shard; unreadable shards are skipped; serials are numbered anew."""
    good = []
    for s in shards:
        try:
            good.append({t: spark.read.schema(SCHEMAS[t]).parquet(f"{s}/{t}.parquet") for t in SCHEMAS})
        except Exception:  # noqa: BLE001 - a shard that cannot be read is left out, whatever the reason
            continue
    if not good:
        raise ValueError("no shard can be read")
    tables = {t: good[0][t] for t in ("geometry", "panels", "cell")}
    for t in ("reflections", "peaks"):
        tables[t] = reduce(DataFrame.unionByName, [g[t] for g in good])
    frames = reduce(DataFrame.unionByName, [g["frames"] for g in good])
    numbered = serials(frames.where("serial IS NOT NULL").drop("serial"), "frame_index")
    tables["frames"] = conform(numbered, "frames").unionByName(frames.where("serial IS NULL"))
    if out is not None:
        write_tables(tables, out)
    return tables, frames.where("indexed").count()
