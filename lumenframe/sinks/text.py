"""Text stream of indexed frames, and padded peak lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Detector
from lumenframe.operators.positions import dense_positions
from lumenframe.session import cut
from lumenframe.sources.geom import Geometry

#: Fixed values of the text format: its version line, the two table headings and the marks of a chunk.
VERSION = "CrystFEL stream format 2.3"
PEAK_HEAD = "  fs/px   ss/px (1/d)/nm^-1   Intensity  Panel"
BEGIN_CHUNK, END_CHUNK, SERIAL_LINE = "----- Begin chunk -----", "----- End chunk -----", "Image serial number: "
REFLECTION_HEAD = "   h    k    l          I   sigma(I)       peak background  fs/px  ss/px panel"


def header(program: str, geometry: Geometry | None) -> str:
    lines = [VERSION, f"Generated by {program}"]
    if geometry is not None and geometry.text:
        lines += ["----- Begin geometry file -----", geometry.text.rstrip("\n"), "----- End geometry file -----"]
    return "\n".join(lines)


def resolution_text(recip: Column) -> Column:
    good = recip.isNotNull() & (recip > 0)
    return F.when(good, F.format_string("%.6f nm^-1 or %.6f A", recip, F.lit(10.0) / recip)).otherwise(F.lit("0.000000 nm^-1 or inf A"))


def _lines(df: DataFrame, line: Column, order: list[str]) -> DataFrame:
    """One text per frame, lines in order; a frame has as many as it has peaks or reflections."""
    return df.groupBy("frame_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))), lambda s: s["__line"]), "\n").alias("text"))


def peak_lines(peaks: DataFrame) -> DataFrame:
    line = F.format_string("%7.2f %7.2f %10.2f %10.2f   %s", "fs", "ss", "resolution_nm_inv", "intensity", "panel")
    return _lines(peaks, line, ["ss", "fs"])


def reflection_lines(refl: DataFrame) -> DataFrame:
    line = F.format_string("%4d %4d %4d %10.2f %10.2f %10.2f %10.2f %6.1f %6.1f %s", "h", "k", "l", "intensity", "sigma", "peak", "background", "fs", "ss", "panel")
    return _lines(refl, line, ["h", "k", "l", "ss", "fs"])


def stream_chunks(frames: DataFrame, peaks: DataFrame, reflections: DataFrame, d: Detector, lattice_type: str | None = None, centering: str | None = None, unique_axis: str | None = None, prefix: str = "lumenframe") -> DataFrame:
    """``serial, chunk`` of the indexed frames (rows of the output tables)."""
    n = lambda c, f: F.format_string(f, F.col(c))
    put = lambda *parts: F.concat_ws("\n", *parts)
    largest = reflections.groupBy("frame_id").agg(F.max("resolution_nm_inv").alias("__largest"))
    all_ = (
        frames.where("indexed")
        .join(peak_lines(peaks).withColumnRenamed("text", "__peaks"), "frame_id", "left")
        .join(reflection_lines(reflections).withColumnRenamed("text", "__refl"), "frame_id", "left")
        .join(largest, "frame_id", "left")
    )
    axis = lambda v: F.format_string(f"{v} = %+.7f %+.7f %+.7f nm^-1", *[F.col(f"{v}_{x}") for x in "xyz"])
    private = [F.when(F.col(c).isNotNull(), n(c, f"{prefix}/{k} = {f}")) for c, k, f in (("rmsd", "rmsd", "%.6f A^-1"), ("mosaicity_deg", "mosaicity", "%.4f deg"))]
    private += [F.when(F.col("scale").isNotNull(), F.format_string(f"{prefix}/scale = %.5f %.5f", F.col("scale"), F.coalesce("scale_sigma", F.lit(0.0))))]
    private += [F.when(F.col(c).isNotNull(), n(c, f"{prefix}/{k} = {f}")) for c, k, f in (("enrichment", "enrichment", "%.3f"), ("enrich_p", "enrich_p", "%.3e"))]
    nm = [F.col(f"cell_{x}_A") / 10.0 for x in "abc"]
    cell = F.format_string("Cell parameters %.5f %.5f %.5f nm, %.2f %.2f %.2f deg", *nm, *[F.col(f"cell_{x}_deg") for x in ("alpha", "beta", "gamma")])
    chunk = put(
        F.lit(BEGIN_CHUNK), F.format_string("Image filename: %s", "filename"), F.format_string("Event: //%d", "event"), F.format_string(SERIAL_LINE + "%d", "serial"),
        F.lit("hit = 1"), F.lit("indexed_by = fromfile"), F.lit("n_indexing_tries = 1"), F.lit(f"photon_energy_eV = {d.photon_energy or 0.0:.2f}"),
        F.lit("beam_divergence = 0.00e+00 rad"), F.lit("beam_bandwidth = 1.00e-08 (fraction)"), F.lit(f"average_camera_length = {d.clen:.6f} m"),
        F.format_string("num_peaks = %d", F.coalesce("n_peaks", F.lit(0))), F.lit("num_saturated_peaks = 0"), F.concat(F.lit("peak_resolution = "), resolution_text(F.col("peak_resolution_nm_inv"))),
        F.lit("Peaks from peak search"), F.lit(PEAK_HEAD), F.col("__peaks"), F.lit("End of peak list"),
        F.lit("--- Begin crystal"), cell, axis("astar"), axis("bstar"), axis("cstar"),
        F.lit(f"lattice_type = {lattice_type or 'triclinic'}"), F.lit(f"centering = {centering or 'P'}"), F.lit(f"unique_axis = {unique_axis or '?'}"),
        F.format_string("profile_radius = %.5f nm^-1", F.coalesce("profile_radius_nm_inv", F.lit(0.002))), F.lit("predict_refine/det_shift x = 0.000000 y = 0.000000 mm"), *private,
        F.concat(F.lit("diffraction_resolution_limit = "), resolution_text(F.coalesce("diffraction_limit_nm_inv", "__largest", F.lit(0.0)))),
        F.format_string("num_reflections = %d", F.coalesce("num_reflections", F.lit(0))), F.lit("num_saturated_reflections = 0"), F.lit("num_implausible_reflections = 0"),
        F.lit("Reflections measured after indexing"), F.lit(REFLECTION_HEAD), F.col("__refl"), F.lit("End of reflections"), F.lit("--- End crystal"), F.lit(END_CHUNK),
    )
    return all_.select("serial", chunk.alias("chunk"))


def write_stream(chunks: DataFrame, head: str, path: str) -> None:
    """Text files in order of serial; the header is the first record."""
    spark = chunks.sparkSession
    first = spark.createDataFrame([(0, head)], "serial long, chunk string")
    chunks.select(F.col("serial").cast("long").alias("serial"), "chunk").unionByName(first).repartitionByRange("serial").sortWithinPartitions("serial").select("chunk").write.mode("overwrite").text(path)


def merge_streams(spark: SparkSession, parts: Sequence[str], path: str) -> int:
    """Streams (files or folders of them) one after the other as one stream; returns the number of chunks.

    Chunks keep their order within a part and are numbered 1, 2, … anew; the header is that of the first
    part that has one. Parts that are missing or empty add nothing.
    """
    text = None
    for k, part in enumerate(parts):
        p = spark._jvm.org.apache.hadoop.fs.Path(part)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(p) or not fs.getContentSummary(p).getLength():
            continue
        got = spark.read.text(part, lineSep=END_CHUNK).select(F.lit(k).alias("part"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
        text = got if text is None else text.unionByName(got)
    if text is None:
        return 0
    text = cut(text)
    cleave = F.split_part("value", F.lit(BEGIN_CHUNK), F.lit(1))
    heads = text.where(F.trim(F.regexp_replace(cleave, r"\s+", " ")).startswith(VERSION)).select("part", "file", "block", "at", F.rtrim(F.regexp_replace(cleave, r"\s+$", "")).alias("head"))
    head = heads.orderBy("part", "file", "block", "at").limit(1).first()
    bodies = text.where(F.col("value").contains(BEGIN_CHUNK)).select("part", "file", "block", "at", F.concat(F.lit(BEGIN_CHUNK), F.split_part("value", F.lit(BEGIN_CHUNK), F.lit(2)), F.lit(END_CHUNK)).alias("chunk"))
    one = bodies.withColumn("all", F.lit(0))
    numbered = dense_positions(one, ["all"], F.col("part").cast("long"), [F.col("file"), F.col("block"), F.col("at")], "serial").withColumn("serial", F.col("serial") + 1)
    chunks = numbered.select("serial", F.regexp_replace("chunk", SERIAL_LINE + r"-?\d+", F.concat(F.lit(SERIAL_LINE), F.col("serial").cast("string"))).alias("chunk"))
    write_stream(chunks, head["head"] if head else VERSION, path)
    return numbered.count()


def padded_peaks(peaks: DataFrame, width: int | None = None) -> DataFrame:
    """``filename, event, nPeaks, peakXPosRaw, peakYPosRaw, peakTotalIntensity``: arrays padded with 0.

    Needs ``filename, event, row, col, intensity``. The width is that of the fullest frame unless given.
    """
    per = peaks.groupBy("filename", "event").agg(F.array_sort(F.collect_list(F.struct("row", "col", "intensity"))).alias("p")).withColumn("nPeaks", F.size("p"))
    per = per.withColumn("__w", F.lit(width)) if width else per.join(F.broadcast(per.agg(F.max("nPeaks").alias("__w"))))
    pad = lambda f: F.slice(F.concat(F.transform("p", lambda s: s[f].cast("double")), F.array_repeat(F.lit(0.0), F.col("__w"))), F.lit(1), F.col("__w"))
    return per.select("filename", "event", "nPeaks", pad("col").alias("peakXPosRaw"), pad("row").alias("peakYPosRaw"), pad("intensity").alias("peakTotalIntensity"))
