"""Command line: frames, geometry and cell in, tables or text stream or peak lists out."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.dense import FinderRule
from lumenframe.plans.pipeline import Pipeline
from lumenframe.session import ensure_checkpoint_dir, local_session
from lumenframe.sinks import tables, text
from lumenframe.sources.frames import read_frames, read_list, read_mask
from lumenframe.sources.geom import parse_cell, parse_geometry, read_text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lumenframe", description=__doc__)
    p.add_argument("-i", "--input", required=True, help="a Parquet folder of frames, or a .lst file of such folders")
    p.add_argument("-g", "--geometry", required=True)
    p.add_argument("-p", "--cell")
    p.add_argument("-o", "--output", required=True, help="a folder; with .stream a text stream")
    p.add_argument("--peaks-only", action="store_true")
    p.add_argument("--start", type=int)
    p.add_argument("--stop", type=int)
    p.add_argument("--seed-frames", type=int, default=32)
    p.add_argument("--target-noise-peaks", type=float, default=5.0)
    p.add_argument("--warmup-frames", type=int, default=16)
    p.add_argument("--flux-variance", action="store_true")
    p.add_argument("--flux-var-floor", type=float, default=0.15)
    p.add_argument("--noise-mode", choices=["robust", "plain"], default="robust", help="whether values are clipped before they are learned")
    p.add_argument("--eigen-modes", type=int, default=0)
    p.add_argument("--batch-size", type=int, help="frames in an Arrow batch")
    p.add_argument("--mask", help="a Parquet table row, col, word of mask flags")
    p.add_argument("--panel", default="p0")
    p.add_argument("--enrich-gate", action="store_true")
    p.add_argument("--enrich-alpha", type=float, default=1e-3)
    p.add_argument("-q", "--quiet", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    if not a.peaks_only and not a.cell:
        print("a cell is needed unless --peaks-only is given", file=sys.stderr)
        return 2
    # The session that spark-submit or a notebook made wins; only without any is a local one started.
    given = SparkSession.getActiveSession() is not None or any(k in os.environ for k in ("PYSPARK_GATEWAY_PORT", "SPARK_REMOTE", "MASTER"))
    spark = SparkSession.builder.appName("lumenframe").getOrCreate() if given else local_session()
    ensure_checkpoint_dir(spark)
    if a.batch_size:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(a.batch_size))
    paths = read_list(spark, a.input) if a.input.endswith(".lst") else a.input
    frames = read_frames(spark, paths)
    first = frames.select("h", "w").first()
    if first is None:
        print("no frames", file=sys.stderr)
        return 2
    geometry = parse_geometry(read_text(spark, a.geometry))
    cell = parse_cell(read_text(spark, a.cell)) if a.cell else None
    run = Pipeline(frames, geometry, first["h"], first["w"], cell, FinderRule(flux_floor=a.flux_var_floor))
    mask = read_mask(spark, a.mask, geometry.mask, geometry.panels) if a.mask else None
    run.calibrate(a.seed_frames, a.target_noise_peaks, a.flux_variance, warmup=a.warmup_frames, robust=a.noise_mode == "robust", eigen_modes=a.eigen_modes, mask=mask)
    events = run.frames(a.start, a.stop).select("frame_index", "filename", "event")
    if a.peaks_only:
        found = run.peaks(a.start, a.stop).df.join(events, "frame_index")
        peaks = tables.peak_rows(found, run.detector, a.panel)
        hits = found.select("frame_index", "filename", "event").distinct()
        refl = spark.createDataFrame([], tables.SCHEMAS["reflections"])
        out = {"frames": tables.frame_rows(hits, peaks, refl, events), "peaks": peaks, "reflections": refl} | tables.metadata_tables(spark, geometry, None)
        tables.write_tables(out, a.output)
        text.padded_peaks(found).write.mode("overwrite").parquet(f"{a.output}/peak_lists.parquet")
        return 0
    solved = run.index(a.start, a.stop)
    if a.enrich_gate:
        solved = solved.enrich_gate(a.enrich_alpha)
    solved.panel = a.panel
    (solved.to_stream if a.output.endswith(".stream") else solved.to_db)(a.output)
    if not a.quiet:
        print(events.agg(F.count(F.lit(1))).first()[0], "frames,", solved.count(), "indexed")
    return 0


if __name__ == "__main__":
    sys.exit(main())
