"""Frames: file lists, global frame ranges, range scans, masks, panel assembly and simulation."""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.geometry import Panel
from lumenframe.operators.positions import dense_positions
from lumenframe.session import cut

FRAME_SCHEMA = "frame_index long, filename string, event long, h int, w int, pixels array<float>"


def read_list(spark: SparkSession, path: str) -> list[str]:
    """Paths of a list file in order: one per line; blanks and lines starting with # or ; are skipped."""
    text = spark.read.text(path, wholetext=True).first()
    lines = (text[0] if text else "").splitlines()
    return [s for line in lines if (s := line.strip()) and not s.startswith(("#", ";"))]


def frame_ranges(files: DataFrame) -> DataFrame:
    """``filename, pos, start, stop`` from ``filename, pos, n_frames``: cumulative over the list.

    The list of files is metadata; its running sum is taken in slices all the same.
    """
    from pyspark.sql import Window

    sliced = files.select("filename", "pos", "n_frames", F.floor(F.col("pos") / 4096).alias("s"))
    per = sliced.groupBy("s").agg(F.sum("n_frames").alias("n"))
    off = per.select("s", F.coalesce(F.sum("n").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    w = Window.partitionBy("s").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    got = sliced.withColumn("upto", F.sum("n_frames").over(w)).join(off, "s")
    return got.select("filename", "pos", (F.col("o") + F.col("upto") - F.col("n_frames")).alias("start"), (F.col("o") + F.col("upto")).alias("stop"))


def locate_frames(df: DataFrame, ranges: DataFrame, block: int = 1024) -> DataFrame:
    """``df`` with ``filename, event`` of its ``frame_index``; outside all ranges 'unknown' and the index
    itself, for a NULL index 'unknown' and 0. The first range in list order wins.

    Ranges are cut into blocks, so the range join is an equi-join however many files there are.
    """
    parts = ranges.where("stop > start").select(F.col("filename").alias("__f"), F.col("pos").alias("__p"), F.col("start").alias("__a"), F.col("stop").alias("__b"))
    parts = parts.withColumn("__k", F.explode(F.sequence(F.floor(F.col("__a") / block), F.floor((F.col("__b") - 1) / block))))
    keys = df.select("frame_index").where("frame_index IS NOT NULL").distinct().withColumn("__k", F.floor(F.col("frame_index") / block))
    hit = keys.join(parts, "__k").where("frame_index >= __a AND frame_index < __b").groupBy("frame_index").agg(F.min(F.struct("__p", "__f", "__a")).alias("h"))
    out = df.join(hit, "frame_index", "left")
    return out.select(*df.columns, F.coalesce("h.__f", F.lit("unknown")).alias("filename"), F.coalesce(F.col("frame_index") - F.col("h.__a"), F.col("frame_index"), F.lit(0)).cast("long").alias("event"))


def resolve_frame(ranges: DataFrame, name: str, event: int) -> int:
    """The global index of an event of a file named by its path or its last part; first match wins."""
    same = (F.col("filename") == name) | (F.element_at(F.split("filename", "/"), -1) == name)
    got = ranges.where(same & (F.lit(event) < F.col("stop") - F.col("start"))).orderBy("pos").select("start").first()
    if got is None:
        raise KeyError(f"{name}//{event}")
    return got["start"] + event


def parse_event(spec: str) -> tuple[str, int]:
    """('run.h5', 3) of 'run.h5//3'."""
    name, sep, n = spec.rpartition("//")
    if not sep or not n.isdigit():
        raise KeyError(spec)
    return name, int(n)


def read_frames(spark: SparkSession, path: str | Sequence[str], start: int | None = None, stop: int | None = None, files: Sequence[str] | None = None) -> DataFrame:
    """Dense frames from Parquet; the range and the file subset are pushed down to the scan."""
    df = spark.read.schema(FRAME_SCHEMA).parquet(*([path] if isinstance(path, str) else path))
    if start is not None:
        df = df.where(F.col("frame_index") >= start)
    if stop is not None:
        df = df.where(F.col("frame_index") < stop)
    return df.where(F.col("filename").isin(list(files))) if files is not None else df


def scan_files(spark: SparkSession, paths: Sequence[str], height: int | None = None, width: int | None = None) -> DataFrame:
    """``filename, pos, n_frames, problem`` of frame files, from their footers alone.

    A file that cannot be read, lacks a frame column or holds frames of another shape (the first readable
    file's unless given) has 0 frames and a ``problem``; the others' is NULL. See ``usable_files``.
    """
    needed = {c.split()[0] for c in FRAME_SCHEMA.split(", ")}

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for b in batches:
            out = []
            for pos, name in zip(b["pos"], b["filename"], strict=True):
                n, h, w, problem = 0, None, None, None
                try:
                    fs, path = pafs.FileSystem.from_uri(name if "://" in name or name.startswith("file:") else f"file://{name}")
                    with fs.open_input_file(path) as raw:
                        meta = pq.ParquetFile(raw).metadata
                    names = {meta.schema.column(i).path.split(".")[0]: i for i in range(meta.num_columns)}
                    if needed - set(names):
                        raise ValueError("no column " + ", ".join(sorted(needed - set(names))))
                    sizes = [(s.min, s.max) if (s := meta.row_group(g).column(names[c]).statistics) and s.has_min_max else (-1, -1) for g in range(meta.num_row_groups) for c in ("h", "w")]
                    if any(lo != hi or lo != sizes[k % 2][0] for k, (lo, hi) in enumerate(sizes)):
                        raise ValueError("frames of several shapes")
                    n = meta.num_rows
                    h, w = (int(sizes[0][0]), int(sizes[1][0])) if sizes else (None, None)
                except Exception as e:  # noqa: BLE001 - whatever the reason, the file is left out and the reason told
                    n, problem = 0, f"{type(e).__name__}: {e}"[:300]
                out.append((int(pos), name, n, h, w, problem))
            got = pd.DataFrame(out, columns=["pos", "filename", "n_frames", "h", "w", "problem"])
            yield got.astype({"h": "Int32", "w": "Int32"})

    files = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "pos int, filename string")
    n = max(1, min(len(paths), spark.sparkContext.defaultParallelism * 4))
    seen = cut(files.repartition(n).mapInPandas(kernel, "pos int, filename string, n_frames long, h int, w int, problem string"))
    if height is None or width is None:
        first = seen.where("problem IS NULL AND n_frames > 0").orderBy("pos").select("h", "w").first()
        height, width = (first["h"], first["w"]) if first else (None, None)
    other = F.col("problem").isNull() & (F.col("n_frames") > 0) & ~(F.col("h").eqNullSafe(F.lit(height)) & F.col("w").eqNullSafe(F.lit(width)))
    shape = F.format_string(f"frames of %d x %d, not {height} x {width}", F.col("h"), F.col("w"))
    return seen.select("filename", "pos", F.when(other, F.lit(0)).otherwise(F.col("n_frames")).alias("n_frames"), F.coalesce("problem", F.when(other, shape)).alias("problem"))


def usable_files(scanned: DataFrame) -> list[str]:
    """The files without a problem in list order; each of the others is warned about."""
    rows = scanned.orderBy("pos").collect()  # the list of files
    for r in rows:
        if r["problem"] is not None:
            warnings.warn(f"{r['filename']} is left out: {r['problem']}", stacklevel=2)
    return [r["filename"] for r in rows if r["problem"] is None]


def check_placement(panels: Sequence[Panel], height: int, width: int) -> None:
    """Panels that reach over the frame, are turned inside out, or lie on each other are an error."""
    for k, p in enumerate(panels):
        if not (0 <= p.min_fs <= p.max_fs < width and 0 <= p.min_ss <= p.max_ss < height):
            raise ValueError(f"panel {p.name} does not lie in a frame of {height} x {width}")
        for q in panels[:k]:
            if p.min_fs <= q.max_fs and q.min_fs <= p.max_fs and p.min_ss <= q.max_ss and q.min_ss <= p.max_ss:
                raise ValueError(f"panels {q.name} and {p.name} overlap")


def read_mask(spark: SparkSession, path: str, rule, panels: Sequence[Panel] = ()) -> DataFrame:
    """``row, col, valid`` of a mask table: ``row, col, word``, or ``panel, ss, fs, word`` to be put in place.

    A pixel is good if its word has all good bits and no bad one; without either rule, if it is 0. A NULL word
    is bad.
    """
    words = spark.read.parquet(path)
    if "panel" in words.columns:
        words = assemble_panels(words.select(F.lit(0).cast("long").alias("frame_index"), "panel", "ss", "fs", F.col("word").alias("adu")), panels).withColumnRenamed("adu", "word")
    word = F.col("word").cast("long")
    ok = good_pixel(word, rule.good, rule.bad) if rule.good or rule.bad else word == 0
    return words.select("row", "col", F.coalesce(ok, F.lit(False)).alias("valid"))


def block_of(position: Column, total: Column | int, blocks: int) -> Column:
    """Which of ``blocks`` contiguous blocks, sizes differing by at most one (larger first), holds a position."""
    n = total if isinstance(total, Column) else F.lit(total)
    size, extra = F.floor(n / blocks), n % blocks
    head = extra * (size + 1)
    return F.when(position < head, F.floor(position / (size + 1))).otherwise(extra + F.floor((position - head) / F.greatest(size, F.lit(1)))).cast("int")


def serials(df: DataFrame, order: str, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``serial`` 1, 2, … in ascending ``order``, numbered in slices, not in one window."""
    one = df.withColumn("__all", F.lit(0))
    return dense_positions(one, ["__all"], F.floor(F.col(order) / width), [F.col(order)], "serial").drop("__all").withColumn("serial", F.col("serial") + 1)


def good_pixel(word: Column, good: int, bad: int) -> Column:
    """All good bits set and no bad one, on the two's complement of unsigned words."""
    wrap = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    return (word.bitwiseAND(F.lit(wrap(good)).cast("long")) == F.lit(wrap(good)).cast("long")) & (word.bitwiseAND(F.lit(wrap(bad)).cast("long")) == 0)


def static_mask(pixels: DataFrame, max_adu: float | None, bad_regions: Sequence[dict], mask: DataFrame | None = None) -> DataFrame:
    """``row, col, valid`` of the first frame: below the cut-off, in no bad region, good in the mask."""
    first = pixels.agg(F.min("frame_index").alias("frame_index"))
    at = pixels.join(F.broadcast(first), "frame_index", "left_semi")  # one row
    ok = F.lit(True) if max_adu is None else F.coalesce(F.col("adu") < max_adu, F.lit(False))
    for r in bad_regions:
        ok = ok & ~(F.col("row").between(r["min_ss"], r["max_ss"]) & F.col("col").between(r["min_fs"], r["max_fs"]))
    out = at.select("row", "col", ok.alias("valid"))
    if mask is None:
        return out
    return out.join(mask.select("row", "col", F.col("valid").alias("m")), ["row", "col"], "left").select("row", "col", (F.col("valid") & F.coalesce("m", F.lit(True))).alias("valid"))


def assemble_panels(slabs: DataFrame, panels: Sequence[Panel]) -> DataFrame:
    """``frame_index, row, col, adu`` in data space from ``frame_index, panel, ss, fs, adu``."""
    place = slabs.sparkSession.createDataFrame([(p.name, p.min_ss, p.min_fs, p.max_ss, p.max_fs) for p in panels], "panel string, min_ss int, min_fs int, max_ss int, max_fs int")
    at = slabs.join(F.broadcast(place), "panel")  # one row per panel
    return at.select("frame_index", (F.col("min_ss") + F.col("ss")).cast("int").alias("row"), (F.col("min_fs") + F.col("fs")).cast("int").alias("col"), "adu", "max_ss", "max_fs").where("row <= max_ss AND col <= max_fs").drop("max_ss", "max_fs")


def assemble_physical(pixels: DataFrame, panels: Sequence[Panel]) -> DataFrame:
    """Pixels at their nearest physical place (shifted so that the smallest is 0); later panels win."""
    if len(panels) < 2:
        raise ValueError("physical assembly needs two panels or more")
    rows = [(k, p.min_fs, p.max_fs, p.min_ss, p.max_ss, p.corner_x, p.corner_y, p.fs_x, p.fs_y, p.ss_x, p.ss_y) for k, p in enumerate(panels)]
    place = pixels.sparkSession.createDataFrame(rows, "o int, a int, b int, c int, d int, cx double, cy double, fx double, fy double, sx double, sy double")
    at = pixels.join(F.broadcast(place), (F.col("col") >= F.col("a")) & (F.col("col") <= F.col("b")) & (F.col("row") >= F.col("c")) & (F.col("row") <= F.col("d")))
    u, v = F.col("col") - F.col("a"), F.col("row") - F.col("c")
    xs = [p.corner_x + p.fs_x * u + p.ss_x * v for p in panels for u in (0, p.max_fs - p.min_fs) for v in (0, p.max_ss - p.min_ss)]
    ys = [p.corner_y + p.fs_y * u + p.ss_y * v for p in panels for u in (0, p.max_fs - p.min_fs) for v in (0, p.max_ss - p.min_ss)]
    x, y = F.col("cx") + F.col("fx") * u + F.col("sx") * v, F.col("cy") + F.col("fy") * u + F.col("sy") * v
    put = at.select("frame_index", "o", F.rint(y - F.lit(min(ys))).cast("int").alias("row"), F.rint(x - F.lit(min(xs))).cast("int").alias("col"), "adu")
    return put.groupBy("frame_index", "row", "col").agg(F.max_by("adu", "o").alias("adu"))


def radial_profile(pixels: DataFrame, center: tuple[float, float], bin_width: float = 1.0) -> DataFrame:
    """``bin, radius, mean`` of the finite pixels around a centre."""
    width = max(bin_width, 1.0)
    r = F.sqrt((F.col("row") - center[0]) ** 2 + (F.col("col") - center[1]) ** 2)
    ok = F.col("adu").isNotNull() & ~F.isnan("adu") & (F.abs("adu") < float("inf"))
    got = pixels.where(ok).groupBy(F.floor(r / width).cast("int").alias("bin")).agg(F.avg("adu").alias("mean"))
    return got.select("bin", ((F.col("bin") + 0.5) * width).alias("radius"), "mean")


def render_scale(pixels: DataFrame, lo: float = 0.01, hi: float = 0.995) -> DataFrame:
    """``vmin, vmax``: the percentiles between which an image is shown."""
    ok = F.when(~F.isnan("adu"), F.col("adu"))
    return pixels.agg(F.percentile(ok, F.array(F.lit(lo), F.lit(hi))).alias("p")).select(F.col("p")[0].alias("vmin"), F.col("p")[1].alias("vmax"))


def simulate_frames(spark: SparkSession, n: int, height: int, width: int, spots: DataFrame | None = None, mean: float = 100.0, sigma: float = 10.0, psf: float = 1.3, seed: int = 0) -> DataFrame:
    """Dense frames of normal noise with Gaussian spots (``frame_index, row, col, intensity``)."""
    per = None if spots is None else spots.groupBy("frame_index").agg(F.collect_list(F.struct("row", "col", "intensity")).alias("spots"))
    base = spark.range(n).withColumnRenamed("id", "frame_index")
    base = base.withColumn("spots", F.lit(None).cast("array<struct<row:double,col:double,intensity:double>>")) if per is None else base.join(per, "frame_index", "left")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yy, xx = np.mgrid[0:height, 0:width]
        for b in batches:
            out = []
            for f, spots_here in zip(b["frame_index"], b["spots"], strict=True):
                img = np.random.default_rng([seed, int(f)]).normal(mean, sigma, (height, width))
                for s in spots_here if spots_here is not None else []:
                    g = np.exp(-((yy - s["row"]) ** 2 + (xx - s["col"]) ** 2) / (2 * psf**2))
                    g[(yy - s["row"]) ** 2 + (xx - s["col"]) ** 2 > np.ceil(4 * psf) ** 2] = 0
                    img += s["intensity"] * g / max(g.sum(), 1e-12)
                out.append((int(f), "simulated", int(f), height, width, img.astype(np.float32).ravel().tolist()))
            yield pd.DataFrame(out, columns=["frame_index", "filename", "event", "h", "w", "pixels"])

    return base.mapInPandas(kernel, FRAME_SCHEMA)
