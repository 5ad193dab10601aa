"""Column-level data quality: a profile of every column, and columns that went bad in a load."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import cut
from lumenframe.sources.footers import Chunks, by_file, read_footers

#: A row holds counts of a chunk, or a distinct value as a number or a text, or names a chunk that is to be scanned.
PROFILE_SCHEMA = "column string, rows long, nulls long, lo double, hi double, chunks long, chunks_read long, v double, s string, file string"
#: Arrow types of the column types that the kernels below send.
ARROW = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "double": pa.float64(), "float": pa.float32(), "date": pa.date32(), "boolean": pa.bool_()}


def _batch(schema: str, n: int, columns: Mapping) -> pa.RecordBatch:
    """``n`` rows of a schema; single values are repeated, absent columns NULL. NaN is no NULL."""
    names, out = [], []
    for part in schema.split(", "):
        name, kind = part.split()
        x = columns.get(name)
        x = x if np.ndim(x) else [x] * n
        names.append(name)
        out.append(pa.array(x, ARROW[kind], from_pandas=False) if not isinstance(x, np.ndarray) or x.dtype != object else pa.array(x.tolist(), ARROW[kind]))
    return pa.RecordBatch.from_arrays(out, names=names)


NUMERIC = (T.DoubleType, T.FloatType, T.IntegerType, T.LongType, T.ShortType, T.ByteType)
REAL = (T.DoubleType, T.FloatType)


def _scan_profile(df: DataFrame, files: list[str], names: list[str], patterns: Mapping[str, str]) -> DataFrame:
    """Counts, extrema, violations and distinct values of some columns of some files, in one scan."""
    schema = T.StructType([df.schema[n] for n in names])
    rows = df.sparkSession.read.schema(schema).parquet(*files)
    none = F.lit(None)
    parts = []
    for n in names:
        x, kind = F.col(f"`{n}`"), df.schema[n].dataType
        number = x.cast("double") if isinstance(kind, NUMERIC) else none.cast("double")
        as_text = F.unix_micros(x.cast("timestamp")).cast("string") if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else x.cast("string")
        text = none.cast("string") if isinstance(kind, REAL) else as_text
        wrong = (~x.cast("string").rlike(patterns[n])).cast("long") if n in patterns else none.cast("long")
        parts.append(F.struct(F.lit(n).alias("column"), x.isNull().cast("long").alias("nulls"), number.alias("x"), (x.cast("double") + F.lit(0.0) if isinstance(kind, REAL) else none.cast("double")).alias("v"), text.alias("s"), wrong.alias("wrong")))
    long = rows.select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    finite = F.when(~F.isnan("x"), F.col("x"))
    return long.groupBy("column", "v", "s").agg(F.count(F.lit(1)).alias("rows"), F.sum("nulls").alias("nulls"), F.sum("wrong").alias("violations"), F.min(finite).alias("lo"), F.max(finite).alias("hi"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, patterns: Mapping[str, str] | None = None) -> DataFrame:
    """One row per column: ``column, rows, nulls, distinct, lo, hi, violations, chunks, chunks_read``.

    ``lo``/``hi`` are the extrema of number columns as doubles (NaN left out) and NULL for other
    types; ``violations`` counts non-NULL strings that do not match the column's pattern (NULL
    without a pattern). ``distinct`` counts distinct non-NULL values exactly (NaN is one value).

    Nulls and extrema come from the footers where those state them exactly, distinct values from
    dictionary pages where no data page left the dictionary; a chunk all of whose values are NULL needs
    neither. A column is scanned only in files with a chunk that these do not settle
    (``chunks_read`` of ``chunks``): one scan for each set of such columns, over the files that share it. A
    table that is no bare scan of Parquet files is written as such first. An empty table or one
    without files gives rows of zeros.
    """
    names = list(columns or df.columns)
    patterns = dict(patterns or {})
    temporal = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            chunks = Chunks(r["file"])
            for name in names:
                mine = [f for f in r["facts"] if f["column"] == name]
                heads, values, settled = [], [], name not in patterns
                for f in mine:
                    empty = f["rows"] == 0 or (f["exact"] and f["nulls"] == f["rows"])
                    found = chunks.dictionary(f["row_group"], name) if settled and not empty and f["exact"] and name not in temporal else None
                    settled = settled and (empty or found is not None)
                    if found is not None and not settled:
                        break
                    heads.append({"column": name, "rows": f["rows"], "nulls": f["rows"] if empty else f["nulls"], "lo": f["lo"], "hi": f["hi"], "chunks": 1, "chunks_read": 0})
                    if found is not None:
                        values.append(found)
                if not settled:
                    yield _batch(PROFILE_SCHEMA, 1, {"column": name, "chunks": len(mine), "chunks_read": len(mine), "file": r["file"]})
                    continue
                for h in heads:
                    text = any(isinstance(v, list) for v in values)
                    yield _batch(PROFILE_SCHEMA, 1, {k: None if text and k in ("lo", "hi") else v for k, v in h.items()})
                for v in values:
                    real = not isinstance(v, list) and v.dtype.kind == "f"
                    yield _batch(PROFILE_SCHEMA, len(v), {"column": name} | ({"v": v.astype(float) + 0.0} if real else {"s": [str(x) for x in v]}))
            chunks.close()

    told = cut(by_file(read_footers(df, names)).mapInArrow(kernel, PROFILE_SCHEMA))
    sets = told.where("file IS NOT NULL").groupBy("file").agg(F.array_sort(F.collect_set("column")).alias("set")).groupBy("set").agg(F.collect_list("file").alias("files"))
    figures = ["rows", "nulls", "violations", "chunks", "chunks_read"]
    zero = F.lit(0).cast("long")
    parts = told.withColumn("violations", F.lit(None).cast("long")).groupBy("column", "v", "s").agg(*[F.sum(c).alias(c) for c in figures], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    for r in sets.collect():  # the files to be scanned, as any scan has them
        parts = parts.unionByName(_scan_profile(df, r["files"], r["set"], patterns).select("column", "v", "s", "rows", "nulls", "violations", zero.alias("chunks"), zero.alias("chunks_read"), "lo", "hi"))
    per = parts.groupBy("column", "v", "s").agg(*[F.sum(c).alias(c) for c in figures], F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = per.groupBy("column").agg(*[F.sum(c).alias(c) for c in figures], F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count_if(F.col("v").isNotNull() | F.col("s").isNotNull()).alias("distinct"))
    head = df.sparkSession.createDataFrame([(n,) for n in names], "column string")
    whole = lambda c: F.coalesce(c, zero).alias(c)
    numeric = F.col("column").isin([n for n in names if isinstance(df.schema[n].dataType, NUMERIC)])
    extreme = lambda c: F.when(numeric, F.col(c) + F.lit(0.0)).alias(c)
    return head.join(total, "column", "left").select("column", whole("rows"), whole("nulls"), whole("distinct"), extreme("lo"), extreme("hi"), "violations", whole("chunks"), whole("chunks_read"))


@dataclass(frozen=True)
class BadLoadRule:
    """Limits of the comparison of a load with most loads. Shares are absolute differences; ``far``
    counts robust spreads on the logarithmic scale; ``noise`` counts standard errors of a load of
    its size."""

    null_share: float = 0.15
    bad_share: float = 0.08
    distinct_ratio: float = 0.6
    far: float = 5.0
    shift: float = 6.0
    shift_within: float = 0.8
    shape: float = 0.9
    distance: float = 0.2
    noise: float = 5.0
    least_rows: int = 5


PROBS = [round(0.05 * k, 2) for k in range(1, 20)]
#: ``c`` numbers the column; a row holds counts of a chunk, or a value ``v``, or names a file that is to be scanned.
LOAD_SCHEMA = "c int, rows long, nulls long, chunks long, chunks_read long, v double, file string"


def _settle_loads(facts: list[dict], chunks: Chunks, load: str, flag: str | None, columns: list[str]) -> list[dict] | None:
    """What the footer and the dictionaries of a file tell about its loads: columns of equal length of the
    rows of ``LOAD_SCHEMA``; None if they do not settle it, so that it has to be scanned.

    A row group is settled if its footer shows that no row has a load or passes the flag; or if it
    shows one load for all rows and the flag set for all, and each column is all NULL, or its dictionary
    holds a single value (then nulls, extrema, distinct values and distribution are known).
    """
    out = []
    for g in sorted({f["row_group"] for f in facts}):
        here = {f["column"]: f for f in facts if f["row_group"] == g}
        rows = here[load]["rows"]
        constant = lambda f: f["exact"] and f["nulls"] == 0 and f["lo"] is not None and f["lo"] == f["hi"]
        empty = lambda f: f["exact"] and f["nulls"] == f["rows"]
        if rows == 0 or empty(here[load]) or (flag and (empty(here[flag]) or (constant(here[flag]) and not here[flag]["hi"]))):
            continue
        if not constant(here[load]) or (flag and not constant(here[flag])):
            return None
        key = int(here[load]["lo"]) if float(here[load]["lo"]).is_integer() else here[load]["lo"]
        for c, name in enumerate(columns):
            f = here[name]
            if empty(f):
                out.append({"load": [key], "c": c, "rows": rows, "nulls": rows, "chunks": 1, "chunks_read": 0})
                continue
            # Extrema that differ already show more than one value; else the dictionary tells whether NaN is another.
            known = chunks.dictionary(g, name) if f["exact"] and f["lo"] == f["hi"] else None
            if known is None or isinstance(known, list) or len(known) != 1:
                return None
            out.append({"load": [key], "c": c, "rows": rows, "nulls": f["nulls"], "chunks": 1, "chunks_read": 0})
            out.append({"load": [key] * (rows - f["nulls"]), "c": c, "rows": 0, "v": float(known[0])})
    return out


def load_profiles(df: DataFrame, load: str, columns: Sequence[str], positive: bool = True, rule: BadLoadRule = BadLoadRule(), flag: str | None = None) -> DataFrame:
    """One row per load and column: ``rows, nulls, impossible, outside, distinct, quantiles, lo, hi, chunks, scanned``.

    ``flag`` names a truth column: rows in which it is not true are left out. ``impossible``: NaN,
    infinite, or not above 0 (``positive``). ``outside``: possible values that lie further than
    ``far`` usual spreads from the usual level, both taken over the loads. ``distinct`` is exact (NaN
    is one value), the quantiles are rank-bounded summaries (1/10 000), extrema leave NaN out.

    Footers and dictionaries settle the files that they can (see ``_settle_loads``); of the others the named
    columns are scanned. ``chunks`` counts the column chunks that hold rows of the load in settled
    files, ``scanned`` the rows that came from a scan. A table that is no bare scan of Parquet files is
    written as such first, so its filters hold. All figures are mergeable aggregates, so a load of any
    size is gathered in no task. ``load`` must be a number, a text or a date. Rows whose load is NULL
    belong to no load and are left out; an empty table gives no rows.
    """
    names = list(columns)
    kind = df.schema[load].dataType.simpleString()
    schema = f"load {kind}, {LOAD_SCHEMA}"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            chunks = Chunks(r["file"])
            got = _settle_loads(r["facts"], chunks, load, flag, names)
            chunks.close()
            if got is None:
                yield _batch(schema, 1, {"file": r["file"]})
            for part in got or []:
                yield _batch(schema, len(part["load"]), part)

    told = cut(by_file(read_footers(df, [load, *([flag] if flag else []), *names])).mapInArrow(kernel, schema))
    files = [r["file"] for r in told.where("file IS NOT NULL").select("file").collect()]  # as any scan has them
    long = told.where("file IS NULL").select("load", "c", "rows", "nulls", "chunks", F.lit(0).cast("long").alias("scanned"), "v")
    if files:
        read = df.sparkSession.read.schema(T.StructType([df.schema[n] for n in dict.fromkeys([load, *([flag] if flag else []), *names])])).parquet(*files)
        read = read.where(F.col(load).isNotNull() & (F.col(flag) if flag else F.lit(True)))
        stack = ", ".join(f"{k}, cast(`{n}` as double)" for k, n in enumerate(names))
        one = F.lit(1).cast("long")
        rows = read.selectExpr(f"`{load}` AS load", f"stack({len(names)}, {stack}) AS (c, v)")
        long = long.unionByName(rows.select("load", "c", one.alias("rows"), F.col("v").isNull().cast("long").alias("nulls"), F.lit(0).cast("long").alias("chunks"), one.alias("scanned"), "v"))
    long = cut(long)  # read three times below
    ok = F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < F.lit(float("inf")))
    if positive:
        ok = ok & (F.col("v") > 0)
    long = long.withColumn("ok", ok)
    zero = F.lit(0).cast("long")
    per = long.groupBy("load", "c").agg(
        *[F.coalesce(F.sum(n), zero).alias(n) for n in ("rows", "nulls", "chunks", "scanned")],
        F.count_if(F.col("v").isNotNull() & ~F.col("ok")).alias("impossible"),
        F.percentile_approx(F.when(F.col("ok"), F.col("v")), PROBS, 10000).alias("quantiles"),
        F.min(F.when(~F.isnan("v"), F.col("v"))).alias("lo"), F.max(F.when(~F.isnan("v"), F.col("v"))).alias("hi"),
    )
    distinct = long.where("v IS NOT NULL").select("load", "c", "v").distinct().groupBy("load", "c").agg(F.count(F.lit(1)).alias("distinct"))
    # The usual level and spread: medians over the loads, of figures that are themselves robust.
    q = F.col("quantiles")
    fig = per.where(F.size(q) == len(PROBS)).select("c", F.log(q[9]).alias("level"), ((F.log(q[17]) - F.log(q[1])) / 2.563).alias("width"))
    usual = fig.groupBy("c").agg(F.median("level").alias("level"), F.median("width").alias("width"))
    between = fig.select("c", F.col("level").alias("one")).join(usual, "c").groupBy("c").agg((F.median(F.abs(F.col("one") - F.col("level"))) * 1.4826).alias("between"))
    usual = usual.join(between, "c").select("c", "level", (F.sqrt(F.col("width") ** 2 + F.col("between") ** 2) * rule.far).alias("reach"))
    # One row per column: as small as the list of columns, whatever the size of the table.
    far = long.where("ok").join(F.broadcast(usual), "c", "inner").groupBy("load", "c").agg(F.count_if(F.abs(F.log("v") - F.col("level")) > F.greatest("reach", F.lit(0.5))).alias("outside"))
    name = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1)
    return per.join(far, ["load", "c"], "left").join(distinct, ["load", "c"], "left").select(
        "load", name.alias("column"), "rows", "nulls", "impossible", F.coalesce("outside", zero).alias("outside"), F.coalesce("distinct", zero).alias("distinct"), "quantiles", "lo", "hi", "chunks", "scanned"
    )


def _room(n: float, k: float) -> float:
    """Distinct values expected among n draws from k equally likely ones."""
    return k * -np.expm1(-n / k)


def _choices(n: float, d: float) -> float:
    """The number of equally likely values that gives d distinct ones among n, at most 1e12."""
    if n <= 0 or d <= 0:
        return np.nan
    if d >= n * (1 - 1e-9):
        return 1e12
    lo, hi = d, 1e12
    for _ in range(80):
        mid = np.sqrt(lo * hi)
        lo, hi = (mid, hi) if _room(n, mid) < d else (lo, mid)
    return hi


def _median(x: np.ndarray) -> np.ndarray | float:
    """Median (per column) of what is not NaN; NaN where nothing is."""
    if x.ndim == 2:
        return np.array([_median(c) for c in x.T])
    x = x[~np.isnan(x)]
    return float(np.median(x)) if len(x) else np.nan


def judge_loads(p: pd.DataFrame, rule: BadLoadRule) -> pd.DataFrame:
    """Compare the loads of one column with each other; a row per load with the reasons."""
    n = p["rows"].to_numpy(float)
    filled = n - p["nulls"].to_numpy(float)
    reasons = [[] for _ in range(len(p))]

    def flag(mask: np.ndarray, why: str) -> None:
        for i in np.flatnonzero(mask):
            reasons[i].append(why)

    def excess(share: np.ndarray, size: np.ndarray, least: float) -> np.ndarray:
        usual = _median(share)
        se = np.sqrt(np.maximum(usual * (1 - usual), 0.01) / np.maximum(size, 1))
        return (size >= rule.least_rows) & (share - usual > np.maximum(least, rule.noise * 0.6 * se))

    with np.errstate(all="ignore"):
        flag(excess(p["nulls"].to_numpy(float) / n, n, rule.null_share), "nulls")
        bad = (p["impossible"] + p["outside"]).to_numpy(float)
        flag(excess(np.where(filled > 0, bad / np.maximum(filled, 1), 0.0), filled, rule.bad_share), "values")
        d = p["distinct"].to_numpy(float)
        ratio = d / np.maximum(filled, 1)
        k = np.array([_choices(a, min(b, a)) for a, b in zip(filled, d, strict=True)])
        usual_k = _median(k)
        expected = np.array([_room(a, usual_k) / max(a, 1) for a in filled]) * _median(np.minimum(ratio / np.array([_room(a, usual_k) / max(a, 1) for a in filled]), 1.0))
        flag((filled >= 2 * rule.least_rows) & (ratio < rule.distinct_ratio * expected), "distinct")
        q = np.array([x if x is not None and len(x) == len(PROBS) else [np.nan] * len(PROBS) for x in p["quantiles"]], float)
        lq = np.log(q)
        size_ok = filled >= 2 * rule.least_rows
        level, width = lq[:, 9], (lq[:, 17] - lq[:, 1]) / 2.563
        mid, w = _median(level), _median(width)
        between = 1.4826 * _median(np.abs(level - mid))
        shift = np.abs(level - mid)
        flag(size_ok & (shift > np.maximum.reduce([np.full(len(n), rule.shift * between), np.full(len(n), rule.shift_within * w), rule.noise * 1.25 * w / np.sqrt(np.maximum(filled, 1))])), "level")
        u = np.log(np.maximum(lq[:, 14] - lq[:, 4], 1e-6))
        du = np.abs(u - _median(u))
        mad_u = 1.4826 * _median(du)
        flag(size_ok & (du > np.maximum(rule.shape, rule.shift * mad_u)) & (du > rule.noise * 1.6 / np.sqrt(np.maximum(filled, 1))), "spread")
        ref = _median(lq)
        dist = np.array([np.nan if np.isnan(x).any() else np.max(np.abs(np.interp(ref, x, PROBS, left=0.0, right=1.0) - PROBS)) for x in lq])
        dm = _median(dist)
        mad_d = 1.4826 * _median(np.abs(dist - dm))
        flag(size_ok & (dist > np.maximum(rule.distance, dm + rule.shift * mad_d)) & (dist > 2.5 / np.sqrt(np.maximum(filled, 1))), "distribution")
    return pd.DataFrame({"load": p["load"], "column": p["column"], "reasons": [",".join(r) for r in reasons]})


def bad_loads(df: DataFrame, load: str, columns: Sequence[str], rule: BadLoadRule = BadLoadRule(), flag: str | None = None) -> DataFrame:
    """Loads and columns that plainly differ from most loads: ``load, column, reasons``.

    Compared are the share of NULLs, the share of impossible or far-out values, the number of
    distinct values for the load's size, the level, the spread and the distribution (largest
    distance between the load's distribution function and that of the median load). Each limit has
    an absolute part, a part in robust spreads between the loads, so a column that differs from load
    to load anyway needs a larger difference, and a part for the noise of small loads.

    The comparison sees one row per load and column, never the data; these come from footers
    and dictionaries, and from a scan of the files that those do not settle (``load_profiles``).
    """
    prof = load_profiles(df, load, columns, rule=rule, flag=flag)
    kind = df.schema[load].dataType.simpleString()

    def kernel(p: pd.DataFrame) -> pd.DataFrame:
        return judge_loads(p, rule)

    judged = prof.select("load", "column", "rows", "nulls", "impossible", "outside", "distinct", "quantiles").groupBy("column").applyInPandas(kernel, f"load {kind}, column string, reasons string")
    return judged.where("reasons <> ''")
