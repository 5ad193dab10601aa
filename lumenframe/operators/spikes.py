"""Implausible readings: spikes, stuck values and impossible values, per source and measure."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.positions import dense_positions
from lumenframe.session import cut


@dataclass(frozen=True)
class Bound:
    """The smallest possible value of a measure; ``strict`` excludes the bound itself."""

    low: float = -float("inf")
    strict: bool = False


@dataclass(frozen=True)
class SpikeRule:
    """``spreads``: how many usual spreads a robust detail of a spike exceeds. ``run``: how many equal
    values in a row are stuck. ``side``: values on each side that make the local level. ``gate``: the
    scaled Haar detail from which a value is looked at; low enough that no spike passes beneath.
    ``levels``: of the Haar decomposition. ``trim``: of the details that make the usual spread."""

    spreads: float = 8.0
    run: int = 6
    side: int = 9
    gate: float = 3.0
    trim: float = 3.5
    levels: int = 3
    chunk: int = 2048
    slice_width: int = 4096


def _chunked(df: DataFrame, keys: list[str], halo: int, chunk: int) -> DataFrame:
    """``df`` (with positions ``pos``) cut into chunks, each with ``halo`` rows more on both sides; ``own``
    tells a chunk's rows from those of its neighbours."""
    home = F.floor(F.col("pos") / chunk)
    first, last = F.floor((F.col("pos") - halo) / chunk), F.floor((F.col("pos") + halo) / chunk)
    return df.withColumn("chunk", F.explode(F.sequence(F.greatest(first, F.lit(0)), last))).withColumn("own", F.col("chunk") == home)


def _median(values: Column) -> Column:
    """The median of an array of numbers."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0


def stuck_values(at: DataFrame, keys: list[str], rule: SpikeRule) -> DataFrame:
    """``at`` (``pos``, ``v``) with ``d``, the size of the finest detail to the value before, and ``stuck``: the
    value belongs to a run of at least ``run`` equal ones, read off as ``run`` - 1 zero details in a row.
    A run is seen whole from any of its values ``run`` - 1 places away, so chunks change nothing."""
    w = Window.partitionBy(*keys, "chunk").orderBy("pos")
    zero = F.when(F.col("d") == 0, 1).otherwise(0)
    got = (
        _chunked(at, keys, rule.run, rule.chunk)
        .withColumn("d", F.abs(F.col("v") - F.lag("v").over(w)))
        .withColumn("ends", F.sum(zero).over(w.rowsBetween(2 - rule.run, 0)) == rule.run - 1)
        .withColumn("stuck", F.max("ends").over(w.rowsBetween(0, rule.run - 1)))
        # The detail between two stuck values of one run is 0 and tells nothing about the spread.
        .withColumn("flat", (F.col("d") == 0) & F.col("stuck"))
    )
    return got.where("own").drop("chunk", "own", "ends")


def usual_spread(at: DataFrame, keys: list[str], rule: SpikeRule) -> DataFrame:
    """``keys…, sigma, varies``: the usual spread of undisturbed values, from the finest details.

    First the median detail (of the non-zero ones where coarse rounding makes it 0), then the root
    mean square of the details that a normal spread of that size allows: few spikes in a short source
    already move the median, but not the second figure. Only mergeable aggregates are gathered.
    """
    d = at.where("d IS NOT NULL AND NOT flat AND possible AND NOT isnan(d) AND d < double('infinity')").select(*keys, "d")
    rough = d.groupBy(*keys).agg(
        F.percentile_approx("d", 0.5, 10000).alias("q"),
        F.percentile_approx(F.when(F.col("d") > 0, F.col("d")), 0.5, 10000).alias("q_changed"),
        F.count_if(F.col("d") > 0).alias("changes"),
    )
    cap = F.when(F.col("q") > 0, F.col("q")).otherwise(F.col("q_changed")) * F.lit(rule.trim / 0.6745)
    rough = rough.select(*keys, cap.alias("cap"), (F.col("changes") >= 3).alias("varies"))
    fine = d.join(rough, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.when(F.col("d") <= F.col("cap"), F.col("d") * F.col("d"))) / 2).alias("sigma"), F.first("varies").alias("varies"))
    return fine.select(*keys, F.coalesce("sigma", F.lit(0.0)).alias("sigma"), "varies")


def spikes(clean: DataFrame, keys: list[str], rule: SpikeRule) -> DataFrame:
    """Rows of ``clean`` (dense ``pos``, ``v``, ``sigma``) whose scaled details are those of a spike.

    The undecimated Haar decomposition gives the mean of h values less that of the h values after
    them, for h = 1, 2, 4 … Scaled by sigma, a detail above ``gate`` marks the values it covers. Of
    these the robust detail decides: the distance of the value from the median of ``side`` values before
    it, after it, or on both sides, whichever is least (a side of few values at the end of a source
    does not count alone), above ``spreads`` sigma. So neither drift nor a lasting change of level
    is a spike. Chunks carry ``side`` values more on both sides, all that any of this looks at.
    """
    w = Window.partitionBy(*keys, "chunk").orderBy("pos")
    got = _chunked(clean, keys, max(rule.side, 2**rule.levels), rule.chunk)
    marked = F.lit(False)
    for level in range(rule.levels):
        h = 1 << level
        whole = F.count("v").over(w.rowsBetween(0, 2 * h - 1)) == 2 * h
        detail = F.abs(F.avg("v").over(w.rowsBetween(0, h - 1)) - F.avg("v").over(w.rowsBetween(h, 2 * h - 1))) * F.lit((h / 2.0) ** 0.5)
        got = got.withColumn(f"h{level}", F.when(whole, detail))
    for level in range(rule.levels):
        got = got.withColumn(f"h{level}", F.max(f"h{level}").over(w.rowsBetween(1 - (2 << level), 0)))
        marked = marked | F.coalesce(F.col(f"h{level}") > F.lit(rule.gate) * F.col("sigma"), F.lit(False))
    got = got.withColumn("left", F.collect_list("v").over(w.rowsBetween(-rule.side, -1))).withColumn("right", F.collect_list("v").over(w.rowsBetween(1, rule.side)))
    many = lambda c: F.size(c) >= rule.side - 2
    off = lambda level: F.abs(F.col("v") - level)
    both = F.concat("left", "right")
    near = F.least(F.when(many("left"), off(_median(F.col("left")))), F.when(many("right"), off(_median(F.col("right")))), F.when(F.size(both) > 0, off(_median(both))))
    return got.where(F.col("own") & marked).where(near > F.lit(rule.spreads) * F.col("sigma")).select(*clean.columns)


def implausible_readings(
    df: DataFrame,
    source: str,
    order: str,
    row: str,
    measures: Mapping[str, Bound],
    rule: SpikeRule = SpikeRule(),
) -> DataFrame:
    """Readings that do not fit their source: ``row``, ``measure``, ``reason``, ``value``.

    Per source and measure the non-NULL values are numbered in (``order``, ``row``) order; rows with
    the same order and row id count once (the smallest value is kept if they differ). A reading is
    'impossible' if it is NaN, infinite or beyond its bound, else 'stuck' if it belongs to ``run`` or
    more equal values in a row (``stuck_values``) in a source where the measure otherwise varies, else
    'spike' by its scaled wavelet details among the readings that are neither (``spikes``), against
    the source's usual spread (``usual_spread``). NULL readings are no readings; a NULL source is a
    source of its own; a NULL order comes first. Rows with a NULL row id take part in the levels and
    are reported with a NULL id. An empty table gives no rows.

    A source is cut into slices and then into chunks with a halo on both sides, so one source may
    hold any share of the table, and where the cuts lie changes nothing. Only the scale (two
    quantiles of a mergeable summary, sums and counts) is gathered per source, by partial aggregation. All
    of it are built-in window and array expressions.
    """
    names = list(measures)
    keys = ["src", "m"]
    coded = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    stack = ", ".join(f"{k}, cast(v{k} as double)" for k in range(len(names)))
    long = (
        df.select(coded.alias("src"), F.col(order).alias("ord"), F.col(row).alias("row"), *[F.col(m).alias(f"v{k}") for k, m in enumerate(names)])
        .selectExpr("src", "ord", "row", f"stack({len(names)}, {stack}) as (m, v)")
        .where("v IS NOT NULL")
    )
    bucket = F.coalesce(F.floor(F.col("ord") / F.lit(rule.slice_width)).cast("long"), F.lit(-1).cast("long"))
    by = [F.col("ord").asc_nulls_first(), F.col("row").asc_nulls_first(), F.col("v")]
    w = Window.partitionBy("src", "m", "__bucket").orderBy(*by)
    once = (
        long.withColumn("__bucket", bucket)
        .withColumn("before", F.lag(F.struct("ord", "row")).over(w))
        .where(F.col("before").isNull() | F.col("row").isNull() | ~F.struct("ord", "row").eqNullSafe(F.col("before")))
        .select("src", "m", "ord", "row", "v")
    )
    low = F.element_at(F.array(*[F.lit(float(max(measures[m].low, -1e308))) for m in names]), F.col("m") + 1)
    strict = F.element_at(F.array(*[F.lit(measures[m].strict) for m in names]), F.col("m") + 1)
    possible = ~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))) & F.when(strict, F.col("v") > low).otherwise(F.col("v") >= low)
    at = dense_positions(once, keys, F.floor(F.col("ord") / F.lit(rule.slice_width)), by).withColumn("possible", possible)
    told = cut(stuck_values(at, keys, rule).select(*keys, "pos", "row", "v", "d", "flat", "stuck", "possible"))
    scale = usual_spread(told, keys, rule)
    judged = told.drop("d", "flat").join(scale, keys, "left").withColumn("stuck", F.col("stuck") & F.coalesce("varies", F.lit(False)))
    plain = judged.select(*keys, "row", "v", F.when(~F.col("possible"), "impossible").when(F.col("stuck"), "stuck").alias("reason")).where("reason IS NOT NULL")
    clean = judged.where("possible AND NOT stuck AND sigma IS NOT NULL").select(*keys, "row", "v", "sigma", F.col("pos").alias("place"))
    clean = dense_positions(clean, keys, F.floor(F.col("place") / F.lit(rule.slice_width)), [F.col("place")])
    found = plain.unionByName(spikes(clean, keys, rule).select(*keys, "row", "v", F.lit("spike").alias("reason")))
    name = F.element_at(F.array(*[F.lit(m) for m in names]), F.col("m") + 1)
    return found.select(F.col("row").alias(row), name.alias("measure"), "reason", F.col("v").alias("value"))
