"""Queries of the general data-quality operators: problems 2, 5 and 6."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.orphans import Entity, ForeignKey, find_orphans, orphan_report
from lumenframe.operators.profile import bad_loads, profile_columns
from lumenframe.operators.spikes import Bound, implausible_readings
from lumenframe.session import table

MEASURES = {"scale": Bound(0.0, strict=True), "rmsd": Bound(0.0), "n_peaks": Bound(0.0)}
PROFILED = ["rmsd", "mosaicity_deg", "diffraction_limit_nm_inv"]


def _readings(spark: SparkSession, d: str) -> DataFrame:
    return implausible_readings(table(spark, d, "frames"), "filename", "event", "frame_index", MEASURES)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _readings(spark, d).select("frame_index", "measure").distinct()


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """Implausible readings per measure and reason."""
    return _readings(spark, d).groupBy("measure", "reason").agg(F.count(F.lit(1)).alias("readings"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return bad_loads(table(spark, d, "frames"), "load_id", PROFILED, flag="indexed").select(F.col("load").alias("load_id"), F.col("column").alias("column_name"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of every column of frames; footers settle what they can."""
    got = profile_columns(table(spark, d, "frames"), patterns={"frame_id": "^[0-9a-f]{16}$"})
    return got.select("column", "rows", "nulls", F.col("distinct").alias("distinct_values"), F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "violations")


def _orphans(spark: SparkSession, d: str, *children: str) -> DataFrame:
    ids = {"reflections": "reflection_id", "peaks": "peak_id"}
    entities = {"frames": Entity(table(spark, d, "frames"), "frame_id", "removed_at", "loaded_at", "load_id")}
    entities |= {c: Entity(table(spark, d, c), ids[c], None, "loaded_at", "load_id") for c in children}
    return find_orphans(entities, [ForeignKey(c, "frame_id", "frames", "frame_id") for c in children])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = _orphans(spark, d, "reflections")
    return found.select(F.col("row").cast("long").alias("reflection_id"), "kind").distinct()


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans of reflections and peaks per load, kind and directness."""
    report = orphan_report(_orphans(spark, d, "reflections", "peaks"))
    return report.select(F.col("table").alias("table_name"), F.col("period").cast("int").alias("load_id"), "kind", F.when(F.col("level") == 0, "direct").otherwise("inherited").alias("how"), "rows")


def p6_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows orphaned directly and through others once a region is withdrawn, down to the line items."""
    t = {n: table(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    region = t["region"].withColumn("removed", F.when(F.col("r_name") == "ASIA", F.lit("withdrawn")))
    line = t["lineitem"].withColumn("line", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")))
    entities = {
        "region": Entity(region, "r_regionkey", "removed"), "nation": Entity(t["nation"], "n_nationkey"), "customer": Entity(t["customer"], "c_custkey"),
        "orders": Entity(t["orders"], "o_orderkey"), "lineitem": Entity(line, "line"),
    }
    keys = [ForeignKey("nation", "n_regionkey", "region", "r_regionkey"), ForeignKey("customer", "c_nationkey", "nation", "n_nationkey"), ForeignKey("orders", "o_custkey", "customer", "c_custkey"), ForeignKey("lineitem", "l_orderkey", "orders", "o_orderkey")]
    report = orphan_report(find_orphans(entities, keys))
    return report.select(F.col("table").alias("table_name"), "kind", "level", "rows")


QUERIES = {f.__name__: f for f in (p2_found, p2_sources, p5_found, p5_profile, p6_found, p6_report, p6_cascade)}

_PARENTS = """parents AS (SELECT lower(trim(frame_id)) AS k, bool_and(removed_at IS NOT NULL) AS gone, min(loaded_at) AS came
  FROM frames WHERE frame_id IS NOT NULL GROUP BY 1)"""
_KIND = "CASE WHEN p.k IS NULL THEN 'missing' WHEN p.gone THEN 'deleted' WHEN p.came > c.loaded_at THEN 'late' END"
_CHILD = """SELECT DISTINCT '{t}' AS table_name, c.{i} AS row_id, c.load_id, {kind} AS kind
  FROM {t} c LEFT JOIN parents p ON lower(trim(c.frame_id)) = p.k
  WHERE c.frame_id IS NOT NULL AND (p.k IS NULL OR p.gone OR p.came > c.loaded_at)"""

#: The columns of frames by kind, for the SQL that profiles each of them.
_WHOLE = ["frame_index", "event", "serial", "n_peaks", "n_indexed", "n_bright", "num_reflections", "load_id"]
_REAL = [
    "rmsd", "scale", "scale_sigma", "mosaicity_deg", "profile_radius_nm_inv", "enrichment", "enrich_p", "diffraction_limit_nm_inv",
    "peak_resolution_nm_inv", "cell_a_a", "cell_b_a", "cell_c_a", "cell_alpha_deg", "cell_beta_deg", "cell_gamma_deg",
    "astar_x", "astar_y", "astar_z", "bstar_x", "bstar_y", "bstar_z", "cstar_x", "cstar_y", "cstar_z",
]
_OTHER = ["frame_id", "filename", "indexed", "loaded_at", "removed_at"]


def _profile_sql() -> str:
    out = []
    for c in [*_WHOLE, *_REAL, *_OTHER]:
        value = f"CAST({c} AS DOUBLE)" if c not in _OTHER else "CAST(NULL AS DOUBLE)"
        lo, hi = f"round(min(CASE WHEN NOT isnan({value}) THEN {value} END), 6)", f"round(max(CASE WHEN NOT isnan({value}) THEN {value} END), 6)"
        wrong = f"count(*) FILTER (WHERE NOT regexp_matches({c}, '^[0-9a-f]{{16}}$'))" if c == "frame_id" else "CAST(NULL AS BIGINT)"
        out.append(
            f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, "
            f"{lo} AS lo, {hi} AS hi, {wrong} AS violations FROM frames"
        )
    return " UNION ALL ".join(out)


#: Loads that differ from most, by plainer rules than the operator's: shares against their medians over the loads,
#: distinct values for the size, and the median and the middle half on the logarithmic scale.
_BAD_LOADS = f"""WITH x AS ({" UNION ALL ".join(f"SELECT load_id, '{c}' AS column_name, {c} AS v FROM frames WHERE indexed AND load_id IS NOT NULL" for c in PROFILED)}),
ok AS (SELECT *, v IS NOT NULL AND isfinite(v) AND v > 0 AS good FROM x),
q AS (SELECT load_id, column_name, count(*) AS n, count(v) AS filled, 1.0 - count(v) / count(*)::DOUBLE AS nulls, count(*) FILTER (WHERE v IS NOT NULL AND NOT good) AS wrong,
  count(DISTINCT v) / greatest(count(v), 1)::DOUBLE AS variety, quantile_disc(ln(g), [0.1, 0.25, 0.5, 0.75, 0.9]) AS l FROM (SELECT *, CASE WHEN good THEN v END AS g FROM ok) GROUP BY 1, 2),
u AS (SELECT column_name, median(nulls) AS nulls, median(l[3]) AS level, median(l[5] - l[1]) / 2.563 AS width, median(ln(greatest(l[4] - l[2], 1e-6))) AS half, median(variety) AS variety FROM q GROUP BY 1),
b AS (SELECT column_name, 1.4826 * median(abs(l[3] - u.level)) AS between_loads, 1.4826 * median(abs(ln(greatest(l[4] - l[2], 1e-6)) - u.half)) AS between_halves FROM q JOIN u USING (column_name) GROUP BY 1),
f AS (SELECT load_id, column_name, count(*) FILTER (WHERE good AND abs(ln(g) - u.level) > greatest(0.5, 5.0 * sqrt(u.width * u.width + b.between_loads * b.between_loads))) AS far
  FROM (SELECT load_id, column_name, good, CASE WHEN good THEN v END AS g FROM ok) o JOIN u USING (column_name) JOIN b USING (column_name) GROUP BY 1, 2)
SELECT load_id, column_name FROM q JOIN u USING (column_name) JOIN b USING (column_name) JOIN f USING (load_id, column_name) WHERE
  (n >= 5 AND q.nulls - u.nulls > greatest(0.15, 0.3 / sqrt(n)))
  OR (filled >= 5 AND (wrong + far) / filled::DOUBLE > greatest(0.08, 0.3 / sqrt(filled)))
  OR (filled >= 10 AND q.variety < 0.6 * u.variety)
  OR (filled >= 10 AND abs(l[3] - u.level) > greatest(6.0 * between_loads, 0.8 * u.width, 6.25 * u.width / sqrt(filled)))
  OR (filled >= 10 AND abs(ln(greatest(l[4] - l[2], 1e-6)) - u.half) > greatest(0.9, 6.0 * between_halves, 8.0 / sqrt(filled)))"""

def _readings_sql() -> str:
    """All steps of the rule on whole sources: runs of equal values, usual spread, Haar details, local medians."""
    long = " UNION ALL ".join(f"SELECT filename AS s, '{m}' AS measure, event AS e, frame_index AS f, {m}::DOUBLE AS v, {'v > 0' if b.strict else 'v >= 0'} AND isfinite(v) AS possible FROM frames WHERE {m} IS NOT NULL" for m, b in MEASURES.items())
    haar = lambda h: f"CASE WHEN count(v) OVER (p ROWS BETWEEN CURRENT ROW AND {2 * h - 1} FOLLOWING) = {2 * h} THEN abs(avg(v) OVER (p ROWS BETWEEN CURRENT ROW AND {h - 1} FOLLOWING) - avg(v) OVER (p ROWS BETWEEN {h} FOLLOWING AND {2 * h - 1} FOLLOWING)) * sqrt({h} / 2.0) END AS h{h}"
    part = "PARTITION BY s, measure ORDER BY e, f"
    return f"""r0 AS (SELECT DISTINCT ON (s, measure, e, f) * FROM ({long}) ORDER BY s, measure, e, f, v),
r1 AS (SELECT *, abs(v - lag(v) OVER p) AS d FROM r0 WINDOW p AS ({part})),
r2 AS (SELECT *, sum((d = 0)::INTEGER) OVER (p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5 AS ends FROM r1 WINDOW p AS ({part})),
r3 AS (SELECT *, coalesce(max(ends::INTEGER) OVER (p ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), 0) = 1 AS stuck FROM r2 WINDOW p AS ({part})),
de AS (SELECT s, measure, d FROM r3 WHERE possible AND isfinite(d) AND NOT (d = 0 AND stuck)),
ro AS (SELECT s, measure, count(*) FILTER (WHERE d > 0) >= 3 AS varies, quantile_disc(d, 0.5) AS q, quantile_disc(CASE WHEN d > 0 THEN d END, 0.5) AS qc FROM de GROUP BY 1, 2),
sg AS (SELECT s, measure, any_value(varies) AS varies, coalesce(sqrt(avg(d * d) FILTER (WHERE d <= CASE WHEN q > 0 THEN q ELSE qc END * {3.5 / 0.6745!r}::DOUBLE) / 2), 0.0) AS sigma FROM de JOIN ro USING (s, measure) GROUP BY 1, 2),
jd AS (SELECT r3.* EXCLUDE (stuck), sigma, stuck AND coalesce(varies, false) AS stuck FROM r3 LEFT JOIN sg USING (s, measure)),
cl AS (SELECT * FROM jd WHERE possible AND NOT stuck AND sigma IS NOT NULL),
w1 AS (SELECT *, {haar(1)}, {haar(2)}, {haar(4)} FROM cl WINDOW p AS ({part})),
w2 AS (SELECT *, {", ".join(f"coalesce(max(h{h}) OVER (p ROWS BETWEEN {2 * h - 1} PRECEDING AND CURRENT ROW) > 3.0 * sigma, false) AS m{h}" for h in (1, 2, 4))},
  median(v) OVER (p ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS l0, count(v) OVER (p ROWS BETWEEN 9 PRECEDING AND 1 PRECEDING) AS n0,
  median(v) OVER (p ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS l1, count(v) OVER (p ROWS BETWEEN 1 FOLLOWING AND 9 FOLLOWING) AS n1,
  median(v) OVER (p ROWS BETWEEN 9 PRECEDING AND 9 FOLLOWING EXCLUDE CURRENT ROW) AS l2 FROM w1 WINDOW p AS ({part})),
found AS (SELECT f, measure, CASE WHEN NOT possible THEN 'impossible' ELSE 'stuck' END AS reason FROM jd WHERE NOT possible OR stuck
  UNION ALL SELECT f, measure, 'spike' FROM w2 WHERE (m1 OR m2 OR m4) AND least(CASE WHEN n0 >= 7 THEN abs(v - l0) END, CASE WHEN n1 >= 7 THEN abs(v - l1) END, abs(v - l2)) > 8.0 * sigma)"""


ORACLE = {
    "p2_found": f"WITH {_readings_sql()} SELECT DISTINCT f AS frame_index, measure FROM found",
    "p2_sources": f"WITH {_readings_sql()} SELECT measure, reason, count(*) AS readings FROM found GROUP BY 1, 2",
    "p5_found": _BAD_LOADS,
    "p6_found": f"WITH {_PARENTS} SELECT row_id AS reflection_id, kind FROM ({_CHILD.format(t='reflections', i='reflection_id', kind=_KIND)})",
    "p6_report": f"""WITH {_PARENTS}, found AS ({_CHILD.format(t="reflections", i="reflection_id", kind=_KIND)}
  UNION ALL {_CHILD.format(t="peaks", i="peak_id", kind=_KIND)})
SELECT table_name, load_id, kind, 'direct' AS how, count(*) AS rows FROM found GROUP BY 1, 2, 3""",
    "p6_cascade": """WITH RECURSIVE e AS (SELECT 'nation' AS t, n_nationkey::VARCHAR AS r, 'region' AS pt, n_regionkey::VARCHAR AS pk FROM nation UNION SELECT 'customer', c_custkey::VARCHAR, 'nation', c_nationkey::VARCHAR FROM customer
  UNION SELECT 'orders', o_orderkey::VARCHAR, 'customer', o_custkey::VARCHAR FROM orders UNION SELECT 'lineitem', l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR, 'orders', l_orderkey::VARCHAR FROM lineitem),
p AS (SELECT 'region' AS t, r_regionkey::VARCHAR AS k, r_name = 'ASIA' AS gone FROM region UNION SELECT t, r, false FROM e),
d AS (SELECT e.t, e.r, CASE WHEN p.k IS NULL THEN 'missing' ELSE 'deleted' END AS kind FROM e LEFT JOIN p ON pt = p.t AND pk = p.k WHERE pk IS NOT NULL AND (p.k IS NULL OR gone)),
c AS (SELECT t, r, kind, 0 AS level FROM d UNION SELECT e.t, e.r, 'inherited', c.level + 1 FROM c JOIN e ON e.pt = c.t AND e.pk = c.r WHERE (e.t, e.r) NOT IN (SELECT (t, r) FROM d))
SELECT t AS table_name, kind, level, count(*) AS rows FROM c GROUP BY 1, 2, 3""",
    "p5_profile": _profile_sql(),
}
