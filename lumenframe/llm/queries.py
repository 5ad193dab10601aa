"""Registered queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.clusters import VARIANTS, Groups, cell_groups, describe_groups, group_pairs
from lumenframe.llm.mixing import Mix, mix_sources
from lumenframe.llm.packing import pack
from lumenframe.llm.quantiles import percentiles, ranks_within
from lumenframe.llm.repetition import repetition
from lumenframe.llm.tokens import token_counts
from lumenframe.llm.topn import top_n_per_group
from lumenframe.session import cut, table

CAPACITY = 2048
CELL = ["cell_a_a", "cell_b_a", "cell_c_a", "cell_alpha_deg", "cell_beta_deg", "cell_gamma_deg"]
PROBS = [0.05, 0.25, 0.5, 0.75, 0.95, 0.99]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n_per_group(table(spark, d, "peaks"), "frame_index", "intensity", "peak_id", 8).select("frame_index", "peak_id")


def p1_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The three strongest reflections of each panel, with their ranks."""
    r = table(spark, d, "reflections").withColumn("panel_name", F.lower(F.trim("panel")))
    return top_n_per_group(r, "panel_name", "intensity", "reflection_id", 3)


def _groups(spark: SparkSession, d: str) -> Groups:
    return cell_groups(table(spark, d, "frames").where("indexed"), "frame_index", CELL)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return group_pairs(_groups(spark, d)).select(F.col("a").alias("frame_index_a"), F.col("b").alias("frame_index_b"))


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical frames of every group, strays included."""
    return describe_groups(_groups(spark, d))


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """How many groups there are of each size, and whether the typical frames are members of their own."""
    groups = _groups(spark, d)
    told = cut(describe_groups(groups))
    named = told.select("cluster", F.explode("typical").alias("item")).join(groups.members.select("item", F.col("cluster").alias("home")), "item")
    inside = named.groupBy("cluster").agg(F.every(F.col("home") == F.col("cluster")).alias("inside"), F.count(F.lit(1)).alias("n"))
    right = F.col("inside") & F.col("n").between(1, 3)
    return told.join(inside, "cluster").groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.every(right).alias("typical_inside"))


EPS = 0.005


def _intensities(spark: SparkSession, d: str) -> DataFrame:
    """Intensities by panel and whole nm^-1 of resolution (NULL where it is missing or negative)."""
    band = F.when(F.col("resolution_nm_inv") >= 0, F.floor("resolution_nm_inv").cast("int"))
    return table(spark, d, "reflections").select("load_id", F.lower(F.trim("panel")).alias("panel"), band.alias("band"), "intensity")


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    return percentiles(_intensities(spark, d), ["panel", "band"], "intensity", PROBS, load="load_id", eps=EPS)


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per load, panel and band, and per panel and band over all loads, combined from those of the loads."""
    names = [F.col("p")[k].alias(f"p{round(100 * p):02d}") for k, p in enumerate(PROBS)]
    bound = F.col("rank_error") <= F.ceil(F.col("n") * EPS)
    return _percentiles(spark, d).select("scope", "load_id", "panel", "band", "n", *names, "rank_error", bound.alias("within_bound"))


def p4_loads(spark: SparkSession, d: str) -> DataFrame:
    """What each load holds and how far its percentiles can be off."""
    got = _percentiles(spark, d)
    return got.groupBy("scope", "load_id").agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("values"), F.every(F.col("rank_error") <= F.ceil(F.col("n") * EPS)).alias("within_bound"))


def p4_ranks(spark: SparkSession, d: str) -> DataFrame:
    """The exact ranks of all percentiles of ``p4_percentiles`` against their stated errors."""
    rows, found = _intensities(spark, d), _percentiles(spark, d)
    loads = ranks_within(rows, ["load_id", "panel", "band"], "intensity", found.where("scope = 'load'"), PROBS)
    whole = ranks_within(rows, ["panel", "band"], "intensity", found.where("scope = 'all'"), PROBS)
    return loads.select(F.lit("load").alias("scope"), "*").unionByName(whole.select(F.lit("all").alias("scope"), F.lit(None).cast("int").alias("load_id"), "*"))


def _tokens(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"), ["doc_id", *keep], "text")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack(_tokens(spark, d), "doc_id", "tokens", CAPACITY)


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text is packed whole, no container overflows, and the containers are within 1 % of the
    least number that could do."""
    sizes, placed = cut(_tokens(spark, d)), cut(p7_containers(spark, d))
    per = placed.where("container IS NOT NULL").groupBy("container").agg(F.sum("tokens").alias("t"))
    full = per.agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("t"), F.max("t").alias("top"))
    packed = placed.groupBy("doc_id").agg(F.sum("tokens").alias("got"), F.count(F.lit(1)).alias("pieces"), F.countDistinct("piece").alias("distinct"))
    whole = sizes.join(packed, "doc_id", "left").agg(
        F.count(F.lit(1)).alias("texts"), F.every((F.col("got") == F.col("tokens")) & (F.col("pieces") == F.col("distinct")) & ((F.col("tokens") > CAPACITY) | (F.col("pieces") == 1))).alias("each_whole")
    )
    fits, few = (F.col("top") <= CAPACITY).alias("none_overflows"), (F.col("n") <= F.ceil(F.col("t") / CAPACITY) * 1.01 + 1).alias("few_containers")
    return whole.join(full).select("texts", "each_whole", fits, few)  # one row each


def _mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(_tokens(spark, d, "source"), "doc_id", "source", "tokens", table(spark, d, "mix_targets"))


def p8_draws(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).draws


def p8_uses(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).uses


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: whether no text is used too often, the draws are the uses, and the share is met
    to within one text."""
    m = _mix(spark, d)
    draws, uses, shares = cut(m.draws), cut(m.uses), m.shares
    drawn = draws.groupBy("doc_id", "use").agg(F.count(F.lit(1)).alias("k")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("drawn"), F.max("k").alias("k"))
    per = uses.join(drawn, "doc_id", "left").groupBy("source").agg(F.max("uses").alias("top"), F.max("size").alias("largest"), F.every((F.coalesce("drawn", F.lit(0)) == F.col("uses")) & (F.coalesce("k", F.lit(1)) == 1)).alias("draws_are_uses"))
    total = shares.agg(F.sum("used").alias("total"))
    off = F.abs(F.col("actual_share") - F.col("reachable_share")) * F.col("total")
    got = shares.join(per, "source", "left").join(total)  # one row beside a row per target
    return got.select(
        "source", "target_share", "max_repeats", F.round("reachable_share", 6).alias("reachable_share"), "records", (F.coalesce("top", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        F.coalesce("draws_are_uses", F.lit(True)).alias("draws_are_uses"), (off <= F.coalesce("largest", F.lit(0)) + 1).alias("on_target"),
    )


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition(table(spark, d, "documents"), "doc_id", "text").where("high").select("doc_id").distinct()


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Words and repeated words of every text."""
    got = repetition(table(spark, d, "documents"), "doc_id", "text", measure_all=True)
    return got.select("doc_id", F.col("words").cast("long").alias("words"), F.col("repeated").cast("long").alias("repeated"), "high")


_WORDS = """words AS (SELECT doc_id, coalesce(regexp_extract_all(lower(text), '\\p{L}+'), []) AS w FROM documents),
grams AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 2)) AS i FROM words WHERE len(w) >= 4)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(i) OVER (PARTITION BY doc_id, g) AS f FROM grams) WHERE i > f),
hit AS (SELECT doc_id, count(DISTINCT i + k) AS repeated FROM again, (SELECT unnest(range(0, 4)) AS k) GROUP BY 1),
shares AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS words, coalesce(repeated, 0) AS repeated FROM words LEFT JOIN hit USING (doc_id)),
judged AS (SELECT *, words >= 20 AND repeated >= words * 0.3 - 1e-9 AS high FROM shares)"""

def _alike_sql() -> str:
    """Groups of alike cells: all 24 settings, all pairs, transitive closure."""
    settings = " UNION ALL ".join(
        "SELECT f, " + ", ".join([*(f"{'abc'[o]} AS e{k}" for k, o in enumerate(order)), *(f"{'180 - ' if t else ''}{('al', 'be', 'ga')[o]} AS g{k}" for k, (o, t) in enumerate(zip(order, flips, strict=True)))]) + " FROM c"
        for order, flips in VARIANTS
    )
    numbers = ", ".join(f"{c} AS {n}" for c, n in zip(CELL, ("a", "b", "c", "al", "be", "ga"), strict=True))
    usable = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND {c} <> 0" for c in CELL)
    edges = " AND ".join(f"abs(x.{c} - y.e{k}) <= 0.05 * greatest(x.{c}, y.e{k})" for k, c in enumerate("abc"))
    angles = " AND ".join(f"abs(x.{c} - y.g{k}) <= 3" for k, c in enumerate(("al", "be", "ga")))
    return f"""RECURSIVE c AS (SELECT DISTINCT frame_index AS f, {numbers} FROM frames WHERE indexed AND {usable}),
settings AS ({settings}),
alike AS (SELECT DISTINCT x.f AS p, y.f AS q FROM c x JOIN settings y ON {edges} AND {angles}),
reach AS (SELECT p, q FROM alike UNION SELECT r.p, a.q FROM reach r JOIN alike a ON r.q = a.p),
label AS (SELECT p, min(q) AS g FROM reach GROUP BY p)"""


_BANDS = """rf AS (SELECT load_id, lower(trim(panel)) AS panel, CASE WHEN resolution_nm_inv >= 0 THEN floor(resolution_nm_inv)::INTEGER END AS band FROM reflections
  WHERE intensity IS NOT NULL AND NOT isnan(intensity)),
gr AS (SELECT 'load' AS scope, load_id, panel, band, count(*) AS n FROM rf GROUP BY 2, 3, 4 UNION ALL SELECT 'all', NULL, panel, band, count(*) FROM rf GROUP BY 3, 4)"""

QUERIES = {f.__name__: f for f in (p1_found, p1_ranked, p3_found, p3_clusters, p3_sizes, p4_percentiles, p4_loads, p4_ranks, p7_containers, p7_fill, p8_draws, p8_uses, p8_shares, p8_checks, p9_found, p9_shares)}

ORACLE = {
    "p1_found": """SELECT frame_index, peak_id FROM (
  SELECT frame_index, peak_id, row_number() OVER (PARTITION BY frame_index ORDER BY intensity DESC, peak_id) AS r
  FROM (SELECT DISTINCT frame_index, peak_id, intensity FROM peaks
    WHERE frame_index IS NOT NULL AND intensity IS NOT NULL AND NOT isnan(intensity))) WHERE r <= 8""",
    "p1_ranked": """SELECT * FROM (
  SELECT panel_name, reflection_id, intensity, CAST(row_number() OVER (PARTITION BY panel_name ORDER BY intensity DESC, reflection_id) AS INTEGER) AS rank
  FROM (SELECT DISTINCT lower(trim(panel)) AS panel_name, reflection_id, intensity FROM reflections
    WHERE panel IS NOT NULL AND intensity IS NOT NULL AND NOT isnan(intensity))) WHERE rank <= 3""",
    "p3_found": f"""WITH {_alike_sql()} SELECT a AS frame_index_a, p AS frame_index_b FROM (
  SELECT p, lag(p) OVER (PARTITION BY g ORDER BY p) AS a FROM label) WHERE a IS NOT NULL""",
    "p3_sizes": f"WITH {_alike_sql()} SELECT size, count(*) AS groups, true AS typical_inside FROM (SELECT count(*) AS size FROM label GROUP BY g) GROUP BY size",
    "p4_loads": f"WITH {_BANDS} SELECT scope, load_id, count(*) AS groups, CAST(sum(n) AS BIGINT) AS values, true AS within_bound FROM gr GROUP BY 1, 2",
    "p4_ranks": f"WITH {_BANDS} SELECT scope, load_id, panel, band, unnest({PROBS}::DOUBLE[]) AS prob, n, true AS within FROM gr",
    "p7_fill": "SELECT count(*) AS texts, true AS each_whole, true AS none_overflows, true AS few_containers FROM documents",
    "p8_checks": """WITH t AS (SELECT lower(trim(source)) AS source, sum(target_share) AS target_share, min(max_repeats)::BIGINT AS max_repeats FROM mix_targets WHERE source IS NOT NULL GROUP BY 1),
h AS (SELECT lower(trim(source)) AS source, count(*) AS records FROM documents WHERE length(text) > 0 GROUP BY 1),
b AS (SELECT t.*, coalesce(records, 0) AS records FROM t LEFT JOIN h USING (source))
SELECT source, target_share, max_repeats, round(CASE WHEN records > 0 THEN target_share / sum(target_share) FILTER (WHERE records > 0) OVER () ELSE 0.0 END, 6) AS reachable_share, records,
  true AS within_repeats, true AS draws_are_uses, true AS on_target FROM b""",
    "p9_found": f"WITH {_WORDS} SELECT doc_id FROM judged WHERE high",
    "p9_shares": f"WITH {_WORDS} SELECT doc_id, words, repeated, high FROM judged",
}
