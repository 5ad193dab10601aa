"""Top N items within every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(df: DataFrame, group: str, score: str, item: str, n: int = 8, salts: int = 32) -> DataFrame:
    """The ``n`` items with the greatest ``score`` in every ``group``: columns ``group, item, score, rank``.

    Of equal scores the smaller ``item`` comes first, so the result is always the same. Rows with
    the same group, item and score are one item (a repeated delivery). Rows whose group is NULL or
    whose score is NULL or NaN do not take part; a NULL item ranks behind all others of its score.
    A group with fewer than ``n`` items gives all it has; an empty table gives no rows. Other
    columns of ``df``, whatever their names, are not read.

    Stage one hashes the item into ``salts`` subgroups and keeps the ``n`` best of each, so a group
    of any size is ranked by many tasks; copies share a hash and meet there. Both rank filters are
    pushed below their shuffle as group limits, so a map task sends at most ``n`` score levels of
    each subgroup. Stage two ranks the at most ``n * salts`` survivors of a group.
    """
    rows = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).alias("s")).where(
        F.col("g").isNotNull() & F.col("s").isNotNull() & ~F.isnan(F.col("s").cast("double"))
    )
    by = [F.col("s").desc(), F.col("i").asc_nulls_last()]
    salted = rows.withColumn("t", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    sub = Window.partitionBy("g", "t").orderBy(*by)
    # Copies tie in dense_rank, so the limit counts items; lag then leaves one row of each.
    best = salted.withColumn("r", F.dense_rank().over(sub)).where(F.col("r") <= n)
    best = best.withColumn("r_before", F.lag("r").over(sub)).where("r_before IS NULL OR r_before <> r")
    final = best.select("g", "i", "s").withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*by)))
    return final.where(F.col("rank") <= n).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
