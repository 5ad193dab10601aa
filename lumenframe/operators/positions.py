"""Dense positions and consecutive pairs inside groups, without one task per group.

A window over a whole group puts a group that holds a third of the table into one task. Both
operators here sort only (group, bucket) slices; a table with one row per slice carries the
offsets from slice to slice.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_offsets(
    df: DataFrame, group: Sequence[str], bucket: str, weight: Column | None = None, out: str = "slice_offset"
) -> DataFrame:
    """Per (group, bucket): the number of rows (or the sum of ``weight``) in earlier buckets of the group."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    per = df.groupBy(*group, bucket).agg(size.alias("__size"))
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*group, bucket, F.coalesce(F.sum("__size").over(w), F.lit(0)).alias(out))


def dense_positions(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    out: str = "pos",
) -> DataFrame:
    """Number the rows of each group 0, 1, 2, … in (bucket, order) order as column ``out``.

    ``bucket`` must not decrease along the wanted order (an integer division of the leading order
    column), or be a hash, in which case the order is "by bucket, then by ``order``". Group columns
    must not be NULL (code such values first); a NULL bucket counts as -1. An empty table gives an
    empty table.
    """
    b = df.withColumn("__bucket", F.coalesce(bucket.cast("long"), F.lit(-1).cast("long")))
    keys = [*group, "__bucket"]
    off = slice_offsets(b, group, "__bucket", out="__offset")
    w = Window.partitionBy(*keys).orderBy(*order)
    numbered = b.withColumn("__rn", F.row_number().over(w).cast("long"))
    return numbered.join(off, keys, "inner").select(*df.columns, (F.col("__rn") - 1 + F.col("__offset")).cast("long").alias(out))


def consecutive_pairs(df: DataFrame, group: str, key: str, width: int = 1 << 16) -> DataFrame:
    """Pairs (previous ``key``, ``key``) of distinct keys that follow each other inside a group.

    Rows: ``group``, ``a``, ``b`` with a < b. Repeated keys count once. Slices of ``width`` key
    values are sorted apart; the first and last key of each slice are linked in a second, small
    window, so a group of any size is spread over many tasks.
    """
    b = df.select(F.col(group).alias("g"), F.col(key).alias("k")).where("k IS NOT NULL AND g IS NOT NULL")
    b = b.withColumn("s", F.floor(F.col("k") / F.lit(width)))
    w = Window.partitionBy("g", "s").orderBy("k")
    inner = b.withColumn("p", F.lag("k").over(w)).where("p IS NOT NULL AND p <> k").select("g", F.col("p").alias("a"), F.col("k").alias("b"))
    ends = b.groupBy("g", "s").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    across = (
        ends.withColumn("p", F.lag("hi").over(Window.partitionBy("g").orderBy("s")))
        .where("p IS NOT NULL")
        .select("g", F.col("p").alias("a"), F.col("lo").alias("b"))
    )
    return inner.unionByName(across).withColumnRenamed("g", group)
