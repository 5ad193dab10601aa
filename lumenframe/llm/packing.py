"""Filling containers of fixed capacity, by minimum bin slack over the histogram of lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.operators.positions import dense_positions
from lumenframe.session import cut

#: Rows of the plan up to which it is broadcast (a plan row is 40 bytes).
BROADCAST_ROWS = 200_000


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within ``counts``, whose sum is closest to ``room`` from below.

    Subset sums are the bits of one integer; a length that is there m times is added as blocks of
    1, 2, 4, … copies. Longer lengths go first and the search stops once ``room`` itself is reached.
    The bits before each block are kept, so the copies used are read off backwards.
    """
    reach, mask = 1, (1 << (room + 1)) - 1
    steps = []
    for length in sorted((x for x, c in counts.items() if c and x <= room), reverse=True):
        left, block = min(counts[length], room // length), 1
        while left > 0:
            take = min(block, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            block *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Bin patterns and how often each is repeated, until every length is used up.

    Each pattern holds the longest remaining length and the fill of least slack beside it, and is
    repeated as often as the remaining counts allow; so a repetition costs nothing, and the number
    of patterns depends on the capacity, not on the number of items.
    """
    left = {x: c for x, c in histogram.items() if c > 0}
    plan = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        pattern = best_fill(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[x] // c for x, c in pattern.items())
        plan.append((pattern, times))
        for x, c in pattern.items():
            left[x] -= c * times
            if not left[x]:
                del left[x]
    return plan


def pack(items: DataFrame, item: str, size: str, capacity: int, slice_rows: int = 1 << 16) -> DataFrame:
    """The container of each item: ``item, piece, size, container``.

    An item of at most ``capacity`` is one piece (piece 0). A longer one is split into full pieces
    of ``capacity``, each with a container of its own, and a last piece with the rest. No container
    holds more than ``capacity``. Items whose size is NULL or not above 0 take no room: one row with
    size 0 and a NULL container. Ties are resolved by item id, so the result is always the same.
    Repeated ids are items of their own; an empty table gives no rows; other columns are not read.

    Only the histogram of lengths, at most ``capacity`` rows, reaches the driver; the plan has a row
    per pattern and length. Items of one length are numbered in hash slices of about ``slice_rows``, so
    a length that a third of all items share is spread as well.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = items.sparkSession
    c = F.lit(capacity).cast("long")
    rows = items.select(F.col(item).alias("i"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n"))
    empty = rows.where("n <= 0").select("i", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("container"))
    sized = cut(rows.where("n > 0"))  # sizes are costly to find: they are read three times below
    whole = sized.where(F.col("n") > c)
    full = whole.select("i", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n") / c) - 1).cast("int"))).alias("piece"), c.alias("n"))
    part = sized.select(
        "i", F.when(F.col("n") > c, F.floor(F.col("n") / c)).otherwise(0).cast("int").alias("piece"), F.when(F.col("n") > c, F.col("n") % c).otherwise(F.col("n")).alias("n")
    ).where("n > 0")
    histogram = {r["n"]: r["c"] for r in part.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    slices = max(16, -(-max(histogram.values(), default=0) // slice_rows))
    slots, base, taken = [], 0, {}
    for pattern, times in plan_bins(histogram, capacity):
        for length, need in sorted(pattern.items()):
            start = taken.get(length, 0)
            slots.append((length, start, start + need * times, need, base))
            taken[length] = start + need * times
        base += times
    plan = spark.createDataFrame(slots, "n long, first long, beyond long, need long, base long")
    at = dense_positions(part, ["n"], F.pmod(F.xxhash64("i"), F.lit(slices)), [F.col("i"), F.col("piece")])
    plan = F.broadcast(plan) if len(slots) <= BROADCAST_ROWS else plan
    placed = at.join(plan, "n", "inner").where("pos >= first AND pos < beyond").select(
        "i", "piece", "n", (F.col("base") + F.floor((F.col("pos") - F.col("first")) / F.col("need"))).cast("long").alias("container")
    )
    many = max(16, -(-(full.agg(F.count(F.lit(1))).first()[0]) // slice_rows))
    alone = dense_positions(full.withColumn("one", F.lit(0)), ["one"], F.pmod(F.xxhash64("i"), F.lit(many)), [F.col("i"), F.col("piece")])
    alone = alone.select("i", "piece", "n", (F.col("pos") + F.lit(base)).alias("container"))
    out = placed.unionByName(alone).unionByName(empty)
    return out.select(F.col("i").alias(item), "piece", F.col("n").alias(size), "container")
