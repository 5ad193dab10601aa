"""Mixing sources to target weights, by a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.operators.positions import dense_positions, slice_offsets
from lumenframe.session import cut


@dataclass(frozen=True)
class MixRule:
    """``block``: uses drawn together, at least. ``slice_rows``: rows of a source numbered in one slice. ``shard_size``: size of an output shard. ``total``: wanted total
    size, or None for the largest at which every source with records still holds its share."""

    block: int = 16
    shard_size: int = 1_000_000
    total: int | None = None
    seed: int = 20240229
    slice_rows: int = 1 << 16
    most_sources: int = 10_000


def split_blocks(blocks: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First permuted block and number of blocks of each source in one shard.

    The tree halves the range of shards; a node's blocks are split between its halves by one
    multivariate hypergeometric draw seeded by the node. So every shard finds its quotas by itself,
    walking down from the root, and all shards together use every block exactly once.
    """
    lo, hi, have, first = 0, shards, blocks.astype(np.int64), np.zeros(len(blocks), np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        total = int(have.sum())
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(have, total * (mid - lo) // (hi - lo), method="marginals")
        if shard < mid:
            hi, have = mid, left
        else:
            lo, first, have = mid, first + left, have - left
    return first, have


#: Blocks in all that a split draws from; below what numpy's sampler takes (a thousand million).
MOST_BLOCKS = 1 << 28


def block_size(uses: int, rule: MixRule) -> int:
    """Uses in a block: ``rule.block``, or more where there would be too many blocks to split."""
    return max(rule.block, -(-uses // MOST_BLOCKS))


def permuted_blocks(spark: SparkSession, names: list[str], blocks: np.ndarray, rule: MixRule) -> DataFrame:
    """``s, block, permuted``: a random permutation of the blocks of each source, by the order of their
    hashes, numbered in slices of hashes."""
    ends = np.cumsum(blocks)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = b["id"].to_numpy()
            k = np.searchsorted(ends, at, "right")
            yield pd.DataFrame({"s": np.array(names, dtype=object)[k], "block": at - (ends - blocks)[k]})

    listed = spark.range(int(ends[-1]) if len(ends) else 0).mapInPandas(kernel, "s string, block long")
    hashed = listed.withColumn("h", F.xxhash64(F.lit(rule.seed + 2), "s", "block"))
    slices = max(16, -(-int(blocks.max(initial=0)) // rule.slice_rows))
    return dense_positions(hashed, ["s"], F.pmod("h", F.lit(slices)), [F.col("h"), F.col("block")], "permuted").drop("h")


def folded_source(c: Column) -> Column:
    return F.lower(F.trim(c.cast("string")))


@dataclass(frozen=True)
class Mix:
    """``draws``: one row per use (shard, position, item, source, use, size). ``uses``: one row per
    record (item, source, size, uses). ``shares``: one row per target source."""

    draws: DataFrame
    uses: DataFrame
    shares: DataFrame


def mix_sources(
    records: DataFrame, item: str, source: str, size: str, targets: DataFrame, t_source: str = "source", t_share: str = "target_share", t_repeats: str = "max_repeats", rule: MixRule = MixRule()
) -> Mix:
    """Draw the records of each source so that the source holds its share of the total size.

    Sources are compared ignoring case and outer blanks. A record is used ``floor(quota / available)``
    times or once more, never more than its source's ``max_repeats``; the one more goes to the
    records first in a hashed order, up to the one with which the quota is met as nearly as whole
    records allow. Records without size (NULL, 0 or less), of no listed source or of a NULL source
    are used 0 times. A listed source without sized records cannot hold its share: the shares of the
    others are raised in proportion, and its row shows an actual share of 0. Targets with a NULL
    source or a share not above 0 ask for nothing; of repeated targets the shares add up and the
    smallest ``max_repeats`` holds. If the wanted total is more than a source allows, the source
    gives what it can. Empty tables give empty draws. Other columns are not read.

    The uses of a source follow each other pass by pass, in blocks; the blocks are permuted at random, the
    splitting tree gives each shard its exact quota of blocks of every source, and inside a shard
    (of bounded size) the uses are shuffled by hash. Per source only counts and sums are gathered,
    in hash slices, so one source may hold any share of the records.
    """
    spark = records.sparkSession
    wanted = (
        targets.select(folded_source(F.col(t_source)).alias("s"), F.col(t_share).cast("double").alias("share"), F.col(t_repeats).cast("long").alias("most"))
        .where("s IS NOT NULL")
        .groupBy("s")
        .agg(F.sum(F.when(F.col("share") > 0, F.col("share"))).alias("share"), F.greatest(F.coalesce(F.min("most"), F.lit(1)), F.lit(0)).alias("most"))
    )
    goal = {r["s"]: (r["share"] or 0.0, r["most"]) for r in wanted.limit(rule.most_sources + 1).collect()}
    if len(goal) > rule.most_sources:
        raise ValueError(f"more than {rule.most_sources} target sources")
    rows = cut(records.select(F.col(item).alias("i"), folded_source(F.col(source)).alias("s"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("n")))
    names = list(goal)
    sized = rows.where(F.col("s").isin(names) & (F.col("n") > 0)) if names else rows.limit(0)
    have = {r["s"]: (r["n"], r["c"]) for r in sized.groupBy("s").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("c")).collect()}
    able = {s for s in names if goal[s][0] > 0 and goal[s][1] > 0 and s in have}
    weight = sum(goal[s][0] for s in able)
    share = {s: goal[s][0] / weight for s in able}
    limit = min((have[s][0] * goal[s][1] / share[s] for s in able), default=0.0)
    total = limit if rule.total is None else float(rule.total)
    quota = {s: min(share[s] * total, have[s][0] * goal[s][1]) for s in able}
    passes = {s: min(goal[s][1], int(quota[s] // have[s][0])) for s in able}
    rest = {s: quota[s] - passes[s] * have[s][0] if passes[s] < goal[s][1] else -1.0 for s in able}

    # The hashed order of a source: by slice, then by hash and id.
    h = F.xxhash64(F.lit(rule.seed), F.col("i"))
    slices = max(16, -(-max((c for _, c in have.values()), default=0) // rule.slice_rows))
    hashed = sized.withColumn("h", h).withColumn("slice", F.pmod("h", F.lit(slices)))
    w = Window.partitionBy("s", "slice").orderBy("h", "i")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    local = hashed.withColumn("rn", F.row_number().over(w).cast("long")).withColumn("sum_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    counts = slice_offsets(hashed, ["s"], "slice", out="count_offset")
    sums = slice_offsets(hashed, ["s"], "slice", F.col("n"), out="sum_offset")
    facts = [(s, int(passes[s]), float(rest[s]), int(have[s][1])) for s in able]
    per_source = spark.createDataFrame(facts, "s string, passes long, rest double, c long")  # at most most_sources rows
    placed = (
        local.join(counts, ["s", "slice"])
        .join(sums, ["s", "slice"])
        .join(F.broadcast(per_source), "s")
        .select("i", "s", "n", "c", "passes", (F.col("rn") - 1 + F.col("count_offset")).alias("p"), (F.col("sum_before") + F.col("sum_offset") + F.col("n") / 2 <= F.col("rest")).alias("more"))
        .withColumn("uses", F.col("passes") + F.col("more").cast("long"))
    )
    placed = cut(placed.where("uses > 0").select("i", "s", "n", "c", "p", "uses"))
    used = {r["s"]: (r["u"], r["n"], r["k"]) for r in placed.groupBy("s").agg(F.sum("uses").alias("u"), F.sum(F.col("uses") * F.col("n")).alias("n"), F.max("uses").alias("k")).collect()}

    order = sorted(used)
    block = block_size(sum(used[s][0] for s in order), rule)
    blocks = np.array([-(-used[s][0] // block) for s in order], np.int64)
    shards = max(1, -(-int(sum(used[s][1] for s in order)) // rule.shard_size))
    seed = rule.seed

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for shard in b["id"]:
                first, n = split_blocks(blocks, shards, int(shard), seed)
                out += [(int(shard), s, int(f), int(f + k)) for s, f, k in zip(order, first, n, strict=True) if k]
            yield pd.DataFrame(out, columns=["shard", "s", "first", "beyond"])

    quotas = spark.range(shards).mapInPandas(kernel, "shard long, s string, first long, beyond long")
    owner = quotas.select("shard", "s", F.explode(F.sequence("first", F.col("beyond") - 1)).alias("permuted"))
    home = permuted_blocks(spark, order, blocks, rule).join(owner, ["s", "permuted"]).drop("permuted")
    draws = (
        placed.withColumn("use", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
        .withColumn("block", F.floor((F.col("use") * F.col("c") + F.col("p")) / F.lit(block)))
        .join(home, ["s", "block"], "inner")
    )
    local_order = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "i", "use"), "i", "use")
    draws = draws.select("shard", (F.row_number().over(local_order) - 1).alias("position"), F.col("i").alias(item), F.col("s").alias("source"), F.col("use").cast("int").alias("use"), F.col("n").alias("size"))

    none = F.lit(0).cast("long")
    unused = rows.select("i", "s", "n", none.alias("uses"))
    taken = placed.select("i", "s", "n", "uses")
    # Records of one id, source and size share a hash and so an order; the sum keeps one row for each.
    uses = taken.unionByName(unused).groupBy("i", "s", "n").agg(F.sum("uses").alias("uses"))
    uses = uses.select(F.col("i").alias(item), F.col("s").alias("source"), F.col("n").alias("size"), "uses")
    grand = float(sum(used[s][1] for s in order)) or 1.0
    report = [
        (s, float(goal[s][0]), int(goal[s][1]), float(share.get(s, 0.0)), int(have.get(s, (0, 0))[1]), int(have.get(s, (0, 0))[0]), int(used.get(s, (0, 0, 0))[1]), int(used.get(s, (0, 0, 0))[2]), used.get(s, (0, 0, 0))[1] / grand)
        for s in sorted(goal)
    ]
    shares = spark.createDataFrame(report, "source string, target_share double, max_repeats long, reachable_share double, records long, available long, used long, most_uses long, actual_share double")
    return Mix(draws, uses, shares)
