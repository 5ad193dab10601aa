"""Grouping crystals of alike unit cells, by Markov clustering of a condensed similarity graph."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from lumenframe.operators.positions import consecutive_pairs
from lumenframe.session import cut, written

#: Orders of the axes, each with the angles to turn into 180 degrees minus themselves: reversing one
#: axis turns the two angles it takes part in, so an even number of the three is turned.
VARIANTS = [(p, f) for p in permutations(range(3)) for f in product((False, True), repeat=3) if sum(f) % 2 == 0]
DIMS = ["e0", "e1", "e2", "g0", "g1", "g2"]
HALF_TURN = 180.0


@dataclass(frozen=True)
class CellRule:
    """Tolerances of two alike cells, and the parameters of the clustering: entries of a column within
    ``same`` of its largest are equals. Rounds, levels and splits beyond their bounds are errors."""

    edge: float = 0.05
    angle: float = 3.0
    inflation: float = 2.0
    prune: float = 1e-3
    settle: float = 1e-3
    same: float = 0.02
    max_rounds: int = 48
    max_levels: int = 16
    max_splits: int = 48

    @property
    def edge_unit(self) -> float:
        """Logarithm of the largest ratio of two alike edges: |a - b| <= edge * max(a, b)."""
        return -float(np.log1p(-self.edge))


def _turned(x: np.ndarray, order: Sequence[int], flips: Sequence[bool], half_turn: float) -> np.ndarray:
    out = np.concatenate([x[:, list(order)], x[:, [3 + k for k in order]]], axis=1)
    for k, f in enumerate(flips):
        if f:
            out[:, 3 + k] = half_turn - out[:, 3 + k]
    return out


def canonical(x: np.ndarray, half_turn: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the 24 settings of each cell, the one whose box comes first; and that box (floors)."""
    best = np.array(x, float)
    box = np.floor(best)
    for order, flips in VARIANTS[1:]:
        y = _turned(x, order, flips, half_turn)
        f = np.floor(y)
        less, same = np.zeros(len(x), bool), np.ones(len(x), bool)
        for d in range(6):
            less |= same & (f[:, d] < box[:, d])
            same &= f[:, d] == box[:, d]
        best[less], box[less] = y[less], f[less]
    return best, box


def compare_boxes(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, half_turn: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of boxes in units of the tolerance: surely alike throughout, possibly alike
    somewhere, and the distance of the centres in the best setting."""
    n = len(alo)
    sure, maybe, dist = np.zeros(n, bool), np.zeros(n, bool), np.full(n, np.inf)
    for order, flips in VARIANTS:
        p, q = _turned(blo, order, flips, half_turn), _turned(bhi, order, flips, half_turn)
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        far = np.maximum(ahi - lo, hi - alo).max(axis=1)
        near = np.maximum(lo - ahi, alo - hi).max(axis=1)
        sure |= far <= 1.0
        maybe |= near <= 1.0
        dist = np.minimum(dist, np.abs((alo + ahi) - (lo + hi)).max(axis=1) / 2)
    return sure, maybe, dist


def cell_members(df: DataFrame, item: str, cell: Sequence[str], rule: CellRule) -> DataFrame:
    """``item``, the canonical coordinates in units of the tolerances and the box of each usable cell."""
    kind = df.schema[item].dataType.simpleString()
    six = [f"c{k}" for k in range(6)]
    usable = F.col("item").isNotNull()
    for k, c in enumerate(six):
        v = F.col(c)
        usable = usable & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))) & ((v > 0) if k < 3 else (v != 0))
    rows = df.select(F.col(item).alias("item"), *[F.col(c).cast("double").alias(n) for c, n in zip(cell, six, strict=True)]).where(usable)
    # A record delivered more than once is one record; of differing deliveries the smallest cell counts.
    once = rows.groupBy("item").agg(F.min(F.struct(*six)).alias("c")).select("item", "c.*")
    unit, angle = rule.edge_unit, rule.angle

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[six].to_numpy(float)
            x[:, :3] = np.log(x[:, :3]) / unit
            x[:, 3:] /= angle
            best, box = canonical(x, HALF_TURN / angle)
            out = pd.DataFrame(best, columns=DIMS)
            out.insert(0, "item", b["item"].to_numpy())
            out["box"] = [",".join(map(str, r)) for r in box.astype(np.int64)]
            yield out

    return once.mapInPandas(kernel, f"item {kind}, " + ", ".join(f"{d} double" for d in DIMS) + ", box string")


def _bounds(members: DataFrame, *keys: str) -> DataFrame:
    return members.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), *[F.min(d).alias(f"{d}_lo") for d in DIMS], *[F.max(d).alias(f"{d}_hi") for d in DIMS])


def box_nodes(members: DataFrame, rule: CellRule) -> DataFrame:
    """One node per box: ``box, node`` (its smallest member), ``size``, bounds, and the bounds ``lo``
    and ``hi`` of the ascending edges and ascending deviations from a right angle, with the grid
    place ``q0, q1, q2`` of the edges. All of these survive a change of setting."""
    right = HALF_TURN / rule.angle / 2
    lo_e, hi_e = F.array_sort(F.array(*[F.min(f"e{k}") for k in range(3)])), F.array_sort(F.array(*[F.max(f"e{k}") for k in range(3)]))
    # A box that straddles the right angle starts at 0.
    dev_lo = F.array_sort(F.array(*[F.greatest(F.lit(0.0), F.min(f"g{k}") - right, right - F.max(f"g{k}")) for k in range(3)]))
    dev_hi = F.array_sort(F.array(*[F.greatest(F.abs(F.min(f"g{k}") - right), F.abs(F.max(f"g{k}") - right)) for k in range(3)]))
    bounds = [f(d).alias(f"{d}_{e}") for d in DIMS for e, f in (("lo", F.min), ("hi", F.max))]
    got = members.groupBy("box").agg(F.min("item").cast("long").alias("node"), F.count(F.lit(1)).alias("size"), F.concat(lo_e, dev_lo).alias("lo"), F.concat(hi_e, dev_hi).alias("hi"), *bounds)
    return got.select("*", *[F.floor((F.col("lo")[k] + F.col("hi")[k]) / 4).cast("long").alias(f"q{k}") for k in range(3)])


def _test(pairs: DataFrame, keep: Sequence[str], rule: CellRule) -> DataFrame:
    """``keep`` columns, ``sure``, ``maybe`` and ``dist`` of pairs with bounds ``a_…`` and ``b_…``."""
    names, half_turn = list(keep), HALF_TURN / rule.angle
    cols = [[f"{s}_{d}_{e}" for d in DIMS] for s in "ab" for e in ("lo", "hi")]
    schema = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in names) + ", sure boolean, maybe boolean, dist double"

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sure, maybe, dist = compare_boxes(*[b[c].to_numpy(float).reshape(len(b), 6) for c in cols], half_turn)
            yield b[names].assign(sure=sure, maybe=maybe, dist=dist)

    return pairs.select(*names, *[c for four in cols for c in four]).mapInPandas(kernel, schema)


def _side(nodes: DataFrame, s: str, key: str = "node") -> DataFrame:
    return nodes.select(F.col(key).alias(s), *[F.col(f"{d}_{e}").alias(f"{s}_{d}_{e}") for d in DIMS for e in ("lo", "hi")])


def box_links(members: DataFrame, nodes: DataFrame, rule: CellRule) -> DataFrame:
    """Pairs of boxes with at least one alike pair of members: ``a, b, dist`` with a < b. Exact.

    Boxes meet on a grid over their three edges in ascending order, which alike cells share up to
    the tolerance, and are pre-filtered by all six ascending numbers. Bounds decide nearly all
    pairs. A pair they leave open is settled by halving the boxes' members again and again, only
    for such pairs, until every sub-pair is surely alike or surely not.
    """
    sides = []
    for s in "ab":
        bounds = [F.col(f"{d}_{e}").alias(f"{s}_{d}_{e}") for d in DIMS for e in ("lo", "hi")]
        sides.append(nodes.select(F.col("node").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), "q0", "q1", "q2", *bounds))
    a, b = sides
    for k in range(3):
        a = a.withColumn(f"q{k}", F.explode(F.array(*[F.col(f"q{k}") + s for s in (-1, 0, 1)])))
    close = F.lit(True)
    for k in range(6):
        close = close & (F.col("a_lo")[k] <= F.col("b_hi")[k] + 1.000001) & (F.col("b_lo")[k] <= F.col("a_hi")[k] + 1.000001)
    tested = cut(_test(a.join(b, ["q0", "q1", "q2"]).where((F.col("a") < F.col("b")) & close), ["a", "b"], rule).where("maybe"))
    links = tested.where("sure").select("a", "b", "dist")
    open_pairs = tested.where("NOT sure").select("a", "b", "dist", F.col("a").cast("string").alias("pa"), F.col("b").cast("string").alias("pb"))
    if open_pairs.isEmpty():
        return links
    subs = members.withColumn("part", F.col("node").cast("string"))
    for level in range(1, rule.max_splits + 1):
        scale = float(2**level)
        parts = open_pairs.select(F.col("pa").alias("part")).unionByName(open_pairs.select(F.col("pb").alias("part"))).distinct()
        digits = [F.pmod(F.floor(F.col(d) * scale), F.lit(2)).cast("string") for d in DIMS]
        halved = cut(subs.join(parts, "part", "left_semi").withColumn("old", F.col("part")).withColumn("part", F.concat_ws("", F.col("old"), F.lit("."), *digits)))
        bounds = _bounds(halved, "old", "part")
        pa = _side(bounds, "a", "part").withColumnRenamed("a", "na").join(bounds.select(F.col("part").alias("na"), F.col("old").alias("pa")), "na")
        pb = _side(bounds, "b", "part").withColumnRenamed("b", "nb").join(bounds.select(F.col("part").alias("nb"), F.col("old").alias("pb")), "nb")
        pairs = open_pairs.join(pa, "pa").join(pb, "pb")
        got = cut(_test(pairs.withColumn("old_dist", F.col("dist")).drop("dist"), ["a", "b", "old_dist", "na", "nb"], rule).where("maybe"))
        found = cut(got.where("sure").groupBy("a", "b").agg(F.min("old_dist").alias("dist")))
        links = links.unionByName(found)
        open_pairs = cut(
            got.where("NOT sure").join(found.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", F.col("old_dist").alias("dist"), F.col("na").alias("pa"), F.col("nb").alias("pb"))
        )
        subs = halved.drop("old")
        if open_pairs.isEmpty():
            return links
    raise RuntimeError("boxes are still open after the last split")


def _stochastic(m: DataFrame, rule: CellRule, unrest: bool = False) -> DataFrame:
    """Columns to sum 1, entries below ``prune`` of their column's largest dropped first."""
    w = Window.partitionBy("j")
    kept = m.withColumn("top", F.max("v").over(w)).where(F.col("v") >= F.lit(rule.prune) * F.col("top"))
    out = kept.select("i", "j", "v", "top", F.sum("v").over(w).alias("total"), F.sum(F.col("v") * F.col("v")).over(w).alias("squares"))
    share = (F.col("v") / F.col("total")).alias("v")
    return out.select("i", "j", share, (F.col("top") / F.col("total") - F.col("squares") / (F.col("total") * F.col("total"))).alias("unrest")) if unrest else out.select("i", "j", share)


def _round(m: DataFrame, rule: CellRule) -> DataFrame:
    """The flow matrix squared, inflated, pruned and made stochastic again, with each column's unrest:
    its largest entry less the sum of squares, 0 once its entries are equal."""
    left, right = m.select("i", F.col("j").alias("k"), F.col("v").alias("v1")), m.select(F.col("i").alias("k"), "j", F.col("v").alias("v2"))
    squared = left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v1") * F.col("v2")).alias("v"))
    return _stochastic(squared.withColumn("v", F.pow("v", F.lit(rule.inflation))), rule, unrest=True)


def markov_clusters(nodes: DataFrame, links: DataFrame, rule: CellRule) -> DataFrame:
    """``node, size, attractor, flow``: Markov clustering of the linked nodes.

    The flow matrix is a table (i, j, v), v the flow from j to i, columns summing to 1. A node stands
    for ``size`` records, which lumps the matrix of all records exactly if its records have the same
    links. Squaring is a join of the table with itself on the inner index and a sum per (i, j);
    inflation and pruning follow per column. Every second round is a written table, and rounds end when no
    column is unrestful by more than ``settle``; that figure is observed while the round is written;
    it is an error if the last round has not settled. A column's attractor is its largest entry, of
    equals (which feed each other) the smallest node; ``flow`` is what a node receives from all
    records. Nodes without links attract themselves.

    No column grows with the records: boxes are of the tolerance's size, so a box has a bounded
    number of neighbours, and pruning bounds what squaring adds.
    """
    loops = nodes.select(F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("sim"))
    near = F.exp(-F.col("dist") * F.col("dist"))
    both = links.select(F.col("a").alias("i"), F.col("b").alias("j"), near.alias("sim")).unionByName(links.select(F.col("b").alias("i"), F.col("a").alias("j"), near.alias("sim")))
    linked = both.select(F.col("i").alias("node")).distinct()
    graph = both.unionByName(loops.join(linked, F.col("i") == F.col("node"), "left_semi"))
    sizes = nodes.select(F.col("node").alias("i"), "size")
    m = written(_stochastic(graph.join(sizes, "i").select("i", "j", (F.col("sim") * F.col("size")).alias("v")), rule))
    for turn in range(0, rule.max_rounds, 2):
        # Two rounds are one job: most rounds are small, and a job costs more than they do.
        seen = Observation(f"unrest_{turn}")
        fresh = _round(_round(m, rule).drop("unrest"), rule)
        m = written(fresh.observe(seen, F.max("unrest").alias("unrest"))).drop("unrest")
        if (seen.get["unrest"] or 0.0) <= rule.settle:
            break
    else:
        raise RuntimeError(f"the flow has not settled after {rule.max_rounds} rounds")
    top = m.groupBy("j").agg(F.max("v").alias("top"))
    attractor = m.join(top, "j").where(F.col("v") >= F.lit(1.0 - rule.same) * F.col("top")).groupBy("j").agg(F.min("i").alias("attractor")).withColumnRenamed("j", "node")
    flow = m.join(nodes.select(F.col("node").alias("j"), "size"), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("size")).alias("flow"))
    return nodes.select("node", "size").join(attractor, "node", "left").join(flow.withColumnRenamed("i", "node"), "node", "left").select(
        "node", "size", F.coalesce("attractor", "node").alias("attractor"), F.coalesce("flow", F.when(F.col("attractor").isNull(), F.col("size").cast("double")).otherwise(F.lit(0.0))).alias("flow")
    )


def closed_clusters(nodes: DataFrame, links: DataFrame, rule: CellRule) -> DataFrame:
    """``node, size, attractor, flow, cluster``: Markov clusters that no link crosses.

    A flow may be cut inside a chain, but likeness passes through others. So clusters that a link
    crosses become the nodes of a contracted graph, on which the Markov rounds run again, with an
    inflation nearer to 1 each time (which gives coarser clusters), until no link crosses. A cluster
    is named by the last attractor on its way. If crossing links are left after ``max_levels``, that
    is an error: nothing but the flow joins two nodes.
    """
    flows = written(markov_clusters(nodes, links, rule))
    label = flows.select("node", F.col("attractor").alias("cluster"))
    for level in range(1, rule.max_levels + 1):
        ends = links.select("a", "b").join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la <> lb")
        across = written(ends.select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct())
        if across.isEmpty():
            return flows.join(label, "node")
        ones = across.select(F.col("a").alias("node")).unionByName(across.select(F.col("b").alias("node"))).distinct().withColumn("size", F.lit(1).cast("long"))
        coarse = replace(rule, inflation=1.0 + (rule.inflation - 1.0) / 2**level)
        merged = markov_clusters(ones, across.withColumn("dist", F.lit(0.0)), coarse).select(F.col("node").alias("cluster"), F.col("attractor").alias("joined"))
        label = written(label.join(merged, "cluster", "left").select("node", F.coalesce("joined", "cluster").alias("cluster")))
    raise RuntimeError(f"links still cross clusters after {rule.max_levels} levels")


@dataclass(frozen=True)
class Groups:
    """``members``: ``item, node, cluster, …coordinates``. ``nodes``: ``node, size, attractor, flow, cluster``."""

    members: DataFrame
    nodes: DataFrame


def cell_groups(df: DataFrame, item: str, cell: Sequence[str], rule: CellRule = CellRule()) -> Groups:
    """Groups of records whose unit cells are alike directly or through others.

    ``cell`` names the three edges and the angles opposite them; ``item`` must be a whole number.
    Two cells are alike if edges agree within ``edge`` of the larger and angles within ``angle``
    degrees, in some order of the axes and after reversing axes. Records with a NULL id, or with a
    NULL, NaN, infinite or zero number or a negative edge, do not take part. Repeated ids are one
    record. An empty table gives no groups.

    Each cell is turned into the setting whose box (of the tolerance's size) comes first. All cells
    of a box are alike, so boxes, not records, are the nodes of the similarity graph: their number
    grows with the variety of cells, and a group that holds a third of all records is a few dozen
    nodes. Markov clustering groups the nodes, on contracted graphs again until no link crosses
    (``closed_clusters``).
    """
    boxed = cut(cell_members(df, item, cell, rule))
    nodes = cut(box_nodes(boxed, rule))
    members = boxed.join(nodes.select("box", "node"), "box").drop("box")
    links = cut(box_links(members, nodes, rule))
    grouped = written(closed_clusters(nodes, links, rule))
    return Groups(members.join(grouped.select("node", "cluster"), "node"), grouped)


def group_pairs(groups: Groups) -> DataFrame:
    """``cluster, a, b``: members of a group that follow each other in order of their ids."""
    return consecutive_pairs(groups.members, "cluster", "item")


def describe_groups(groups: Groups, typical: int = 3) -> DataFrame:
    """``cluster, size, boxes, typical``: the members nearest the middle of the box with the strongest flow."""
    per = groups.nodes.groupBy("cluster").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("boxes"), F.max(F.struct("flow", "size", (-F.col("node")).alias("neg"))).alias("best"))
    per = per.select("cluster", "size", "boxes", (-F.col("best.neg")).alias("node"))
    inside = groups.members.drop("cluster").join(per.select("node", "cluster"), "node")
    middle = inside.groupBy("cluster").agg(*[F.avg(d).alias(f"{d}_mid") for d in DIMS])
    off = F.round(F.greatest(*[F.abs(F.col(d) - F.col(f"{d}_mid")) for d in DIMS]), 9)
    near = inside.join(middle, "cluster").select("cluster", "item", off.alias("off"))
    # The nearest members by salted minima: no window over a whole group.
    salted = Window.partitionBy("cluster", F.pmod(F.xxhash64("item"), F.lit(32))).orderBy("off", "item")
    few = near.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= typical)
    top = few.withColumn("r", F.row_number().over(Window.partitionBy("cluster").orderBy("off", "item"))).where(F.col("r") <= typical)
    names = top.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "item"))), lambda x: x["item"]).alias("typical"))
    return per.drop("node").join(names, "cluster")
