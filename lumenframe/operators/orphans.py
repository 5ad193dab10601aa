"""References to records that do not exist, by a fixpoint cascade over the foreign-key graph."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut


@dataclass(frozen=True)
class Entity:
    """A table of the graph. ``row``: the column that names a row in the report. ``removed``: a
    column that is not NULL on withdrawn rows. ``arrived``: when a row came in. ``period``: the
    column by which orphans are counted."""

    df: DataFrame
    row: str
    removed: str | None = None
    arrived: str | None = None
    period: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` refers to ``parent.key``."""

    child: str
    column: str
    parent: str
    key: str

    @property
    def name(self) -> str:
        return f"{self.child}.{self.column}->{self.parent}.{self.key}"


def folded(c: Column) -> Column:
    """Keys compared ignoring case and outer blanks."""
    return F.lower(F.trim(c.cast("string")))


def _rows(e: Entity, key: Column) -> DataFrame:
    null_ts, null_s = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("string")
    return e.df.select(
        key.alias("k"),
        F.col(e.row).cast("string").alias("row"),
        (F.col(e.arrived).cast("timestamp_ntz") if e.arrived else null_ts).alias("at"),
        (F.col(e.period).cast("string") if e.period else null_s).alias("period"),
    )


#: Keys up to which they are broadcast (some 40 bytes each), and into how many parts a hot key is split beyond.
BROADCAST_KEYS = 500_000
SALTS = 16


def _meet(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (``k``, ``row``) whose key is among ``keys`` (``k`` once, other columns ride along). A few keys
    are sent to the rows; of many, each is met by a part of its rows at a time, so that a key which a
    third of all rows hold is no single task."""
    keys = cut(keys)
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), "k", "inner")
    part = F.pmod(F.xxhash64("row"), F.lit(SALTS))
    every = keys.withColumn("__part", F.explode(F.array(*[F.lit(n).cast("long") for n in range(SALTS)])))
    return rows.withColumn("__part", part).join(every, ["k", "__part"], "inner").drop("__part")


def _direct(child: Entity, parent: Entity, fk: ForeignKey, fold) -> DataFrame:
    """Rows of the child whose parent is missing, withdrawn or late. The join is on one row per key
    of either side: the child's keys are pre-aggregated with their earliest arrival, so that a key
    which holds a large share of the child meets the parent once, and only the keys that do not
    hold up meet the rows again (``_meet``)."""
    gone = F.col(parent.removed).isNotNull() if parent.removed else F.lit(False)
    came = F.col(parent.arrived).cast("timestamp_ntz") if parent.arrived else F.lit(None).cast("timestamp_ntz")
    parents = (
        parent.df.select(fold(F.col(fk.key)).alias("k"), gone.alias("gone"), came.alias("came"))
        .where("k IS NOT NULL")
        .groupBy("k")
        .agg(F.min("gone").alias("all_gone"), F.min("came").alias("first_came"))
    )
    rows = _rows(child, fold(F.col(fk.column))).where("k IS NOT NULL")
    keys = rows.groupBy("k").agg(F.min("at").alias("first_used"))
    bad = keys.join(parents, "k", "left").where("all_gone IS NULL OR all_gone OR first_came > first_used").select("k", "all_gone", "first_came")
    kind = (
        F.when(F.col("all_gone").isNull(), "missing").when(F.col("all_gone"), "deleted").when(F.col("first_came") > F.col("at"), "late")
    )
    return _meet(rows, bad).select("row", "period", "k", kind.alias("kind")).where("kind IS NOT NULL")


def find_orphans(
    entities: Mapping[str, Entity],
    keys: Sequence[ForeignKey],
    fold=folded,
    max_rounds: int | None = None,
) -> DataFrame:
    """Orphan references: ``table, row, period, reference, kind, level``.

    A non-NULL reference is a direct orphan (level 0) of kind 'missing' if the parent has no row
    with the key, 'deleted' if all its rows there are withdrawn, otherwise 'late' if the earliest
    of them arrived after the referring row itself. A row that refers to a record all of whose rows
    are missing- or deleted-orphans is an orphan too, of kind 'inherited', at one level more; this
    repeats down the graph (cycles included) until a round finds no new rows; with ``max_rounds`` it
    is an error if there are new ones still. 'late' is not inherited: the parent is there by now. A row that is a direct
    orphan of a reference is not reported as inherited. Copies of a row give one report row.

    NULL references are no case, NULL parent keys match nothing, an empty parent makes every
    reference 'missing', an empty child gives no rows. Only the named columns are read.

    Each round is a semi-join of the children with the keys newly orphaned, not with all keys, and
    is checkpointed. Tables no reference points to are not tracked further, so a graph one level
    deep takes no round at all.
    """
    found = [
        _direct(entities[fk.child], entities[fk.parent], fk, fold).select(
            F.lit(fk.child).alias("table"), "row", "period", F.lit(fk.name).alias("reference"), "kind", F.lit(0).alias("level")
        )
        for fk in keys
    ]
    result = reduce(DataFrame.unionByName, found).distinct()
    parents = {fk.parent for fk in keys}
    if not any(fk.child in parents for fk in keys):
        return result
    result = cut(result)
    frontier = result.where(F.col("kind").isin("missing", "deleted"))
    for level in count(1):
        step = []
        for fk in keys:
            parent, child = entities[fk.parent], entities[fk.child]
            if fk.parent not in {k.child for k in keys}:
                continue
            fresh = frontier.where(F.col("table") == fk.parent).select("row").distinct()
            gone = F.col(parent.removed).isNotNull() if parent.removed else F.lit(False)
            holder = parent.df.select(fold(F.col(fk.key)).alias("k"), F.col(parent.row).cast("string").alias("row"), gone.alias("gone")).where("k IS NOT NULL")
            touched = holder.join(fresh, "row", "left_semi").select("k").distinct()
            lost = result.where((F.col("table") == fk.parent) & F.col("kind").isin("missing", "deleted", "inherited")).select("row").distinct()
            kept = holder.join(touched, "k", "left_semi").where(~F.col("gone")).join(lost, "row", "left_anti").select("k").distinct()
            lost_keys = touched.join(kept, "k", "left_anti")
            rows = _meet(_rows(child, fold(F.col(fk.column))).where("k IS NOT NULL"), lost_keys)
            step.append(
                rows.select(
                    F.lit(fk.child).alias("table"), "row", "period", F.lit(fk.name).alias("reference"), F.lit("inherited").alias("kind"), F.lit(level).alias("level")
                )
            )
        known = result.select("table", "row", "reference").distinct()
        frontier = cut(reduce(DataFrame.unionByName, step).distinct().join(known, ["table", "row", "reference"], "left_anti"))
        if frontier.isEmpty():
            break
        if max_rounds is not None and level > max_rounds:
            raise RuntimeError(f"rows are still orphaned after {max_rounds} rounds")
        result = cut(result.unionByName(frontier))
    return result


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, period, reference and kind: ``table, period, reference, kind, level, rows``."""
    return orphans.groupBy("table", "period", "reference", "kind", "level").agg(F.count(F.lit(1)).alias("rows"))
