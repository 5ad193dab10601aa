"""Percentiles of very large number columns from mergeable rank-interval summaries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.session import cut

#: A summary is (values, smallest rank, largest rank), ascending: each value is one of the data, and
#: its rank lies in the stated interval. The first and last value and their ranks are exact.
Summary = tuple[np.ndarray, np.ndarray, np.ndarray]


def summarise(values: np.ndarray, keep: int) -> Summary:
    """The exact summary of some values, pruned to at most ``keep + 1`` tuples."""
    v = np.sort(values)
    r = np.arange(1, len(v) + 1, dtype=np.int64)
    return prune((v, r, r), keep)


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both data together. Rank intervals add; no tuple is lost, no error is added."""
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    out = []
    for (v, lo, hi), (w, wlo, whi), side in ((a, b, "left"), (b, a, "right")):
        # Of equal values those of b come after those of a, in both directions.
        at = np.searchsorted(w, v, side)
        before = np.concatenate([[0], wlo])[at]
        after = np.concatenate([whi - 1, [whi[-1]]])[at]
        out.append((v, lo + before, hi + after))
    v = np.concatenate([out[0][0], out[1][0]])
    order = np.argsort(v, kind="stable")
    return v[order], np.concatenate([out[0][1], out[1][1]])[order], np.concatenate([out[0][2], out[1][2]])[order]


def prune(s: Summary, keep: int) -> Summary:
    """At most ``keep + 1`` tuples, nearest to evenly spaced ranks; adds n / (2 keep) to the rank error."""
    v, lo, hi = s
    if len(v) <= keep + 1:
        return s
    n = int(hi[-1])
    want = 1 + (n - 1) * np.arange(keep + 1) / keep
    mid = (lo + hi) / 2.0
    at = np.clip(np.searchsorted(mid, want), 1, len(v) - 1)
    at = np.where(want - mid[at - 1] <= mid[at] - want, at - 1, at)
    at[0], at[-1] = 0, len(v) - 1
    at = np.unique(at)
    return v[at], lo[at], hi[at]


def merge_all(parts: Sequence[Summary]) -> Summary:
    """Merge pairwise, level by level, so that the work stays n log n."""
    parts = list(parts)
    while len(parts) > 1:
        parts = [merge(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


class Stack:
    """Summaries added one by one, of which only a logarithmic number is held: two of a level are merged
    into one of the next and pruned to ``keep`` tuples. Up to 2 ** 16 may be added; then the pruning on
    the way has added at most 16 n / (2 keep) to the rank error."""

    def __init__(self, keep: int):
        self.keep, self.levels = keep, []

    def add(self, s: Summary) -> None:
        for k, there in enumerate(self.levels):
            if there is None:
                self.levels[k] = s
                return
            s, self.levels[k] = prune(merge(there, s), self.keep), None
        self.levels.append(s)

    def whole(self) -> Summary:
        return merge_all([s for s in self.levels if s is not None])

    def tuples(self) -> int:
        return sum(len(s[0]) for s in self.levels if s is not None)


def query(s: Summary, p: float) -> tuple[float, int]:
    """The value whose rank is nearest to that of percentile p, and how far it can be off, in ranks."""
    v, lo, hi = s
    n = int(hi[-1])
    r = min(n, max(1, int(np.ceil(p * n))))
    off = np.maximum(np.abs(r - lo), np.abs(hi - r))
    k = int(np.argmin(off))
    return float(v[k]), int(off[k])


def _pack(s: Summary) -> tuple[list, list, list]:
    """Ranks as steps and widths: mostly ones and zeros, which compress well in a shuffle."""
    return s[0].tolist(), np.diff(s[1], prepend=0).tolist(), (s[2] - s[1]).tolist()


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows of keys and packed summaries; keys stay objects, so NULLs and whole numbers survive."""
    columns = [*names, "v", "step", "width"]
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(columns)})


def _unpack(v, step, width) -> Summary:
    lo = np.cumsum(np.asarray(step, np.int64))
    return np.asarray(v, float), lo, lo + np.asarray(width, np.int64)


def _keep(eps: float) -> int:
    """Tuples that a stage keeps: pruning to them adds an eighth of ``eps``. Its stack keeps 64 times as
    many at each level, which adds a 32nd at most."""
    return int(np.ceil(4.0 / eps))


def summaries(df: DataFrame, keys: Sequence[str], value: str, eps: float = 0.005, buffer: int = 1 << 19, held_tuples: int = 1 << 23) -> DataFrame:
    """Mergeable summaries per key: ``keys…, v, step, width``, one or more rows per key.

    Each task folds the values it sees into a stack of summaries per key, a buffer of ``buffer`` rows at a
    time, and sends all of them on when together they hold ``held_tuples`` (many keys) or it ends; so its
    memory depends neither on its rows nor on its keys. NULL and NaN values do not take part;
    infinite ones do. NULL keys are a key. Three sixteenths of ``eps`` are spent here, and keys with up
    to 4 / eps values in a task stay exact.
    """
    names = list(keys)
    keep = _keep(eps)
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in names]
    rows = df.select(*names, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: list[pd.DataFrame] = []
        parts: dict[tuple, Stack] = {}
        held = 0

        def fold() -> None:
            for key, v in pd.concat(waiting, ignore_index=True).groupby(names, dropna=False, sort=False)["__v"]:
                key = tuple(None if x is None or x != x else x for x in key)
                parts.setdefault(key, Stack(64 * keep)).add(summarise(v.to_numpy(float), 4 * keep))
            waiting.clear()

        def send() -> Iterator[pd.DataFrame]:
            out = [(*key, *_pack(prune(p.whole(), keep))) for key, p in parts.items()]
            parts.clear()
            for k in range(0, len(out), 256):
                yield _frame(out[k : k + 256], names)

        for b in batches:
            waiting.append(b)
            held += len(b)
            if held >= buffer:
                fold()
                held = 0
                if sum(p.tuples() for p in parts.values()) >= held_tuples:
                    yield from send()
        if waiting:
            fold()
        yield from send()

    return rows.mapInPandas(kernel, ", ".join(kinds) + ", v array<double>, step array<long>, width array<long>")


def merge_summaries(parts: DataFrame, keys: Sequence[str], eps: float = 0.005) -> DataFrame:
    """Merge the rows of equal keys into one summary each; spends five 32nds of ``eps``.

    The rows of a partition come in order of their keys, so one stack is held at a time.
    """
    names = list(keys)
    keep = _keep(eps)
    kinds = [f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in names]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, stack, out = None, None, []
        for b in batches:
            keyed = zip(*[[None if x is None or x != x else x for x in b[n]] for n in names], strict=True)
            for key, v, step, width in zip(keyed, b["v"], b["step"], b["width"], strict=True):
                if stack is None or key != now:
                    if stack is not None:
                        out.append((*now, *_pack(prune(stack.whole(), keep))))
                    now, stack = key, Stack(64 * keep)
                stack.add(_unpack(v, step, width))
                if len(out) >= 256:
                    yield _frame(out, names)
                    out = []
        if stack is not None:
            out.append((*now, *_pack(prune(stack.whole(), keep))))
        if out:
            yield _frame(out, names)

    moved = parts.select(*names, "v", "step", "width").repartition(*names).sortWithinPartitions(*names)
    return moved.mapInPandas(kernel, ", ".join(kinds) + ", v array<double>, step array<long>, width array<long>")


def percentiles_of(summary: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """``keys…, n, p (array), rank_error``: the percentiles and the largest rank error certified by
    the rank intervals of the summary itself."""
    names, ps = list(keys), list(probs)
    kinds = [f"`{k}` {summary.schema[k].dataType.simpleString()}" for k in names]

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for x in zip(b["v"], b["step"], b["width"], strict=True):
                s = _unpack(*x)
                answers = [query(s, p) for p in ps]
                got.append((int(s[2][-1]), [a for a, _ in answers], max(e for _, e in answers)))
            yield pd.concat([b[names].reset_index(drop=True), pd.DataFrame(got, columns=["n", "p", "rank_error"])], axis=1)

    return summary.mapInPandas(kernel, ", ".join(kinds) + ", n long, p array<double>, rank_error long")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], load: str | None = None, eps: float = 0.005, fan_in: int = 64) -> DataFrame:
    """Percentiles of ``value`` per key, and per load and key, with a rank error of at most ``eps * n``:
    ``scope, load, keys…, n, p, rank_error``.

    Percentile p is the value of rank ceil(p n). Summaries are merged in a hierarchy: per task, then
    per key, load and one of ``fan_in`` shares (so a key that a third of all rows share is merged by
    many tasks), then per key and load (rows of scope 'load'), then per key (scope 'all', a NULL load):
    what the loads kept is combined, the data are not read again. Each level prunes to what a part
    of ``eps`` allows, and the ranks that the error may cover travel with the tuples. ``rank_error`` is
    what they certify at the end: 0 for small keys, which stay exact. Without ``load`` there are only rows
    of scope 'all' and no column for it. The summaries of a load can be kept (``summaries``,
    ``merge_summaries``) and merged with those of later loads.

    NULL and NaN values do not take part, and a key without other values gives no row; a NULL load is a load;
    an empty table gives no rows.
    """
    names = list(keys)
    levels = [*([load] if load and load not in names else []), *names]
    leaf = summaries(df, levels, value, eps).withColumn("__share", F.pmod(F.xxhash64(F.spark_partition_id()), F.lit(fan_in)).cast("int"))
    per_load = merge_summaries(merge_summaries(leaf, [*levels, "__share"], eps), levels, eps)
    if levels == names:
        return percentiles_of(per_load, names, probs).select(F.lit("all").alias("scope"), *names, "n", "p", "rank_error")
    per_load = cut(per_load)  # read twice
    each = percentiles_of(per_load, levels, probs).select(F.lit("load").alias("scope"), *levels, "n", "p", "rank_error")
    whole = percentiles_of(merge_summaries(per_load, names, eps), names, probs)
    return each.unionByName(whole.select(F.lit("all").alias("scope"), F.lit(None).cast(df.schema[load].dataType).alias(load), *names, "n", "p", "rank_error"))


def ranks_within(df: DataFrame, keys: Sequence[str], value: str, found: DataFrame, probs: Sequence[float]) -> DataFrame:
    """``keys…, prob, n, within``: whether the exact ranks of each percentile of ``found`` (``keys…, n, p,
    rank_error``) reach to within its stated error of ceil(prob n). NULL keys equal each other."""
    names = list(keys)
    rows = df.select(*names, F.col(value).cast("double").alias("__v")).where("__v IS NOT NULL AND NOT isnan(__v)")
    f = found.select(*[F.col(k).alias(f"__{k}") for k in names], "p", F.col("n").alias("__n"), "rank_error")
    same = None
    for k in names:
        one = F.col(k).eqNullSafe(F.col(f"__{k}"))
        same = one if same is None else same & one
    below = [x for i in range(len(probs)) for x in (F.count_if(F.col("__v") < F.col("p")[i]).alias(f"__a{i}"), F.count_if(F.col("__v") <= F.col("p")[i]).alias(f"__b{i}"))]
    got = rows.join(f, same).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.max("__n").alias("__n"), F.max("rank_error").alias("rank_error"), *below)
    each = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("prob"), F.col(f"__a{i}").alias("a"), F.col(f"__b{i}").alias("b")) for i, q in enumerate(probs)]))
    want = F.greatest(F.ceil(F.col("x.prob") * F.col("n")), F.lit(1))
    off = F.greatest(F.col("x.a") + 1 - want, want - F.col("x.b"), F.lit(0))
    return got.withColumn("x", each).select(*names, F.col("x.prob").alias("prob"), "n", ((F.col("n") == F.col("__n")) & (off <= F.col("rank_error"))).alias("within"))
