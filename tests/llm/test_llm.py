"""Top N, clusters, quantiles, packing, mixing and repetition against brute force and edge cases."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenframe.llm import clusters, packing, quantiles, repetition
from lumenframe.llm.mixing import MOST_BLOCKS, MixRule, block_size, mix_sources, permuted_blocks, split_blocks
from lumenframe.llm.tokens import token_counts
from lumenframe.llm.topn import top_n_per_group

# --- top N ------------------------------------------------------------------------------------------


def test_top_n_against_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = [(int(g), float(np.round(s, 1)), int(i), "x", 1) for i, (g, s) in enumerate(zip(rng.choice([0, 0, 0, 1, 2, 3], 3000), rng.normal(0, 1, 3000), strict=True))]
    rows += rows[:400] + rows[:100]
    df = spark.createDataFrame(rows, "fr long, v double, id long, s string, r int").repartition(7)
    got = {}
    for r in top_n_per_group(df, "fr", "v", "id", 5, salts=4).collect():
        got.setdefault(r["fr"], {})[r["rank"]] = r["id"]
    for g in range(4):
        best = sorted({(-v, i) for f, v, i, *_ in rows if f == g})[:5]
        assert [got[g][k + 1] for k in range(5)] == [i for _, i in best]


def test_top_n_edge_cases(spark):
    nan = float("nan")
    rows = [(None, 1.0, 1), (1, None, 2), (1, nan, 3), (1, 5.0, None), (1, 5.0, 4), (1, 5.0, 4), (1, float("inf"), 9), (2, -1.0, 7)]
    df = spark.createDataFrame(rows, "g long, s double, i long").withColumn("t", F.lit(1)).withColumn("rank", F.lit(2))
    got = [(r["g"], r["rank"], r["i"]) for r in top_n_per_group(df, "g", "s", "i", 8).orderBy("g", "rank").collect()]
    assert got == [(1, 1, 9), (1, 2, 4), (1, 3, None), (2, 1, 7)]
    assert top_n_per_group(df.limit(0), "g", "s", "i", 8).count() == 0


# --- clusters ---------------------------------------------------------------------------------------

CELLS = ["a", "b", "c", "al", "be", "ga"]


def alike(x, y):
    for order, flips in clusters.VARIANTS:
        z = clusters._turned(np.array([y], float), order, flips, 180.0)[0]
        if all(abs(p - q) <= 0.05 * max(p, q) for p, q in zip(x[:3], z[:3], strict=True)) and all(abs(p - q) <= 3 for p, q in zip(x[3:], z[3:], strict=True)):
            return True
    return False


def brute_pairs(cells):
    ids = sorted(cells)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(ids, 2):
        if alike(cells[i], cells[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(i)
    return {p for g in groups.values() for p in zip(g[:-1], g[1:], strict=True)}


def turned_at_random(x, rng):
    order, flips = clusters.VARIANTS[rng.integers(24)]
    return clusters._turned(np.array([x], float), order, flips, 180.0)[0]


def found_pairs(spark, rows):
    df = spark.createDataFrame(rows, "i long, " + ", ".join(f"{c} double" for c in CELLS)).withColumn("node", F.lit(1)).withColumn("box", F.lit("x"))
    g = clusters.cell_groups(df, "i", CELLS)
    return g, {(r["a"], r["b"]) for r in clusters.group_pairs(g).collect()}


def test_cell_groups_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = [(50, 50.5, 120, 90, 90, 120), (40, 62, 80, 88, 95, 91), (70, 71, 72, 90, 90, 90)]
    cells = {k: turned_at_random(np.array(centres[k % 3]) * (1 + rng.normal(0, 0.004, 6)), rng) for k in range(60)}
    # A chain whose ends are not alike, and pairs near the tolerance on either side.
    for k in range(8):
        cells[100 + k] = turned_at_random((30 * 1.04**k, 55, 140, 90, 100, 90), rng)
    for k, f in enumerate((1.0, 1.049, 1.11, 1.17)):
        cells[200 + k] = turned_at_random((25 * f, 90, 200, 80, 85 + k, 70), rng)
    for k in range(30):
        cells[300 + k] = np.array([*np.exp(rng.uniform(3.2, 3.5, 3)), *rng.uniform(85, 95, 3)])
    g, got = found_pairs(spark, [(k, *map(float, v)) for k, v in cells.items()] + [(0, *map(float, cells[0]))])
    assert got == brute_pairs(cells)
    d = clusters.describe_groups(g).toPandas()
    assert d["size"].sum() == len(cells) and all(1 <= len(t) <= 3 for t in d["typical"])


def test_the_flow_alone_joins_cells(spark, monkeypatch):
    """With each node its own attractor no groups come out: links that cross are an error, not a join."""
    rows = [(k, 50.0 * 1.03**k, 60.0, 70.0, 90.0, 90.0, 90.0) for k in range(12)]
    assert found_pairs(spark, rows)[1] == {(k, k + 1) for k in range(11)}
    monkeypatch.setattr(clusters, "markov_clusters", lambda nodes, links, rule: nodes.select("node", "size", F.col("node").alias("attractor"), F.col("size").cast("double").alias("flow")))
    with pytest.raises(RuntimeError):
        clusters.closed_clusters(*chain(spark, 12), clusters.CellRule(max_levels=2))


def chain(spark, n):
    nodes = spark.createDataFrame([(k, 1) for k in range(n)], "node long, size long")
    return nodes, spark.createDataFrame([(k, k + 1, 0.4 + 0.01 * (k % 7)) for k in range(n - 1)], "a long, b long, dist double")


def test_clusters_close_over_long_chains_and_mixed_shapes(spark):
    nodes, links = chain(spark, 40)
    more = [(200, 201, 2.5), (300, 301, 0.1), (300, 302, 0.1), (300, 303, 2.0), (303, 304, 2.0), (305, 306, 0.0)]
    nodes = nodes.unionByName(spark.createDataFrame([(k, k) for k in (200, 201, 300, 301, 302, 303, 304, 305, 306, 400)], nodes.schema))
    links = links.unionByName(spark.createDataFrame(more, links.schema))
    got = {}
    for r in clusters.closed_clusters(nodes, links, clusters.CellRule()).collect():
        got.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(40)), [200, 201], [300, 301, 302, 303, 304], [305, 306], [400]]


def test_flows_that_have_not_settled_are_an_error(spark):
    nodes = spark.createDataFrame([(k, 1) for k in range(6)], "node long, size long")
    links = spark.createDataFrame([(k, k + 1, 0.3 + 0.1 * k) for k in range(5)], "a long, b long, dist double")
    assert clusters.CellRule().settle == 1e-3
    assert clusters.markov_clusters(nodes, links, clusters.CellRule()).count() == 6
    with pytest.raises(RuntimeError):
        clusters.markov_clusters(nodes, links, clusters.CellRule(max_rounds=1))


def test_boxes_that_stay_open_are_split(spark):
    """Two boxes of many cells whose bounds do not decide: only one pair across is alike, or none."""
    rng = np.random.default_rng(7)
    for gap, linked in ((0.9, True), (1.02, False)):
        unit = clusters.CellRule().edge_unit
        left = [(k, math.exp(unit * (90.02 + 0.2 * rng.random())), 100.0, 250.0, 90.0, 100.0, 90.0) for k in range(40)]
        right = [(100 + k, math.exp(unit * (91.02 + gap + 0.2 * rng.random())), 100.0, 250.0, 90.0, 100.0, 90.0) for k in range(40)]
        rows = left + right + [(90, math.exp(unit * 90.5), *left[0][2:]), (190, math.exp(unit * (90.5 + gap)), *left[0][2:])]
        cells = {r[0]: r[1:] for r in rows}
        _, got = found_pairs(spark, rows)
        assert got == brute_pairs(cells)


def test_cell_groups_edge_cases(spark):
    nan = float("nan")
    ok = (50.0, 60.0, 70.0, 90.0, 90.0, 90.0)
    rows = [(1, *ok), (2, *ok), (3, nan, *ok[1:]), (4, None, *ok[1:]), (5, 0.0, *ok[1:]), (6, -50.0, *ok[1:]), (7, float("inf"), *ok[1:]), (None, *ok)]
    assert found_pairs(spark, rows)[1] == {(1, 2)}
    assert found_pairs(spark, [])[1] == set()


# --- quantiles --------------------------------------------------------------------------------------


def check_summary(s, data):
    v, lo, hi = s
    data = np.sort(data)
    assert (np.diff(v) >= 0).all() and hi[-1] == len(data) and lo[0] == 1
    first, last = np.searchsorted(data, v, "left") + 1, np.searchsorted(data, v, "right")
    assert (first <= last).all()  # each value is one of the data
    assert ((lo <= last) & (hi >= first)).all() and (lo <= hi).all()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(-20, 20), min_size=1, max_size=60), min_size=1, max_size=6), st.integers(4, 20))
def test_summaries_keep_their_promise(parts, keep):
    arrays = [np.array(p, float) for p in parts]
    s = quantiles.prune(quantiles.merge_all([quantiles.summarise(a, keep) for a in arrays]), keep)
    data = np.concatenate(arrays)
    check_summary(s, data)
    data = np.sort(data)
    for p in (0.01, 0.25, 0.5, 0.9, 1.0):
        v, err = quantiles.query(s, p)
        r = max(1, math.ceil(p * len(data)))
        a, b = np.searchsorted(data, v, "left") + 1, np.searchsorted(data, v, "right")
        assert max(a - r, r - b, 0) <= err


def test_percentiles_within_the_bound(spark):
    rng = np.random.default_rng(0)
    n = 60000
    x = rng.standard_cauchy(n)
    k = rng.choice(["hot", "hot", "b", None], n)
    days = rng.integers(0, 5, n)
    rows = spark.createDataFrame([(None if c is None or c == "None" else str(c), int(d), float(v)) for c, d, v in zip(k, days, x, strict=True)], "k string, day int, x double").repartition(6)
    rows = rows.unionByName(spark.createDataFrame([("b", 1, None), ("b", 1, float("nan")), ("void", 1, None)], rows.schema))
    probs = [0.01, 0.5, 0.99]
    all_ = quantiles.percentiles(rows, ["k"], "x", probs, load="day", eps=0.01).collect()
    assert {(r["k"], r["day"]) for r in all_ if r["scope"] == "load"} == {(c, d) for c in ("hot", "b", None) for d in range(5)}
    got = {r["k"]: r for r in all_ if r["scope"] == "all"}
    days = {(c, d): np.sort(x[[(None if e is None or e == "None" else e) == c and f == d for e, f in zip(k, days, strict=True)]]) for c in ("hot", "b") for d in range(5)}
    for r in all_:
        if r["scope"] == "load" and r["k"] is not None:
            data = days[r["k"], r["day"]]
            assert r["n"] == len(data) and r["rank_error"] <= 0.01 * len(data)
            assert abs(np.searchsorted(data, r["p"][1]) + 1 - math.ceil(0.5 * len(data))) <= r["rank_error"]
    assert set(got) == {"hot", "b", None}
    for key, r in got.items():
        data = np.sort([v for c, v in zip(k, x, strict=True) if (None if c is None or c == "None" else c) == key])
        assert r["n"] == len(data) and r["rank_error"] <= 0.01 * len(data)
        for p, v in zip(probs, r["p"], strict=True):
            assert abs(np.searchsorted(data, v) + 1 - math.ceil(p * len(data))) <= r["rank_error"]


def test_a_stack_holds_few_tuples_and_keeps_its_promise():
    rng = np.random.default_rng(8)
    stack, data, keep = quantiles.Stack(400), [], 100
    for _ in range(300):
        v = rng.normal(0, 1, 500)
        data.append(v)
        stack.add(quantiles.summarise(v, 400))
        assert stack.tuples() <= 401 * 10
    data = np.sort(np.concatenate(data))
    s = quantiles.prune(stack.whole(), keep)
    check_summary(s, data)
    assert max(quantiles.query(s, p)[1] for p in (0.01, 0.5, 0.99)) <= len(data) * (9 / 800 + 1 / 200 + 1 / 800)


def test_tasks_with_many_keys_send_early(spark):
    df = spark.range(40000).select((F.col("id") % 4000).alias("k"), F.col("id").cast("double").alias("x")).coalesce(1)
    parts = quantiles.summaries(df, ["k"], "x", buffer=2000, held_tuples=9000)
    assert parts.count() > 4000
    got = quantiles.percentiles_of(quantiles.merge_summaries(parts, ["k"]), ["k"], [0.5]).toPandas()
    assert len(got) == 4000 and (got["n"] == 10).all() and (got["rank_error"] == 0).all()
    ranks = quantiles.ranks_within(df, ["k"], "x", quantiles.percentiles(df, ["k"], "x", [0.5]), [0.5]).toPandas()
    assert len(ranks) == 4000 and ranks["within"].all() and (ranks["n"] == 10).all()
    wrong = quantiles.percentiles(df, ["k"], "x", [0.5]).withColumn("p", F.transform("p", lambda v: v + 60000))
    assert not quantiles.ranks_within(df, ["k"], "x", wrong, [0.5]).where("within").count()


def test_days_can_be_combined_later(spark):
    df = spark.range(5000).select(F.lit("k").alias("k"), (F.col("id") % 5).cast("int").alias("day"), F.col("id").cast("double").alias("x"))
    per_day = quantiles.merge_summaries(quantiles.summaries(df, ["k", "day"], "x", 0.02), ["k", "day"], 0.02)
    assert per_day.count() == 5
    r = quantiles.percentiles_of(quantiles.merge_summaries(per_day, ["k"], 0.02), ["k"], [0.5]).first()
    assert abs(r["p"][0] - 2499) <= r["rank_error"] <= 0.02 * 5000
    assert quantiles.percentiles(df.limit(0), ["k"], "x", [0.5]).count() == 0


# --- packing ----------------------------------------------------------------------------------------


def brute_fill(counts, room):
    sums = {0}
    for x, c in counts.items():
        sums = {s + k * x for s in sums for k in range(c + 1) if s + k * x <= room}
    return max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 6), max_size=7), st.integers(0, 60))
def test_best_fill_is_best(counts, room):
    used = packing.best_fill(counts, room)
    assert all(used[x] <= counts[x] for x in used)
    assert sum(x * c for x, c in used.items()) == brute_fill(counts, room)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 200), max_size=12))
def test_plan_uses_every_length_once(histogram):
    used = {}
    for pattern, times in packing.plan_bins(histogram, 40):
        assert sum(x * c for x, c in pattern.items()) <= 40 and times > 0
        for x, c in pattern.items():
            used[x] = used.get(x, 0) + c * times
    assert used == histogram


def test_pack(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.where(rng.random(2000) < 0.4, 17, rng.integers(1, 130, 2000))]
    rows = [(k, n) for k, n in enumerate(sizes)] + [(5000, 100), (5001, 350), (5002, 0), (5003, None), (5004, -3), (None, 60), (5005, 300)]
    df = spark.createDataFrame(rows, "d long, n long").withColumn("piece", F.lit(9)).withColumn("container", F.lit("x"))
    p = packing.pack(df, "d", "n", 100).toPandas()
    assert set(p[p.container.isna()]["d"]) == {5002, 5003, 5004} and (p[p.container.isna()]["n"] == 0).all()
    full = p.dropna(subset=["container"])
    assert full.groupby("container")["n"].sum().max() == 100
    assert sorted(full[full.d == 5001]["n"]) == [50, 100, 100, 100] and sorted(full[full.d == 5005]["n"]) == [100, 100, 100]
    want = sum(max(n or 0, 0) for _, n in rows)
    assert full["n"].sum() == want and not full.duplicated(["d", "piece"]).any()
    assert (p.groupby("d")["piece"].count()[[k for k, n in enumerate(sizes) if n <= 100]] == 1).all()
    assert full["container"].nunique() <= math.ceil(want / 100) * 1.03 + 1
    again = packing.pack(df.repartition(3), "d", "n", 100).toPandas()
    cols = ["d", "piece", "n", "container"]
    assert p[cols].sort_values(cols).reset_index(drop=True).equals(again[cols].sort_values(cols).reset_index(drop=True))
    assert packing.pack(df.limit(0), "d", "n", 100).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "d", "n", 0)


# --- mixing -----------------------------------------------------------------------------------------


def test_splitting_tree_partitions_all_blocks():
    blocks = np.array([100, 7, 0, 33])
    parts = [split_blocks(blocks, 9, s, 3) for s in range(9)]
    assert (sum(n for _, n in parts) == blocks).all()
    at = np.zeros(4, int)
    for first, n in parts:
        assert (first[n > 0] == at[n > 0]).all()
        at += n
    sizes = [int(n.sum()) for _, n in parts]
    assert max(sizes) - min(sizes) <= 4


def test_blocks_stay_few_enough_to_be_split():
    for uses in (0, 5, 16, 10**9, 32 * 10**9, 10**13):
        assert block_size(uses, MixRule()) >= 16 and uses / block_size(uses, MixRule()) <= MOST_BLOCKS
    uses = np.array([20 * 10**9, 11 * 10**9, 10**9])  # 2e9 blocks of 16
    blocks = -(-uses // block_size(int(uses.sum()), MixRule()))
    parts = [split_blocks(blocks, 5, s, 3) for s in range(5)]
    assert (sum(n for _, n in parts) == blocks).all()


def test_blocks_are_permuted_at_random(spark):
    blocks = np.array([5000, 1, 0, 300])
    got = permuted_blocks(spark, ["a", "b", "c", "d"], blocks, MixRule(slice_rows=100)).toPandas()
    for name, n in zip("abcd", blocks, strict=True):
        g = got[got.s == name]
        assert sorted(g["block"]) == sorted(g["permuted"]) == list(range(n))
    a = got[got.s == "a"].sort_values("block")["permuted"].to_numpy()
    step = np.diff(a) % 5000
    assert np.unique(step, return_counts=True)[1].max() < 10 and abs(np.corrcoef(np.arange(5000), a)[0, 1]) < 0.05


def test_mix(spark):
    rng = np.random.default_rng(3)
    rows = [(k, " Big" if k % 2 else "BIG", int(rng.integers(1, 50))) for k in range(2000)]
    rows += [(3000 + k, "small", int(rng.integers(1, 50))) for k in range(100)]
    rows += [(4000, "other", 10), (4001, None, 10), (4002, "big", None), (4003, "small", 0)]
    df = spark.createDataFrame(rows, "d long, s string, n long").withColumn("uses", F.lit(1))
    t = spark.createDataFrame([("big", 0.7, 1), ("Small ", 0.2, 4), ("absent", 0.1, 3), (None, 0.5, 1), ("zero", 0.0, 2)], "source string, target_share double, max_repeats int")
    m = mix_sources(df, "d", "s", "n", t, rule=MixRule(block=8, shard_size=3000))
    draws, uses, shares = m.draws.toPandas(), m.uses.toPandas(), m.shares.toPandas().set_index("source")
    assert len(uses) == len(rows) and uses["uses"].sum() == len(draws)
    per = draws.groupby("d").size()
    assert (uses[uses.uses > 0].set_index("d")["uses"].sort_index() == per.sort_index()).all()
    assert uses[uses.d.isin([4000, 4001, 4002, 4003])]["uses"].sum() == 0
    small = uses[uses.source == "small"]
    assert small["uses"].max() <= 4 and small[small["size"] > 0]["uses"].min() >= 3
    assert abs(shares.loc["big", "actual_share"] - 7 / 9) < 0.005 and abs(shares.loc["small", "actual_share"] - 2 / 9) < 0.005
    assert shares.loc["absent", "actual_share"] == 0 and shares["actual_share"].sum() == pytest.approx(1)
    assert not draws.duplicated(["d", "use"]).any()
    for _, g in draws.groupby("shard"):
        assert sorted(g["position"]) == list(range(len(g)))
    again = mix_sources(df.repartition(5), "d", "s", "n", t, rule=MixRule(block=8, shard_size=3000)).draws.toPandas()
    key = ["shard", "position", "d", "use"]
    assert draws[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "d long, s string, n long")
    t = spark.createDataFrame([("big", 0.7, 1)], "source string, target_share double, max_repeats int")
    m = mix_sources(df, "d", "s", "n", t)
    assert m.draws.count() == 0 and m.uses.count() == 0 and m.shares.first()["actual_share"] == 0
    one = spark.createDataFrame([(1, "a", 5)], "d long, s string, n long")
    assert mix_sources(one, "d", "s", "n", t.limit(0)).uses.first()["uses"] == 0


# --- tokens and repetition --------------------------------------------------------------------------


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (4, "<|endoftext|>"), (5, "word " * 50000)], "id long, text string").withColumn("tokens_", F.lit(1))
    got = {r["id"]: r["tokens"] for r in token_counts(df, ["id"], "text").collect()}
    assert got[1] == 2 and got[2] == 0 and got[3] == 0 and got[4] > 1 and got[5] >= 50000


def brute_repeated(words, n=4):
    hit, seen = set(), set()
    for i in range(len(words) - n + 1):
        g = tuple(words[i : i + n])
        if g in seen:
            hit |= set(range(i, i + n))
        seen.add(g)
    return len(hit)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 5))
def test_repeated_words(words, n):
    assert int(repetition.repeated_words(words, n).sum()) == brute_repeated(words, n)


def repetitive_documents():
    rng = np.random.default_rng(0)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(500)]
    words = lambda n: [vocabulary[k] for k in rng.integers(0, 500, n)]
    rows, high = [], set()
    for k in range(400):
        w = words(int(rng.integers(5, 300)))
        if k % 5 == 0:
            part = w[: max(5, len(w) // 3)]
            w = w + part * int(rng.integers(1, 4))
        n, r = len(w), brute_repeated(w)
        if n >= 20 and r >= 0.3 * n - 1e-9:
            high.add(k)
        rows.append((k, " ".join(x.upper() if k % 2 and i % 3 else x for i, x in enumerate(w))))
    rows += [(1000, None), (1001, ""), (1002, "  \n "), (1003, "12 34 !!"), (1004, "spam egg " * 200000), (1005, "a b c d a b c d")]
    return rows, high


def test_repetition(spark):
    rows, high = repetitive_documents()
    df = spark.createDataFrame(rows, "doc long, text string").withColumn("words", F.lit(3))
    got = repetition.repetition(df, "doc", "text", measure_all=True).toPandas().set_index("doc")
    assert set(got.index[got.high]) == high | {1004}
    assert got.loc[[1000, 1001, 1002, 1003], "words"].sum() == 0 and got.loc[1005, "repeated"] == 4
    assert all(brute_repeated(t.lower().split()) == got.loc[k, "repeated"] for k, t in rows[:400])
    assert got.loc[sorted(high), "anomaly"].mean() > got.loc[~got.high, "anomaly"].mean() + 0.1
    few = repetition.repetition(df.repartition(5), "doc", "text").toPandas().set_index("doc")
    assert set(few.index[few.high]) == high | {1004} and (few["repeated"].isna() == ~few["proposed"]).all()
    assert few["proposed"].sum() < 0.6 * len(few)
    assert repetition.repetition(df.limit(0), "doc", "text").count() == 0
    assert repetition.repetition(df.where("doc >= 1000 AND doc <> 1004"), "doc", "text").where("high").count() == 0


def test_the_forest_decides_which_documents_are_repetitive(spark, monkeypatch):
    rows, high = repetitive_documents()
    df = spark.createDataFrame(rows, "doc long, text string")
    x, label = repetition.labelled_rows(df, "doc", "text", repetition.RepetitionRule())
    assert label.sum() == len(high) + 1
    monkeypatch.setattr(repetition.IsolationForest, "score", lambda self, x: np.full(len(x), 0.5))
    assert repetition.calibrate(x, label, repetition.RepetitionRule()).threshold > 0.5  # a forest that tells nothing proposes nothing
    monkeypatch.undo()
    rng = np.random.default_rng(3)
    half = rng.random(len(label)) < 0.5
    judge = repetition.calibrate(x[half], label[half], repetition.RepetitionRule())
    proposed = judge.forest.score(x[~half]) >= judge.threshold
    assert proposed[label[~half]].mean() >= 0.9 and proposed[~label[~half]].mean() <= 0.3
    blind = repetition.Judge(judge.forest, 2.0)
    monkeypatch.setattr(repetition, "calibrate", lambda *a: blind)
    assert repetition.repetition(df, "doc", "text").where("high").count() == 0


def test_forest_finds_planted_rows():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, (2000, 5)), rng.normal(7, 0.5, (20, 5))])
    s = repetition.IsolationForest(x, 100, 256, 0).score(x)
    assert s[2000:].min() > np.quantile(s[:2000], 0.99)
