"""Spikes, profiles and orphans on small fixtures: brute force, edge cases, and the written rules."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.operators.orphans import Entity, ForeignKey, find_orphans, orphan_report
from lumenframe.operators.positions import consecutive_pairs, dense_positions
from lumenframe.operators.profile import BadLoadRule, bad_loads, judge_loads, load_profiles, profile_columns
from lumenframe.operators.spikes import Bound, SpikeRule, implausible_readings


def readings(spark, rows, **kw):
    df = spark.createDataFrame(rows, "src string, ord long, id long, v double, m int, reason string")
    got = implausible_readings(df, "src", "ord", "id", {"v": Bound(0.0, strict=True)}, **kw)
    return {(r["id"], r["reason"]) for r in got.collect()}


def series(n, seed=0, base=10.0):
    return np.random.default_rng(seed).normal(base, 0.2, n)


def test_spikes_of_each_kind(spark):
    v = series(300)
    v[50] = 14.0  # a spike
    v[100:107] = v[100]  # seven equal ones
    v[150] = -1.0  # impossible
    v[200:] += 5.0  # a lasting change of level is none
    v += np.linspace(0, 1, 300)  # nor is slow drift ...
    v[100:107] = v[100]
    v[150] = -1.0
    rows = [("a", k, k, float(x), 1, "clash") for k, x in enumerate(v)]
    rows += [rows[50], rows[101]]  # copies count once
    want = {(50, "spike"), (150, "impossible"), *((k, "stuck") for k in range(100, 107))}
    assert readings(spark, rows) == want


def test_spikes_do_not_depend_on_chunks(spark):
    v = series(700, 3)
    for k in (0, 99, 100, 255, 256, 511, 699):
        v[k] += 4.0
    v[320:326] = 9.9
    rows = [("a", k, k, float(x), 1, "") for k, x in enumerate(v)]
    whole = readings(spark, rows)
    assert whole == readings(spark, rows, rule=SpikeRule(chunk=128, slice_width=100))
    assert {k for k, _ in whole} == {0, 99, 100, 255, 256, 511, 699, *range(320, 326)}


def test_spikes_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(None, k, k, float(x), None, None) for k, x in enumerate(series(40, 1))]  # a NULL source is a source
    rows += [("c", k, 100 + k, 1.0, 1, "") for k in range(30)]  # constant: not stuck
    rows += [("n", k, 200 + k, None, 1, "") for k in range(5)]
    rows += [("x", 0, 300, nan, 1, ""), ("x", 1, 301, inf, 1, ""), ("x", None, 302, 3.0, 1, "")]
    assert readings(spark, rows) == {(300, "impossible"), (301, "impossible")}
    assert readings(spark, []) == set()


def test_run_across_nulls_and_short_run(spark):
    v = list(series(60, 2))
    v[10:20] = [5.5, None, 5.5, 5.5, None, None, 5.5, 5.5, 5.5, v[19]]
    v[30:35] = [8.8] * 5
    rows = [("a", k, k, None if x is None else float(x), 1, "") for k, x in enumerate(v)]
    got = readings(spark, rows)
    assert {k for k, r in got if r == "stuck"} == {10, 12, 13, 16, 17, 18}


def test_a_burst_of_spikes(spark):
    v = series(80, 5)
    v[1:4] = [13.0, 14.0, 60.0]
    assert readings(spark, [("a", k, k, float(x), 1, "") for k, x in enumerate(v)]) == {(1, "spike"), (2, "spike"), (3, "spike")}


def test_a_stuck_run_at_a_chunk_edge_hides_no_level(spark):
    """A new level begins just before a chunk's edge, then many stuck values follow: no spike, however cut."""
    v = np.concatenate([series(127, 6), series(1, 7, 30.0), np.full(200, 30.1), series(100, 8, 30.0)])
    rows = [("a", k, k, float(x), 1, "") for k, x in enumerate(v)]
    want = {(k, "stuck") for k in range(128, 328)}
    assert readings(spark, rows) == want
    assert readings(spark, rows, rule=SpikeRule(chunk=128, slice_width=64)) == want


def test_positions_and_pairs(spark):
    rng = np.random.default_rng(0)
    rows = [("h" if x < 0.6 else "t", int(k)) for k, x in zip(rng.permutation(500), rng.random(500), strict=True)]
    df = spark.createDataFrame(rows, "g string, k long")
    at = dense_positions(df, ["g"], F.floor(F.col("k") / 37), [F.col("k")]).toPandas()
    for _, g in at.groupby("g"):
        assert list(g.sort_values("k")["pos"]) == list(range(len(g)))
    pairs = consecutive_pairs(df.unionByName(df), "g", "k", width=41).toPandas()
    for name, g in at.groupby("g"):
        ks = sorted(g["k"])
        assert set(map(tuple, pairs[pairs.g == name][["a", "b"]].to_numpy().tolist())) == set(zip(ks[:-1], ks[1:], strict=True))


def loads(n_loads=12, n=200, seed=0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"load": np.repeat(np.arange(n_loads), n), "x": np.round(np.exp(rng.normal(0, 0.3, n_loads * n)), 5)})


def found(spark, p):
    df = spark.createDataFrame([(int(a), None if pd.isna(b) else float(b)) for a, b in p.to_numpy()], "load int, x double")
    return {r["load"]: r["reasons"] for r in bad_loads(df, "load", ["x"]).collect()}


def test_bad_loads(spark):
    p = loads()
    assert found(spark, p) == {}
    p.loc[(p.load == 2) & (np.arange(len(p)) % 2 == 0), "x"] = np.nan
    p.loc[p.load == 4, "x"] *= 10
    p.loc[p.load == 6, "x"] = p.x.round(0) + 1
    p.loc[p.load == 8, "x"] = np.exp(np.log(p.x) * 0.1)
    p.loc[(p.load == 10) & (np.arange(len(p)) % 4 == 0), "x"] = 0.0
    p.loc[np.arange(len(p)) % 200 == 7, "x"] = -5.0  # a stray in every load is no case
    assert set(found(spark, p)) == {2, 4, 6, 8, 10}


def test_profiles_edge_cases(spark):
    df = spark.createDataFrame([(None, 1.0), (1, None), (1, float("nan")), (1, -1.0), (1, 2.0), (1, 2.0)], "load int, x double")
    r = load_profiles(df, "load", ["x"]).collect()
    assert [(x["load"], x["rows"], x["nulls"], x["impossible"], x["distinct"]) for x in r] == [(1, 5, 1, 2, 3)]
    assert load_profiles(df.limit(0), "load", ["x"]).count() == 0
    assert bad_loads(df.limit(0), "load", ["x"]).count() == 0
    assert len(judge_loads(pd.DataFrame({"load": [1], "column": ["x"], "rows": [5], "nulls": [5], "impossible": [0], "outside": [0], "distinct": [0], "quantiles": [None]}), BadLoadRule())) == 1


@pytest.mark.parametrize("dictionary", [True, False])
def test_profile_of_columns(spark, tmp_path, dictionary):
    import pyarrow as pa
    import pyarrow.parquet as pq

    a = pa.table({"i": pa.array([1, 2, 2, None] * 50), "d": pa.array([0.5, float("nan"), None, 1.5] * 50), "s": pa.array(["ab", "b", None, ""] * 50), "e": pa.array([None] * 200, pa.float64())})
    n = 6000
    b = pa.table({"i": pa.array(range(n)), "d": pa.array([float(k) for k in range(n)]), "s": pa.array([str(k) for k in range(n)]), "e": pa.array([None] * n, pa.float64())})
    pq.write_table(a, tmp_path / "a.parquet", use_dictionary=dictionary, row_group_size=60)
    pq.write_table(b, tmp_path / "b.parquet", use_dictionary=dictionary, dictionary_pagesize_limit=64, row_group_size=5000)
    got = {r["column"]: r for r in profile_columns(spark.read.parquet(str(tmp_path)), patterns={"s": "^[0-9]+$"}).collect()}
    assert (got["i"]["rows"], got["i"]["nulls"], got["i"]["distinct"], got["i"]["lo"], got["i"]["hi"]) == (6200, 50, 6000, 0.0, 5999.0)
    assert (got["d"]["nulls"], got["d"]["distinct"], got["d"]["lo"], got["d"]["hi"]) == (50, 6003, 0.0, 5999.0)
    assert (got["s"]["nulls"], got["s"]["distinct"], got["s"]["violations"]) == (50, 6003, 150)
    assert (got["e"]["nulls"], got["e"]["distinct"], got["e"]["chunks_read"]) == (6200, 0, 0)
    if dictionary:
        assert 0 < got["i"]["chunks_read"] < got["i"]["chunks"]  # the fallback to plain pages shows


def test_orphan_kinds_and_copies(spark):
    ts = datetime.fromisoformat
    p = spark.createDataFrame([("A", None, ts("2020-01-01")), ("b ", ts("2020-02-01"), ts("2020-01-01")), ("c", None, ts("2020-03-01")), (None, None, ts("2020-01-01"))], "id string, gone timestamp, came timestamp")
    c = spark.createDataFrame([(1, " a", ts("2020-01-05")), (2, "B", ts("2020-01-05")), (3, "c", ts("2020-01-05")), (3, "c", ts("2020-01-05")), (4, "x", ts("2020-01-05")), (5, None, ts("2020-01-05")), (6, "c", ts("2020-04-05"))], "row long, ref string, at timestamp")
    e = {"p": Entity(p, "id", "gone", "came"), "c": Entity(c, "row", None, "at", "ref")}
    got = find_orphans(e, [ForeignKey("c", "ref", "p", "id")])
    assert sorted((r["row"], r["kind"]) for r in got.collect()) == [("2", "deleted"), ("3", "late"), ("4", "missing")]
    assert orphan_report(got).agg(F.sum("rows")).first()[0] == 3
    none = {"p": Entity(p.limit(0), "id"), "c": Entity(c, "row")}
    assert find_orphans(none, [ForeignKey("c", "ref", "p", "id")]).count() == 5
    assert find_orphans({"p": e["p"], "c": Entity(c.limit(0), "row")}, [ForeignKey("c", "ref", "p", "id")]).count() == 0


def test_orphan_cascade_and_cycle(spark):
    a = spark.createDataFrame([("a1",), ("a2",)], "k string")
    b = spark.createDataFrame([("b1", "a1"), ("b2", "nope"), ("b3", "a2")], "k string, a string")
    c = spark.createDataFrame([("c1", "b2"), ("c2", "b1"), ("c3", "b9")], "k string, b string")
    d = spark.createDataFrame([("d1", "c1"), ("d2", "c2"), ("d3", "c3")], "k string, c string")
    e = {n: Entity(x, "k") for n, x in (("a", a), ("b", b), ("c", c), ("d", d))}
    keys = [ForeignKey("b", "a", "a", "k"), ForeignKey("c", "b", "b", "k"), ForeignKey("d", "c", "c", "k")]
    got = sorted((r["table"], r["row"], r["kind"], r["level"]) for r in find_orphans(e, keys).collect())
    assert got == [("b", "b2", "missing", 0), ("c", "c1", "inherited", 1), ("c", "c3", "missing", 0), ("d", "d1", "inherited", 2), ("d", "d3", "inherited", 1)]
    loop = spark.createDataFrame([("x", "gone"), ("y", "x"), ("z", "y"), ("u", "v"), ("v", "u")], "k string, up string")
    got = sorted((r["row"], r["level"]) for r in find_orphans({"t": Entity(loop, "k")}, [ForeignKey("t", "up", "t", "k")]).collect())
    assert got == [("x", 0), ("y", 1), ("z", 2)]


def test_short_source_that_is_mostly_stuck(spark):
    v = [17.0, 17.6, 16.6, 17.1, 16.2, *[15.5] * 8]
    rows = [("a", k, k, float(x), 1, "") for k, x in enumerate(v)]
    assert readings(spark, rows) == {(k, "stuck") for k in range(5, 13)}


def test_profiles_keep_the_callers_filter(spark, tmp_path):
    spark.createDataFrame([(None, 1.0, True)] * 5, "load int, x double, ok boolean").coalesce(1).write.parquet(str(tmp_path / "t"))
    spark.createDataFrame([(1, 2.0, True), (1, None, False), (1, 3.0, None)], "load int, x double, ok boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    r = load_profiles(spark.read.parquet(str(tmp_path / "t")).where("ok"), "load", ["x"]).collect()
    assert [(x["load"], x["rows"], x["nulls"]) for x in r] == [(1, 1, 0)]


def test_footers_decide_what_is_read(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lumenframe.operators import profile

    put = lambda n, load, ok, x, **kw: pq.write_table(pa.table({"load": pa.array(load, pa.int32()), "ok": ok, "x": pa.array(x, pa.float64())}), tmp_path / f"{n}.parquet", **kw)
    put("a", [1] * 6, [True] * 6, [1.0, 2.0, 2.0, None, float("nan"), 3.0])  # one load, all pass: scanned for the distribution
    put("b", [2] * 4, [True] * 4, [None] * 4)  # all NULL: nothing is read
    put("c", [3] * 4, [False] * 4, [1.0] * 4)  # none passes
    put("d", [None] * 4, [True] * 4, [1.0] * 4)  # no load
    put("e", [4] * 5, [True] * 5, [7.0] * 4 + [None])  # one value: the dictionary settles it
    put("f", [1, 2, 5, None], [True, None, True, True], [9.0, 5.0, -1.0, 4.0])  # mixed: read
    df = spark.read.parquet(str(tmp_path))
    got = {r["load"]: (r["rows"], r["nulls"], r["impossible"], r["distinct"], r["lo"], r["hi"], r["chunks"], r["scanned"]) for r in load_profiles(df, "load", ["x"], flag="ok").collect()}
    assert got == {1: (7, 1, 1, 5, 1.0, 9.0, 0, 7), 2: (4, 4, 0, 0, None, None, 1, 0), 4: (5, 1, 0, 1, 7.0, 7.0, 1, 0), 5: (1, 0, 1, 1, -1.0, -1.0, 0, 1)}
    same = {r["load"]: r["rows"] for r in load_profiles(df.where("load <> 1"), "load", ["x"], flag="ok").collect()}
    assert same == {2: 4, 4: 5, 5: 1}
    monkeypatch.setattr(profile, "read_footers", lambda df, columns: spark.createDataFrame([], profile_schema()))
    assert load_profiles(df, "load", ["x"], flag="ok").count() == 0 and profile_columns(df).agg(F.sum("rows")).first()[0] == 0


def profile_schema():
    from lumenframe.sources.footers import FOOTER_SCHEMA

    return FOOTER_SCHEMA


def test_hot_keys_are_met_in_parts(spark, monkeypatch):
    from lumenframe.operators import orphans

    p = spark.createDataFrame([("a",)], "k string")
    c = spark.createDataFrame([(k, "hot" if k % 3 else ("a" if k % 2 else f"x{k}")) for k in range(300)], "row long, ref string")
    e = {"p": Entity(p, "k"), "c": Entity(c, "row")}
    want = {str(k) for k in range(300) if k % 3 or k % 2 == 0}
    for limit in (10**6, 3):
        monkeypatch.setattr(orphans, "BROADCAST_KEYS", limit)
        assert {r["row"] for r in find_orphans(e, [ForeignKey("c", "ref", "p", "k")]).collect()} == want
    rows = [(k, k - 1) for k in range(1, 71)]
    deep = find_orphans({"t": Entity(spark.createDataFrame(rows[:8], "k long, up long"), "k")}, [ForeignKey("t", "up", "t", "k")])
    assert deep.agg(F.max("level")).first()[0] == 7
