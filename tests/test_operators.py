"""Operators on hand-made frames, checked against brute force in Python."""

import math
import random
import statistics

from pyspark.sql import Window
from pyspark.sql import functions as F

from duelframe.functions.scalar import (code_number, day_range, fill_numeric, nan_ratio,
                                        safe_ratio)
from duelframe.operators import sequence as seq
from duelframe.operators.joins import band_lookup, dim_lookup, interval_join, mark_join
from duelframe.operators.mirror import mirror
from duelframe.operators.ordinal import ordinal_within
from duelframe.operators.pairing import assign_sides, pair_sides, pair_sides_join
from duelframe.operators.ranks import rank_periods
from duelframe.operators.split import stratified_split
from duelframe.operators.stats import exact_medians, mean_std


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def seq_frame(spark):
    # one entity, values with a null in the middle
    data = [("t", d, v) for d, v in [(1, 10.0), (2, 20.0), (3, None), (4, 40.0), (5, 50.0),
                                     (6, 60.0), (7, 70.0), (8, 80.0)]]
    return spark.createDataFrame(data, "k string, d int, v double")


def test_expanding_and_rolling(spark):
    df = seq_frame(spark)
    w = seq.entity_window(["k"], ["d"])
    out = df.select("d", seq.expanding_mean("v", w).alias("pre"),
                    seq.expanding_mean("v", w, True).alias("post"),
                    seq.rolling_mean("v", w, 3).alias("r3"),
                    seq.rolling_sum("v", w, 2, True).alias("s2"),
                    seq.exclusive_running_sum(F.coalesce("v", F.lit(0.0)), w).alias("ex"))
    got = {r["d"]: r for r in out.collect()}
    assert got[1]["pre"] is None and got[1]["ex"] == 0.0
    assert got[2]["pre"] == 10.0 and got[3]["pre"] == 15.0
    # pre-game value at row i equals post-game value at row i-1
    for d in range(2, 9):
        assert got[d]["pre"] == got[d - 1]["post"]
    # a full frame of 3 non-null values is needed
    assert got[4]["r3"] is None and got[5]["r3"] is None and got[6]["r3"] is None
    assert got[7]["r3"] == 50.0
    assert got[4]["s2"] is None and got[5]["s2"] == 90.0


def test_fills_and_running_min(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 3, None), ("a", 4, 3),
                                ("a", 5, None), ("b", 1, None)], "k string, d int, r int")
    w = seq.entity_window(["k"], ["d"])
    out = rows(df.select("k", "d", seq.forward_fill("r", w).alias("ff"),
                         seq.backward_fill("r", w).alias("bf"),
                         seq.running_min("r", w).alias("best")), "k", "d")
    assert [r[2] for r in out] == [None, 5, 5, 3, 3, None]
    assert [r[3] for r in out] == [5, 5, 3, 3, None, None]
    assert [r[4] for r in out] == [None, 5, 5, 3, 3, None]


def test_win_share_and_streak(spark):
    wins = [1, 1, 0, 1, 1, 1, 0, 0, 1]
    df = spark.createDataFrame([("t", i, x) for i, x in enumerate(wins)], "k string, d int, win int")
    w = seq.entity_window(["k"], ["d"])
    out = df.select("d", seq.ratio_of_sums("win", 1 - F.col("win"), w).alias("pct"))
    got = {r["d"]: r["pct"] for r in out.collect()}
    assert got[0] is None
    for i in range(1, len(wins)):
        assert math.isclose(got[i], sum(wins[:i]) / i)
    st = {r["d"]: r["s"] for r in seq.with_streak(df, ["k"], ["d"], "win", "s").collect()}
    expect, run = [], 0
    for x in wins:
        expect.append(run)
        run = run + 1 if x == 1 else 0
    assert [st[i] for i in range(len(wins))] == expect


def test_ordinal_within_matches_row_number(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), rng.randint(0, 500), i) for i in range(2000)]
    df = spark.createDataFrame(data, "g string, t int, id int")
    got = ordinal_within(df, ["g"], ["t", "id"], "pos")
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("t", "id")) - 1)
    assert rows(got.select("g", "id", "pos"), "g", "id") == rows(ref.select("g", "id", "pos"), "g", "id")
    glob = ordinal_within(df, [], ["t", "id"], "pos")
    ref2 = df.withColumn("pos", F.row_number().over(Window.orderBy("t", "id")) - 1)
    assert rows(glob.select("id", "pos"), "id") == rows(ref2.select("id", "pos"), "id")


def test_exact_medians_and_scaler(spark):
    rng = random.Random(3)
    xs = [rng.choice([1.0, 2.0, 2.0, 5.0]) * rng.randint(1, 40) for _ in range(301)]
    ys = [float(rng.randint(0, 9)) for _ in range(300)] + [None]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y double")
    med = {r["column"]: r["median"] for r in exact_medians(df, ["x", "y"], buckets=7).collect()}
    assert med["x"] == statistics.median(xs)
    assert med["y"] == statistics.median([y for y in ys if y is not None])
    ms = {r["column"]: (r["mean"], r["std"]) for r in mean_std(df, ["x"]).collect()}
    assert math.isclose(ms["x"][1], statistics.pstdev(xs), rel_tol=1e-9)


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 0.0), (-1.0, 0.0), (1.0, 4.0), (None, 1.0)],
                               "a double, b double")
    got = df.select(safe_ratio("a", "b").alias("s"), nan_ratio("a", "b").alias("n")).collect()
    assert [r["s"] for r in got] == [None, None, None, 0.25, None]
    n = [r["n"] for r in got]
    assert math.isnan(n[0]) and n[1] == math.inf and n[2] == -math.inf and n[3] == 0.25 and n[4] is None
    seeds = spark.createDataFrame([("W16a",), ("X01",), ("Z11b",)], "s string")
    assert [r[0] for r in seeds.select(code_number("s")).collect()] == [16, 1, 11]
    rng_df = spark.createDataFrame([(3, 5), (5, 3), (4, 4)], "a int, b int")
    assert [r[0] for r in rng_df.select(day_range("a", "b")).collect()] == [[3, 4, 5], [], [4]]
    filled = fill_numeric(spark.createDataFrame([(float("nan"), None, None)], "x double, y int, z string"))
    assert tuple(filled.first()) == (0.0, 0, None)


def test_mirror_and_pairing(spark):
    g = spark.createDataFrame([(1, 10, 20, 80, 70, "H"), (2, 20, 30, 60, 50, "A"),
                               (3, 30, 10, 90, 40, "N")],
                              "gid int, w int, l int, ws int, ls int, wloc string")
    m = mirror(g, ["gid"], {"team": ("w", "l"), "pts": ("ws", "ls"), "opp_pts": ("ls", "ws")},
               loc=("wloc", "loc"))
    assert m.count() == 6
    got = {(r["gid"], r["team"]): (r["loc"], r["win"], r["pts"], r["opp_pts"]) for r in m.collect()}
    assert got[(1, 10)] == ("H", 1, 80, 70) and got[(1, 20)] == ("A", 0, 70, 80)
    assert got[(3, 30)][0] == "N" and got[(3, 10)][0] == "N"
    # side A is the away team, or the smaller id as a string on neutral courts
    lead = pair_sides(m, ["gid"], "loc", "team")
    join = pair_sides_join(assign_sides(m, ["gid"], "loc", "team"), ["gid"])
    a = {r["gid"]: r["team_A"] for r in lead.collect()}
    assert a == {1: 20, 2: 20, 3: 10}
    assert sorted(lead.columns) == sorted(join.columns)
    assert rows(lead.select(sorted(lead.columns)), "gid") == rows(join.select(sorted(join.columns)), "gid")


def test_joins(spark):
    games = spark.createDataFrame([(1, 5, 7), (2, 5, 8), (3, 6, 7)], "g int, a int, day int")
    marks = spark.createDataFrame([(5, 7), (5, 7), (6, 1)], "a int, day int")
    mj = {r["g"]: r["m"] for r in mark_join(games, marks, ["a", "day"], "m").collect()}
    assert mj == {1: 1, 2: 0, 3: 0}  # duplicated mark keys do not multiply rows
    dim = spark.createDataFrame([(5, "x"), (6, "y")], "id int, name string")
    dl = dim_lookup(games, dim, ["a"], ["id"], {"name": "a_name"})
    assert {r["g"]: r["a_name"] for r in dl.collect()} == {1: "x", 2: "x", 3: "y"}
    iv = spark.createDataFrame([(5, 0, 7, "p"), (5, 7, 9, "q"), (6, 8, 9, "r")],
                               "a int, lo int, hi int, who string")
    inner = interval_join(games, iv, ["a"], "day", "lo", "hi", "inner")
    assert sorted((r["g"], r["who"]) for r in inner.collect()) == [(1, "p"), (1, "q"), (2, "q")]
    semi = interval_join(games, iv, ["a"], "day", "lo", "hi", "left_semi")
    assert sorted(r["g"] for r in semi.collect()) == [1, 2]
    bands = spark.createDataFrame([("H", 1, 30, "q1"), ("H", 31, None, "q2")],
                                  "k string, lo int, hi int, band string")
    x = spark.createDataFrame([("H", 3), ("H", 99), ("A", 3)], "k string, r int")
    got = sorted((r["r"], r["k"], r["band"]) for r in band_lookup(x, bands, "k", "r", "k", "lo", "hi", "band").collect())
    assert got == [(3, "A", None), (3, "H", "q1"), (99, "H", "q2")]


def _pubs(spark, days):
    return spark.createDataFrame([(s, d) for s, ds in days.items() for d in ds], "season int, day int")


def test_rank_periods_goldens(spark):
    # publication days of one ranking system over two seasons
    rag = _pubs(spark, {2004: [37, 43], 2005: [49, 56]})
    f = rows(rank_periods(rag, "season", "day", "file"), "season", "period_start")
    assert f == [(2004, 37, 42), (2004, 43, 48), (2005, 49, 55), (2005, 56, 200)]
    s = rows(rank_periods(rag, "season", "day", "season"), "season", "period_start")
    assert s == [(2004, 37, 42), (2004, 43, 200), (2005, 49, 55), (2005, 56, 200)]
    oct_ = _pubs(spark, {2017: [107, 121, 133]})
    assert rows(rank_periods(oct_, "season", "day", "file"), "period_start") == [
        (2017, 107, 120), (2017, 121, 132), (2017, 133, 200)]
    # a season's last list expires before the next season starts (empty period)
    trx = _pubs(spark, {2006: [58, 121, 133], 2009: [58, 133], 2010: [44, 133]})
    last = {r[0]: r[2] for r in rank_periods(trx, "season", "day", "file").collect() if r[1] == 133}
    assert last == {2006: 57, 2009: 43, 2010: 200}


def test_stratified_split_exact(spark):
    data = [(i, "a" if i % 3 else "b") for i in range(1000)]
    df = spark.createDataFrame(data, "k int, s string")
    out = stratified_split(df, "s", "k")
    n = {r["s"]: (r["t"], r["n"]) for r in out.groupBy("s").agg(F.sum("is_train").alias("t"),
                                                                F.count("*").alias("n")).collect()}
    for t, total in n.values():
        assert t == (total * 7) // 10
    again = stratified_split(df.repartition(7), "s", "k")
    assert rows(out, "k") == rows(again.select(out.columns), "k")  # independent of partitioning


def test_pairs_and_positions_with_hot_groups(spark):
    from duelframe.operators.hot import CONF
    from duelframe.operators.ordinal import pair_consecutive
    rng = random.Random(5)
    data = [(rng.choice("xyz"), rng.randint(0, 300), i, rng.randint(0, 9)) for i in range(900)]
    df = spark.createDataFrame(data, "g string, t int, id int, u int")
    a = rows(pair_consecutive(df, ["g"], ["t", "id"], ["id", "u"]), "g", "a_id")
    c = rows(ordinal_within(df, ["g"], ["t", "id"], "pos").select("id", "pos"), "id")
    spark.conf.set(CONF, "20")
    try:
        assert a == rows(pair_consecutive(df, ["g"], ["t", "id"], ["id", "u"]), "g", "a_id")
        assert c == rows(ordinal_within(df, ["g"], ["t", "id"], "pos").select("id", "pos"), "id")
    finally:
        spark.conf.unset(CONF)
    assert len(a) == sum(n // 2 for n in [sum(1 for r in data if r[0] == g) for g in "xyz"])
