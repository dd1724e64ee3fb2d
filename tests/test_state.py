"""Mergeable states and category codes against plain computation."""

import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import state as S
from duelframe.operators.encode import encode_long, fit_codes
from duelframe.operators.hot import CONF


@pytest.mark.parametrize("listed", [20_000, 8])
def test_states_of_any_cut_merge_to_the_whole(spark, monkeypatch, listed):
    monkeypatch.setattr(S, "LISTED", listed)
    r = random.Random(2)
    rows = [(r.choice(["a"] * 5 + ["b", None]), i, r.choice([None, 1.0, 2.5, 7.0, -3.0]), r.choice([0, 1, 1, 1, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "e string, t int, v double, f int")
    one = S.row_states(df, ["e"], ["t"], ["v"], "f")
    cut = F.col("first.t")
    parts = [S.merge_states(one.where((cut >= a) & (cut < b)), ["e"], ["v"], 4) for a, b in ((0, 40), (40, 41), (41, 250), (250, 300))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    for states in (S.merge_states(one, ["e"], ["v"], 4), S.merge_states(union, ["e"], ["v"], 4)):
        got = {x.e: x for x in S.state_features(states, ["e"], ["v"], 4).collect()}
        for e in ("a", "b", None):
            mine = [x for x in rows if x[0] == e]
            vs = [x[2] for x in mine]
            some, last = [v for v in vs if v is not None], [v for v in vs[-4:] if v is not None]
            run = next((i for i, x in enumerate(reversed(mine)) if x[3] != 1), len(mine))
            g = got[e]
            assert (g["rows"], g["run"], g["min_v"], g["max_v"]) == (len(mine), run, min(some), max(some))
            assert abs(g["mean_v"] - sum(some) / len(some)) < 1e-9
            assert (g["last_v"] is None) == (len(last) < 4) and (len(last) < 4 or abs(g["last_v"] - sum(last) / 4) < 1e-9)
    assert S.merge_states(one.limit(0), ["e"], ["v"], 4).count() == 0


@pytest.mark.parametrize("hot", ["2000000", "5"])
def test_codes(spark, hot):
    spark.conf.set(CONF, hot)
    try:
        df = spark.createDataFrame([(i, f"c{i % 23}", i % 7 if i % 9 else None) for i in range(90)], "id int, a string, b int")
        codes = fit_codes(df.where("id < 60"), ["a", "b"])
        table = {(x.column, x.value): x.code for x in codes.collect()}
        assert sorted(table.values()) == list(range(30))
        assert [k for k, _ in sorted(table.items(), key=lambda kv: kv[1])] == sorted(table)
        extra = df.unionByName(spark.createDataFrame([(99, "new", 3)], "id int, a string, b int"))
        got = {(x.id, x.column): x.code for x in encode_long(extra, ["id"], ["a", "b"], codes).collect()}
        assert (99, "a") not in got and got[99, "b"] == table["b", "3"]
        assert all(got.get((x.id, "b")) == (None if x.b is None else table["b", str(x.b)]) for x in df.collect())
    finally:
        spark.conf.unset(CONF)
