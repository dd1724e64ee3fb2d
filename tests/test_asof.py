"""Interval joins by union and carry against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import asof
from duelframe.operators.hot import CONF


@pytest.fixture(params=["2000000", "12"])  # no key is hot, most are
def hot(request, spark):
    spark.conf.set(CONF, request.param)
    yield
    spark.conf.unset(CONF)


def tables(spark, overlap, seed):
    r = random.Random(seed)
    points = [(i, r.choice(["a"] * 6 + ["b", "c", None]), r.choice([None] + list(range(-20, 60)) * 3)) for i in range(300)]
    points += points[:20]
    intervals, at = [], {}
    for i in range(60):
        k = r.choice("abd")
        if overlap:
            s = r.randrange(-25, 60)
            intervals.append((k, s, s + r.choice([0, 1, 3, 9, 40, 2 ** 31]), f"m{i}"))
        else:
            s = at.get(k, -25) + r.choice([0, 1, 4])
            e = s + r.choice([-1, 0, 2, 5])
            at[k] = max(e, s) + 1
            intervals.append((k, s, e, f"m{i}"))
    intervals += [(None, 0, 9, "x"), ("a", None, 5, "x"), ("a", 5, None, "x"), ("a", 9, 3, "x")]
    return points, intervals


@pytest.mark.parametrize("overlap", [False, True])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_against_all_pairs(spark, hot, overlap, how):
    points, intervals = tables(spark, overlap, 7 + overlap)
    p = spark.createDataFrame(points, "id int, k string, d int")
    iv = spark.createDataFrame(intervals, "key string, lo bigint, hi bigint, who string")
    got = sorted(map(tuple, asof.asof_join(p, iv, ["k"], "d", "lo", "hi", how, ["key"], disjoint=not overlap).collect()), key=repr)
    exp = []
    for row in points:
        found = [x[1:] for x in intervals if None not in (*x, *row) and x[0] == row[1] and x[1] <= row[2] <= x[2]]
        if how in ("inner", "left"):
            exp += [(*row, *x) for x in found] or ([(*row, None, None, None)] if how == "left" else [])
        elif bool(found) == (how == "left_semi"):
            exp.append(row)
    assert got == sorted(exp, key=repr)


def test_two_keys_dates_and_repeated_intervals(spark, hot):
    p = spark.sql("select * from values (1, 'a', date'2024-01-05'), (1, 'a', date'2024-02-05'), (2, 'a', date'2024-01-05') t(s, k, d)")
    iv = spark.sql("select * from values (1, 'a', date'2024-01-01', date'2024-01-05', 'x'), (1, 'a', date'2024-01-01', date'2024-01-05', 'x'),"
                   "(1, 'a', date'2024-01-05', date'2024-01-31', 'y') t(s, k, lo, hi, v)")
    got = asof.asof_join(p, iv, ["s", "k"], "d", "lo", "hi").select("s", "v").collect()
    assert sorted(map(tuple, got)) == [(1, "x"), (1, "x"), (1, "y")]
    with pytest.raises(TypeError):
        asof.asof_join(p.withColumn("d", F.lit(0.5)), iv, ["s"], "d", "lo", "hi")


def test_no_range_condition_in_the_plan(spark):
    p = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    iv = spark.range(9).select((F.col("id") % 3).alias("k"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 5).alias("hi"))
    plan = asof.asof_join(p, iv, ["k"], "id", "lo", "hi", disjoint=True)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
