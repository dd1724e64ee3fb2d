"""Sliced entity windows equal plain window functions (brute-force check)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators import sequence as seq
from duelframe.operators.hot import CONF
from duelframe.operators.sliced import Feat, sliced_window

FEATS = [
    Feat("sum_pre", "sum", "v"), Feat("mean_pre", "mean", "v"), Feat("mean_post", "mean", "v", None, True),
    Feat("cnt_pre", "count", "v"), Feat("min_post", "min", "r", None, True), Feat("max_pre", "max", "r"),
    Feat("r3_pre", "mean", "v", 3), Feat("r5_post", "mean", "v", 5, True), Feat("s4_pre", "sum", "w", 4),
    Feat("ff", "ffill", "r"), Feat("bf", "bfill", "r"), Feat("rn", "rownum"), Feat("lag_v", "lag", "v"),
]


def plain(df):
    w = seq.entity_window(["e"], ["t", "id"])
    return df.select("id",
                     seq.expanding_sum("v", w).alias("sum_pre"), seq.expanding_mean("v", w).alias("mean_pre"),
                     seq.expanding_mean("v", w, True).alias("mean_post"),
                     F.count("v").over(w.rowsBetween(seq.UP, -1)).alias("cnt_pre"),
                     seq.running_min("r", w).alias("min_post"),
                     F.max("r").over(w.rowsBetween(seq.UP, -1)).alias("max_pre"),
                     seq.rolling_mean("v", w, 3).alias("r3_pre"), seq.rolling_mean("v", w, 5, True).alias("r5_post"),
                     seq.rolling_sum("w", w, 4).alias("s4_pre"),
                     seq.forward_fill("r", w).alias("ff"), seq.backward_fill("r", w).alias("bf"),
                     seq.sequence_number(w).alias("rn"), F.lag("v", 1).over(w).alias("lag_v"))


def same(a, b):
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


@pytest.fixture(params=["10", "200", "2000000"])  # every entity, one entity, none is hot
def hot_rows(request, spark):
    spark.conf.set(CONF, request.param)
    yield int(request.param)
    spark.conf.unset(CONF)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sliced_equals_plain(spark, seed, hot_rows):
    rng = random.Random(seed)
    rows = []
    for i in range(600):
        e = rng.choice(["hot"] * 8 + ["a", "b", "c"])
        v = None if rng.random() < 0.1 else float(rng.randint(0, 50))
        r = None if rng.random() < 0.5 else rng.randint(1, 99)
        rows.append((i, e, rng.randint(0, 120), v, r, rng.randint(0, 3)))
    df = spark.createDataFrame(rows, "id int, e string, t int, v double, r int, w int")
    got = sliced_window(df, ["e"], ["t", "id"], FEATS)
    ref = {r["id"]: r for r in plain(df).collect()}
    n = 0
    for r in got.collect():
        for f in FEATS:
            assert same(r[f.name], ref[r["id"]][f.name]), (f.name, r["id"], r[f.name], ref[r["id"]][f.name])
        n += 1
    assert n == 600


def test_runs_against_a_loop(spark, hot_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot"] * 6 + ["a"]), i % 97, rng.choice([0, 1, 1, 1, None])) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, e string, t int, f int")
    got = {r["id"]: (r["before"], r["upto"]) for r in sliced_window(
        df, ["e"], ["t", "id"], [Feat("before", "run", "f"), Feat("upto", "run", "f", None, True)]).collect()}
    run: dict = {}
    for i, e, _, f in sorted(rows, key=lambda r: (r[2], r[0])):
        before = run.get(e, 0)
        run[e] = before + 1 if f == 1 else 0
        assert got[i] == (before, run[e])


def test_no_job_while_the_plan_is_built(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("e"), F.col("id").alias("t"), F.lit(1.0).alias("v"))
    spark.sparkContext.setJobGroup("plan", "plan")
    sliced_window(df, ["e"], ["t"], [Feat("m", "mean", "v", 5)])
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("plan")
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert not list(jobs)


def test_null_entity_rows_are_kept(spark, hot_rows):
    from duelframe.operators.ordinal import ordinal_within, pair_consecutive
    from duelframe.operators.sequence import dense_rank_of
    rows = [(None if i % 4 == 0 else "a", i % 37, i, float(i % 5), i % 3, 1) for i in range(160)]
    df = spark.createDataFrame(rows, "e string, t int, id int, v double, r int, w int")
    got = sliced_window(df, ["e"], ["t", "id"], FEATS)
    assert got.count() == 160
    ref = {r["id"]: r for r in plain(df).collect()}
    for r in got.collect():
        for f in FEATS:
            assert same(r[f.name], ref[r["id"]][f.name]), f.name
    assert ordinal_within(df, ["e"], ["t", "id"], "pos").count() == 160
    assert pair_consecutive(df, ["e"], ["t", "id"], ["id"]).count() == 80
    assert dense_rank_of(df.withColumn("e", F.lit(None).cast("string")), ["e"], "t", "dr").count() == 160


def test_keys_far_apart_keep_their_order(spark, hot_rows):
    """Keys of 1 to 5 x 10^12 that alternate by day; cuts found beforehand and in the plan."""
    from duelframe.operators.hot import find_cuts
    from duelframe.operators.ordinal import ordinal_within
    rng = random.Random(6)
    rows = [("t", d, rng.choice([1, 2, 3, 4, 5]) * 10 ** 12 + rng.randint(0, 99), float(rng.randint(0, 1))) for d in range(120)]
    rows += [("u", d, 5 * 10 ** 12 - d, 1.0) for d in range(8)]
    df = spark.createDataFrame(rows, "e string, t bigint, id bigint, v double")
    feats = [Feat("before", "sum", "v"), Feat("last3", "mean", "v", 3), Feat("no", "rownum"), Feat("run", "run", "v")]
    exp, seen = {}, {}
    for e, t, i, v in sorted(rows):
        past = seen.setdefault(e, [])
        run = next((n for n, x in enumerate(reversed(past)) if x != 1), len(past))
        exp[e, t] = (sum(past) if past else None, sum(past[-3:]) / 3 if len(past) >= 3 else None, len(past) + 1, run)
        past.append(v)
    for cuts in (None, find_cuts(df, ["e"], ["t", "id"])):
        got = sliced_window(df, ["e"], ["t", "id"], feats, cuts).collect()
        assert {(r["e"], r["t"]): (r["before"], r["last3"], r["no"], r["run"]) for r in got} == exp
        pos = ordinal_within(df, ["e"], ["t", "id"], "pos", cuts).collect()
        assert all(r["pos"] == exp[r["e"], r["t"]][2] - 1 for r in pos)


def test_slices_follow_the_rows(spark):
    from duelframe.operators.hot import find_cuts
    df = spark.range(4000).select(F.lit("a").alias("e"), F.col("id").alias("t"))
    spark.conf.set(CONF, "40")
    try:
        few = find_cuts(df, ["e"], ["t"]).table.first()["_cuts"]
        spark.conf.set(CONF, "400")
        fewer = find_cuts(df, ["e"], ["t"]).table.first()["_cuts"]
    finally:
        spark.conf.unset(CONF)
    assert len(few) == 400 and 20 <= len(fewer) <= 80 and find_cuts(df, ["e"], ["t"]).table is None


@pytest.mark.parametrize("hot", ["700", "2000000"])
def test_backward_fill_reads_no_frame_to_its_end_for_every_row(spark, hot):
    """Such a frame is quadratic in the rows of an entity."""
    rows = spark.range(6000).selectExpr("id % 2 as e", "cast(id as int) as t", "if(id % 1000 >= 998, cast(id as int), null) as v")
    spark.conf.set(CONF, hot)
    try:
        got = sliced_window(rows, ["e"], ["t"], [Feat("bf", "bfill", "v"), Feat("ff", "ffill", "v")])
        assert "unboundedfollowing" not in got._jdf.queryExecution().toString().lower()
        for r in got.collect():
            last = r.t - (r.t - r.e - 998) % 1000  # rows 998 and 999 of each thousand have a value
            assert r.bf == (r.t if last == r.t else last + 1000) and r.ff == (last if last >= 0 else None)
    finally:
        spark.conf.unset(CONF)
