"""Selection by narrowing against sorting."""

import random

import pytest
from pyspark.sql import functions as F

from duelframe.operators.select import kth_values
from duelframe.operators.split import hash_order, stratified_split
from duelframe.operators.stats import exact_medians


@pytest.mark.parametrize("grid, exact", [(50, 20), (8, 3), (1000, 10_000)])
def test_kth_values(spark, grid, exact):
    r = random.Random(grid)
    groups = {"ties": [float(r.choice([1, 2, 3])) for _ in range(700)], "spread": [r.lognormvariate(0, 40) for _ in range(900)],
              "same": [5.0] * 400, "one": [-2.0], "mixed": [float(r.choice([0, r.random(), -1])) for _ in range(800)]}
    rows = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("ties", None)], "g string, v double")
    ranks = [(g, len(vs), k) for g, vs in groups.items() for k in {1, len(vs), (len(vs) + 1) // 2, max(1, len(vs) // 7)}]
    got = kth_values(rows, ["g"], "v", spark.createDataFrame(ranks, "g string, n long, k long"), grid, exact).collect()
    assert len(got) == len(ranks)
    for row in got:
        vs = sorted(groups[row.g])
        assert row.value == vs[row.k - 1] and row.less == sum(v < row.value for v in vs), row


def test_split_with_null_and_repeated_keys(spark):
    rows = [(None if i % 5 == 0 else "a", None if i % 3 == 0 else i % 40, i) for i in range(300)] + [("b", 1, 300)]
    df = spark.createDataFrame(rows, "s string, k int, id int")
    got = stratified_split(df, "s", "k").collect()
    assert sorted(x.id for x in got) == list(range(301))
    for s in (None, "a", "b"):
        some = sorted((x for x in got if x.s == s), key=lambda x: -x.is_train)
        assert sum(x.is_train for x in some) == len(some) * 7 // 10
    hashes = {x.id: x.h for x in df.select("id", hash_order("k").alias("h")).collect()}
    train = [hashes[x.id] or "" for x in got if x.s == "a" and x.is_train]
    test = [hashes[x.id] or "" for x in got if x.s == "a" and not x.is_train]
    assert max(train) <= min(test)


def test_rows_are_not_shuffled(spark):
    """A column of a million values: the medians' stages write sketches and counts alone."""
    df = spark.range(200_000).select((F.col("id") * 7919 % 200_003).cast("double").alias("x"))
    assert exact_medians(df, ["x"]).first()["median"] == df.agg(F.median("x")).first()[0]
