"""CSV with declared schemas (CRLF and LF), partitioned sinks, pruned reads."""

import pytest
from pyspark.sql import functions as F

from duelframe.sources import schemas as S
from duelframe.sources.files import (read_csv, read_partition, season_slice, write_csv,
                                     write_parquet, write_partitioned)


def test_csv_crlf_and_lf(spark, tmp_path):
    crlf = tmp_path / "teams.csv"
    crlf.write_bytes(b"TeamID,TeamName,FirstD1Season,LastD1Season\r\n1101,Abilene Chr,2014,2025\r\n"
                     b"1102,Air Force,1985,2025\r\n")
    lf = tmp_path / "ranks.csv"
    lf.write_bytes(b"Season,RankingDayNum,SystemName,TeamID,OrdinalRank\n2025,30,AP,1101,4\n"
                   b"2025,37,AP,1102,9\n")
    teams = read_csv(spark, str(crlf), S.TEAMS)
    assert teams.schema == S.TEAMS
    assert [tuple(r) for r in teams.orderBy("TeamID").collect()] == [
        (1101, "Abilene Chr", 2014, 2025), (1102, "Air Force", 1985, 2025)]
    ranks = read_csv(spark, str(lf), S.ORDINALS)
    assert ranks.agg(F.sum("OrdinalRank")).first()[0] == 13


def test_csv_fails_fast_on_bad_rows(spark, tmp_path):
    bad = tmp_path / "bad.csv"
    bad.write_text("Season,Seed,TeamID\n2025,W01,notanumber\n")
    with pytest.raises(Exception):
        read_csv(spark, str(bad), S.TOURNEY_SEEDS).collect()


def test_partitioned_parquet_and_pruned_slice(spark, tmp_path):
    df = spark.createDataFrame([(s, t, t * 10) for s in (2023, 2024, 2025) for t in range(5)],
                               "Season int, TeamID int, v int")
    out = str(tmp_path / "by_season")
    write_parquet(df, out, partition_by=["Season"])
    one = season_slice(spark.read.parquet(out), "Season", 2025)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(Season" in plan and "(Season#" in plan
    assert one.count() == 5
    csv_out = str(tmp_path / "csv")
    write_csv(df, csv_out)
    assert spark.read.option("header", True).csv(csv_out).count() == 15


def test_split_keeps_key_and_spreads_hot_key(spark, tmp_path):
    rows = [("hot" if i % 3 else f"k{i % 7}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "sys string, x int")
    root = str(tmp_path / "split")
    # AQE would merge these tiny partitions; large hot-key partitions stay apart
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_partitioned(df, "sys", root, key_copy="part", spread=4)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    hot = read_partition(spark, root, "part", "hot")
    assert hot.count() == sum(1 for r in rows if r[0] == "hot")
    assert set(hot.columns) == {"sys", "x", "part"}
    files = [f for f in (tmp_path / "split" / "part=hot").iterdir() if f.name.endswith(".parquet")]
    assert 1 < len(files) <= 4  # the hot key was written by several tasks


def test_files_follow_the_sizes(spark, tmp_path):
    rows = [("big", i, "x" * 20) for i in range(9000)] + [(f"k{i % 40}", i, "y" * 20) for i in range(960)] + [(None, 1, "z")] * 40
    df = spark.createDataFrame(rows, "sys string, x int, t string")
    root = str(tmp_path / "split")
    write_partitioned(df, "sys", root, key_copy="part", file_bytes=31 * 900)
    files = {f.name: len(list(f.glob("*.parquet"))) for f in (tmp_path / "split").iterdir() if f.is_dir()}
    assert 9 <= files["part=big"] <= 11 and all(files[f"part=k{i}"] == 1 for i in range(40)) and len(files) == 42
    back = spark.read.parquet(root)
    assert sorted(map(repr, back.select("sys", "x", "t").collect())) == sorted(map(repr, df.collect()))
    tasks = {f.name.split("-")[1] for f in (tmp_path / "split").rglob("*.parquet") if "part=big" not in str(f)}
    assert len(tasks) <= 4  # small keys share tasks
    write_partitioned(df, "sys", root + "c", key_copy="part", fmt="csv")
    one = read_partition(spark, root + "c", "part", "k3", "csv", df.schema)
    assert one.schema["x"].dataType.typeName() == "integer" and one.count() == 24
    write_partitioned(df.limit(0), "sys", root + "e", key_copy="part")


def test_scale_conf_sizes_partitions():
    from duelframe.session import scale_conf
    big = scale_conf(100 * 2**40, executor_cores=8000)
    assert int(big["spark.sql.shuffle.partitions"]) == 409600  # ~256 MB each
    small = scale_conf(10 * 2**20, executor_cores=8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16    # two waves of the cores
    assert big["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == big["spark.sql.shuffle.partitions"]


def test_apply_scale_keeps_launch_settings(spark):
    from duelframe.session import apply_scale, scale_conf
    keys = list(scale_conf(1).keys())
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        done = apply_scale(spark, 10 * 2**30, executor_cores=8)
        # the test session was launched with 8 shuffle partitions: that wins
        assert "spark.sql.shuffle.partitions" not in done
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == str(512 * 1024 * 1024)
        assert done["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] == "40"
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
