"""The sports pipeline on generated inputs: invariants and the traps."""

import math

import pytest
from pyspark.sql import functions as F

from duelframe.plans import sports as SP
from sports_fixture import SHORT_TEAM


@pytest.fixture(scope="module")
def stages(fx):
    g = SP.game_table(fx["regular"], fx["tourney"], fx["conf_games"], fx["team_confs"]).cache()
    tg = SP.team_games(fx["regular"], fx["tourney"], fx["compact"], fx["conf_games"], fx["team_confs"],
                       fx["coaches"], fx["seeds"], fx["systems"]).cache()
    md = SP.model_features(tg).cache()
    return g, tg, md


def test_game_table(stages, fx):
    g, _, _ = stages
    n = fx["regular"].count() + fx["tourney"].count()
    assert g.count() == n
    ids = [r[0] for r in g.select("GameID").orderBy("GameID").collect()]
    assert ids == list(range(n))
    assert g.where("ConfTourneyFlag = 1").count() == fx["conf_games"].count()
    assert g.where("WConf IS NULL OR LConf IS NULL").count() == 0


def test_mirror_columns_and_counts(stages):
    g, _, _ = stages
    m = SP.mirror_games(g)
    assert m.columns == SP.MIRRORED_COLUMNS and len(m.columns) == 40
    assert m.count() == 2 * g.count()
    r = m.agg(F.sum("WinFlag"), F.sum("LoseFlag")).first()
    assert r[0] == r[1] == g.count()


def test_interval_join_drops_uncovered_day(stages, fx):
    g, tg, _ = stages
    # team 1103 has no coach on day 70 of 2024
    assert tg.where("TeamID = 1103 AND Season = 2024 AND DayNum = 70").count() == 0
    assert tg.count() == 2 * g.count() - g.where(
        "Season = 2024 AND DayNum = 70 AND (WTeamID = 1103 OR LTeamID = 1103)").count()


def test_zero_attempts(stages, fx):
    g, _, _ = stages
    m = SP.mirror_games(g)
    skip = SP.derived_columns(m, "skip").where("FreeThrowAttempts = 0").select("FreeThrowPct").collect()
    nan = SP.derived_columns(m, "nan").where("FreeThrowAttempts = 0").select("FreeThrowPct").collect()
    assert skip and all(r[0] is None for r in skip)
    assert all(math.isnan(r[0]) for r in nan)


def test_seeds_and_ranks(stages):
    _, tg, md = stages
    seeds = {r[0] for r in tg.where("NCAATourneyFlag = 1").select("NCAATourneySeed").collect()}
    assert 16 in seeds and None not in seeds
    assert tg.where("NCAATourneyFlag = 0 AND NCAATourneySeed IS NOT NULL").count() == 0
    # team 1105 is never in the AP list: unranked everywhere after the fill
    assert {r[0] for r in md.where("TeamID = 1105").select("ActiveAPRank").collect()} == {SP.UNRANKED}
    # AP ranks are not carried after a season's last list expires (file
    # scope); only the final season's last list stays active to day 200
    assert tg.where("Season < 2025 AND DayNum > 120 AND ActiveAPRank IS NOT NULL").count() == 0
    assert tg.where("Season = 2025 AND DayNum > 120 AND ActiveAPRank IS NOT NULL").count() > 0


def test_model_features(stages):
    _, tg, md = stages
    assert md.columns == SP.MODEL_COLUMNS + ["GameNumber"]
    assert md.where("GameNumber <= 5").count() == 0
    assert md.where(f"TeamID = {SHORT_TEAM}").count() == 0
    num = [f.name for f in md.schema.fields if f.dataType.typeName() in ("double", "integer", "long")]
    nulls = md.select([F.sum(F.when(F.col(c).isNull() | F.isnan(c), 1).otherwise(0)).alias(c)
                       for c in num]).first()
    assert all(v == 0 for v in nulls)


def test_features_are_leak_free(stages, fx):
    """Changing a team's later games must not change earlier pre-game features."""
    _, tg, _ = stages
    team, season, cut = 1101, 2024, 70
    base = SP.with_features(tg).where(f"TeamID = {team} AND Season = {season} AND DayNum <= {cut}")
    bumped_tg = tg.withColumn("PointsScored", F.when(F.col("DayNum") > cut, F.col("PointsScored") + 50)
                              .otherwise(F.col("PointsScored")))
    bumped = SP.with_features(bumped_tg).where(f"TeamID = {team} AND Season = {season} AND DayNum <= {cut}")
    cols = ["GameID", "PointsScoredAvg_Overall", "PointsScoredAvg_Last5"]
    assert sorted(base.select(cols).collect()) == sorted(bumped.select(cols).collect())
    # pre-game value at game i is the post-game value at game i-1
    pre = SP.with_features(tg).where(f"TeamID = {team} AND Season = {season}").orderBy("DayNum") \
        .select("PointsScoredAvg_Overall").collect()
    post = SP.with_features(tg, include_current=True).where(f"TeamID = {team} AND Season = {season}") \
        .orderBy("DayNum").select("PointsScoredAvg_Overall").collect()
    assert pre[0][0] is None
    assert all(math.isclose(pre[i][0], post[i - 1][0]) for i in range(1, len(pre)))


def test_final_pairs(stages):
    _, _, md = stages
    fp = SP.final_pairs(md)
    assert len(fp.columns) == 77
    assert "WinFlag_A" in fp.columns and "WinFlag_B" not in fp.columns
    assert fp.where("GameLocation_A = 'H'").count() == 0  # side A is never the home team
    assert fp.where("GameLocation_A = 'A' AND GameLocation_B <> 'H'").count() == 0


def test_tourney_wins_lag_the_last_win(spark, fx):
    hist = SP.tourney_history(fx["compact"], fx["coaches"])
    sw = SP.school_wins(hist)
    first = sw.groupBy("TeamID").agg(F.min(F.struct("Season", "DayNum", "ActiveTourneyWins_School")).alias("f"))
    assert {r["f"]["ActiveTourneyWins_School"] for r in first.collect()} == {0}
    total = hist.groupBy("TeamID").agg(F.sum("TourneyWinFlag").alias("w"),
                                       F.max(F.struct("Season", "DayNum", "TourneyWinFlag")).alias("last"))
    last_in = sw.groupBy("TeamID").agg(F.max(F.struct("Season", "DayNum", "ActiveTourneyWins_School")).alias("l"))
    j = {r["TeamID"]: r["w"] - r["last"]["TourneyWinFlag"] for r in total.collect()}
    assert j == {r["TeamID"]: r["l"]["ActiveTourneyWins_School"] for r in last_in.collect()}


def test_serving_state_one_row_per_team(stages):
    _, tg, _ = stages
    st = SP.serving_state(tg.where("Season = 2025"))
    assert st.count() == st.select("TeamID").distinct().count() == 12


def test_split_rankings(spark, fx, tmp_path):
    root = str(tmp_path / "rankings")
    SP.split_rankings(fx["ordinals"], root)
    from duelframe.sources.files import read_partition
    ap = read_partition(spark, root, "System", "AP", fmt="csv")
    assert ap.count() == fx["systems"]["AP"].count()
    assert set(ap.columns) >= {"Season", "RankingDayNum", "SystemName", "TeamID", "OrdinalRank"}


def test_features_agree_with_hot_team_seasons(stages, spark):
    from duelframe.operators.hot import CONF
    _, tg, md = stages
    spark.conf.set(CONF, "8")
    hot = SP.model_features(tg)
    spark.conf.unset(CONF)
    cols = SP.MODEL_COLUMNS + ["GameNumber"]
    def norm(r):
        return tuple(round(v, 9) if isinstance(v, float) else v for v in r)
    assert sorted(norm(r) for r in md.select(cols).collect()) == sorted(norm(r) for r in hot.select(cols).collect())


def test_pairs_of_a_team_with_two_coaches(stages):
    """Overlapping tenures repeat a participant row: both copies meet the opponent,
    never each other, exactly as in the join of side 1 with side 2."""
    from duelframe.operators.pairing import assign_sides, pair_sides, pair_sides_join
    _, tg, _ = stages
    rows = tg.select("GameID", "Season", "DayNum", "GameLocation", "TeamID", "CoachName", "WinFlag")
    twice = rows.where("TeamID = 1101").withColumn("CoachName", F.lit("second"))
    lone = rows.where("TeamID = 1102").limit(1).withColumns({"GameID": F.lit(10 ** 9).cast("bigint")})
    df = rows.union(twice).union(lone).union(lone)
    got = pair_sides(df, ["GameID"], "GameLocation", "TeamID", shared=["Season", "DayNum"])
    ref = pair_sides_join(assign_sides(df, ["GameID"], "GameLocation", "TeamID"), ["GameID"], shared=["Season", "DayNum"])
    assert got.where("TeamID_A = TeamID_B").count() == 0
    assert sorted(map(str, got.select(ref.columns).collect())) == sorted(map(str, ref.collect()))
    assert got.where(f"GameID = {10 ** 9}").count() == 0
