"""The semantic traps of the original pipeline, one small frame each."""

from pyspark.sql import functions as F

from duelframe.operators import sequence as seq
from duelframe.operators.joins import assert_unique
from duelframe.operators.ranks import active_rank, ranked_periods
from duelframe.plans import sports as SP


def test_q2_rank_lookup_is_by_active_list(spark):
    """A team missing from the active list is unranked even if an older
    list had it (not a per-team as-of join)."""
    ranks = spark.createDataFrame([(2025, 10, 1, 3), (2025, 10, 2, 5), (2025, 20, 2, 4)],
                                  "season int, day int, team int, rk int")
    games = spark.createDataFrame([(2025, 15, 1), (2025, 25, 1), (2025, 25, 2)], "season int, d int, team int")
    got = active_rank(games, ranked_periods(ranks, "season", "day", "season"), "season", "team", "d",
                      "rk", "active", ranked_team="team")
    assert sorted((r["d"], r["team"], r["active"]) for r in got.collect()) == [
        (15, 1, 3), (25, 1, None), (25, 2, 4)]


def _wins_frames(spark):
    games = spark.createDataFrame(
        [(g, 2024, d, 7, "c1") for g, d in ((1, 10), (2, 20), (3, 30))]
        + [(4, 2025, 10, 7, "c1"), (5, 2025, 140, 7, "c1")],
        "GameID int, Season int, DayNum int, TeamID int, CoachName string")
    school = spark.createDataFrame([(2025, 7, 140, 2), (1995, 7, 140, 1)],
                                   "Season int, TeamID int, DayNum int, ActiveTourneyWins_School bigint")
    coach = spark.createDataFrame([(2025, "c1", 140, 2)],
                                  "Season int, CoachName string, DayNum int, ActiveTourneyWins_Coach bigint")
    return games, school, coach


def test_q4_backfill_looks_ahead_or_uses_history(spark):
    games, school, coach = _wins_frames(spark)
    nxt = SP.attach_tourney_wins(games, school, coach, backfill="next")
    got = {r["GameID"]: r["ActiveTourneyWins_School"] for r in nxt.collect()}
    assert got == {1: 2, 2: 2, 3: 2, 4: 2, 5: 2}  # the future value leaks backwards
    hist = SP.attach_tourney_wins(games, school, coach, backfill="history", history_seasons=(1989, 2003))
    got = {r["GameID"]: r["ActiveTourneyWins_School"] for r in hist.collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 2}  # only earlier seasons fill the gap


def test_q5_season_best_reads_raw_ranks(spark):
    df = spark.createDataFrame([(2025, 7, d, g, r) for g, (d, r) in enumerate([(1, None), (2, 9), (3, None)])],
                               "Season int, TeamID int, DayNum int, GameID int, ActiveAPRank int")
    w = seq.entity_window(["Season", "TeamID"], ["DayNum", "GameID"])
    best = [r[0] for r in df.select(F.coalesce(seq.running_min("ActiveAPRank", w), F.lit(9999)))
            .orderBy("DayNum").collect()]
    assert best == [9999, 9, 9]  # not min(9999, ...) of the filled column


def test_q7_coach_order(spark):
    """A coach who moved to a smaller team id: team order visits the new
    team's rows first, chronological order does not."""
    games = spark.createDataFrame([(1, 2024, 50, 9, "c"), (2, 2025, 10, 3, "c"), (3, 2025, 20, 3, "c")],
                                  "GameID int, Season int, DayNum int, TeamID int, CoachName string")
    school = spark.createDataFrame([], "Season int, TeamID int, DayNum int, ActiveTourneyWins_School bigint")
    coach = spark.createDataFrame([(2024, "c", 50, 4)],
                                  "Season int, CoachName string, DayNum int, ActiveTourneyWins_Coach bigint")
    chrono = SP.attach_tourney_wins(games, school, coach, backfill="history", coach_order="chronological")
    team = SP.attach_tourney_wins(games, school, coach, backfill="history", coach_order="team")
    c = {r["GameID"]: r["ActiveTourneyWins_Coach"] for r in chrono.collect()}
    t = {r["GameID"]: r["ActiveTourneyWins_Coach"] for r in team.collect()}
    assert c == {1: 4, 2: 4, 3: 4}
    assert t == {1: 4, 2: 0, 3: 0}  # team 3 sorts before team 9: nothing carried yet


def test_q8_winner_id_range_cut(spark, fx):
    g = SP.game_table(fx["regular"], fx["tourney"], fx["conf_games"], fx["team_confs"])
    lo, hi = SP.winner_id_range(g)
    full = SP.mirror_games(g)
    cut = SP.mirror_games(g, id_range=(F.lit(1101), F.lit(1111)))
    assert cut.count() == full.where("TeamID BETWEEN 1101 AND 1111").count() < full.count()
    assert lo is not None and hi is not None


def test_q11_latest_keeps_one_row_on_a_double_day(spark):
    df = spark.createDataFrame([(7, 30, 1, 10.0), (7, 30, 2, 20.0), (7, 20, 3, 5.0)],
                               "TeamID int, DayNum int, GameID int, v double")
    got = seq.latest(df, ["TeamID"], ["DayNum", "GameID"]).collect()
    assert len(got) == 1 and got[0]["GameID"] == 2


def test_q14_unique_dimension_keys(spark):
    dim = spark.createDataFrame([(2025, 1, "a"), (2025, 1, "b"), (2025, 2, "c")],
                                "Season int, TeamID int, ConfAbbrev string")
    dup = assert_unique(dim, ["Season", "TeamID"]).collect()
    assert [(r["Season"], r["TeamID"], r["count"]) for r in dup] == [(2025, 1, 2)]
    assert assert_unique(dim.where("TeamID = 2"), ["Season", "TeamID"]).isEmpty()
