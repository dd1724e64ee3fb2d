"""Give the driver's ``events`` log the two-sided shape the pipeline needs.

- ``contest``: consecutive events of one type form a game (positions
  0-1, 2-3, ... in ``(ts, event_id)`` order); the higher value wins.
  The event type plays the role of the season / league.
- ``team_game``: the mirror of ``contest``, one row per participant.
- ``tenure``: a manager validity table per team (interval dimension).
- ``publication``: a ranking list of all teams, published every week.

Scale notes. An event type that holds a third of the log is numbered by many
tasks, and pairs come out of the same single shuffle (``pair_consecutive``):
partners inside a slice are read with ``lead``, pairs that straddle two
slices are formed from the per-slice summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.mirror import mirror
from duelframe.operators.hot import Cuts, find_cuts, hot_rows
from duelframe.operators.ordinal import ordinal_within, pair_consecutive

# Fixed values of the contest view.
LOCATION_BY_KEY_MOD5 = {0: "N", 4: "A"}  # any other remainder: "H"
FIRST_DAY = "2024-01-01"  # day 0 of the calendar; other years count on from it
WEEK = 7  # days between two publications
OPEN_DAY = 2_147_483_647  # last day of a tenure that has not ended


def day_index(ts: str) -> F.Column:
    """Days since ``FIRST_DAY``, the integer day offset the pipeline uses."""
    return F.date_diff(F.to_date(F.col(ts)), F.lit(FIRST_DAY).cast("date")).cast("bigint")


def contest(events: DataFrame) -> DataFrame:
    ev = events.select("event_type", "ts", "event_id", "user_id", "value")
    group, order = ["event_type"], ["ts", "event_id"]
    pairs = pair_consecutive(ev, group, order, ["user_id", "value", "event_id", "ts"], find_cuts(ev, group, order))
    a_wins = F.col("a_value") > F.col("b_value")
    key = F.col("b_event_id")
    loc = (F.when(key % 5 == 0, F.lit(LOCATION_BY_KEY_MOD5[0]))
            .when(key % 5 == 4, F.lit(LOCATION_BY_KEY_MOD5[4]))
            .otherwise(F.lit("H")))
    return (pairs.where((F.col("a_user_id") != F.col("b_user_id")) & (F.col("a_value") != F.col("b_value")))
            .select(F.col("event_type").alias("league"),
                    key.alias("game_key"),
                    day_index("b_ts").alias("day_num"),
                    F.when(a_wins, F.col("a_user_id")).otherwise(F.col("b_user_id")).alias("w_id"),
                    F.when(a_wins, F.col("b_user_id")).otherwise(F.col("a_user_id")).alias("l_id"),
                    F.greatest("a_value", "b_value").alias("w_score"),
                    F.least("a_value", "b_value").alias("l_score"),
                    loc.alias("w_loc")))


def team_game(games: DataFrame) -> DataFrame:
    """One row per team and game (the mirrored contest)."""
    return mirror(games, ["league", "game_key", "day_num"],
                  {"team_id": ("w_id", "l_id"), "opp_id": ("l_id", "w_id"),
                   "points": ("w_score", "l_score"), "allowed": ("l_score", "w_score")},
                  loc=("w_loc", "loc"), win_col="win")


def tenure(events: DataFrame) -> DataFrame:
    """Manager validity per team; every third team has an uncovered day 15
    and a second manager from day 16."""
    teams = events.select(F.col("user_id").alias("team_id")).distinct()
    third = (F.col("team_id") % 3) == 0
    first = teams.select("team_id",
                         F.concat(F.lit("M"), (F.col("team_id") % 20).cast("string")).alias("manager"),
                         F.lit(0).alias("first_day"),
                         F.when(third, F.lit(14)).otherwise(F.lit(OPEN_DAY)).alias("last_day"))
    second = teams.where(third).select(
        "team_id", F.concat(F.lit("M"), ((F.col("team_id") + 7) % 20).cast("string")).alias("manager"),
        F.lit(16).alias("first_day"), F.lit(OPEN_DAY).alias("last_day"))
    return first.unionByName(second)


def publication(events: DataFrame) -> DataFrame:
    """The ranking lists: every ``WEEK`` days up to a league's last event, all teams
    with an event before that day, ranked by the value accumulated before it.

    Values are pre-aggregated per (league, team, week); a team's running total is
    then repeated on the publications up to its next active week, so a list costs
    one row per team and no join against the calendar. Positions in a list come
    from ``ordinal_within``, as a league's list may be long.
    """
    day = day_index("ts")
    weekly = (events.groupBy(F.col("event_type").alias("league"), F.col("user_id").alias("team_id"),
                             F.floor(day / WEEK).alias("week")).agg(F.sum("value").alias("v")))
    last = events.groupBy(F.col("event_type").alias("league")).agg(F.floor(F.max(day) / WEEK).alias("last"))
    w = Window.partitionBy("league", "team_id").orderBy("week")
    run = weekly.select("league", "team_id", "week", F.lead("week").over(w).alias("next"),
                        F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    upto = F.least(F.coalesce("next", "last"), F.col("last"))
    lists = run.join(last, "league").where(F.col("week") < upto).select(
        "league", "team_id", (-F.round("total", 2)).alias("_down"),
        F.explode(F.sequence(F.col("week") + 1, upto)).alias("_no"))
    lists = lists.withColumn("pub_day", (F.col("_no") * WEEK).cast("bigint"))
    # a league's last list has all its teams, and no list has more
    teams = events.select("event_type", "user_id").distinct().groupBy("event_type").count().agg(F.max("count")).first()[0]
    short = (teams or 0) <= hot_rows(events.sparkSession)
    ranked = ordinal_within(lists, ["league", "pub_day"], ["_down", "team_id"], "ordinal", Cuts(None) if short else None)
    return ranked.select("league", "pub_day", "team_id", (F.col("ordinal") + 1).alias("ordinal"))


def open_end(start: str = "period_start") -> F.Column:
    """End of a list without a successor: the day before the next one is due, which no
    event of the league reaches."""
    return F.col(start) + (WEEK - 1)
