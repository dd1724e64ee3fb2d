"""Published rankings as validity periods, and the active rank of a game.

A ranking list published on day ``d`` is active from ``d`` to the day
before the next publication. Two scopes for "next publication":

- ``season``: the next publication of the same season; the last list of a
  season stays active up to ``open_end``.
- ``file``: the next publication in the whole list ordered by (season,
  day), as a single shift over the sorted publication table does. The last
  list of a season then ends before the next season's first day - usually
  an empty period - and only the final season reaches ``open_end``.

The period table has one row per distinct (season, day): its size is
bounded by the calendar, not by the number of ranked teams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.asof import asof_join
from duelframe.operators.hot import Cuts

OPEN_END = 200  # of the sports season; a column of the start for other calendars


def rank_periods(pubs: DataFrame, season: str, day: str, scope: str = "season",
                 open_end: int | Column = OPEN_END, start: str = "period_start",
                 end: str = "period_end") -> DataFrame:
    if scope not in ("season", "file"):
        raise ValueError("scope must be 'season' or 'file'")
    days = pubs.select(season, F.col(day).alias(start)).distinct()
    w = Window.partitionBy(season).orderBy(start)
    nxt = F.lead(start, 1).over(w)
    if scope == "season":
        return days.select(season, start, F.coalesce(nxt - 1, F.lit(open_end)).alias(end))
    # file scope: the successor of a season's last day is the first day of
    # the next season in order. The season summary has one row per season.
    firsts = days.groupBy(season).agg(F.min(start).alias("_first"))
    succ = firsts.select(F.col(season).alias("_s"),
                         F.lead("_first", 1).over(Window.orderBy(season)).alias("_next_first"))
    with_next = days.select(season, start, nxt.alias("_nxt"))
    return (with_next.join(succ, with_next[season] == succ["_s"], "left")
            .select(season, start,
                    F.coalesce(F.col("_nxt") - 1, F.col("_next_first") - 1, F.lit(open_end))
                    .alias(end)))


def ranked_periods(ranks: DataFrame, season: str, day: str, scope: str = "season",
                   open_end: int | Column = OPEN_END) -> DataFrame:
    """Period table joined to the ranking rows published at its start:
    one row per (season, team, period) with the rank.

    Every period starts on a publication day of ``ranks``, so the join is
    inner with the period table (one row per distinct publication day,
    bounded by the calendar) as the build side: the ranking rows stream
    through a broadcast hash join instead of being shuffled."""
    periods = rank_periods(ranks, season, day, scope, open_end)
    r = ranks.withColumnRenamed(day, "period_start")
    return r.join(periods, [season, "period_start"], "inner")


def active_rank(games: DataFrame, ranked: DataFrame, season: str, team: str, day: str,
                rank_col: str, out: str, ranked_team: str = "team_id", cuts: Cuts | None = None) -> DataFrame:
    """The rank whose period covers the game day, null without one. The periods of a
    season's lists do not overlap, so the rank is carried along (season, team) from each
    list to the games (``asof_join``). A team absent from the active list gets null even
    if an older list had it: its period has ended. ``team`` names the game-side id (own or
    opponent), ``ranked_team`` the id column of ``ranked``; ``cuts``: ``stream_cuts`` of the
    games by (season, team) and day."""
    r = ranked.select(F.col(season).alias("_s0"), F.col(ranked_team).alias("_t0"), F.col("period_start").alias("_from"),
                      F.col("period_end").alias("_to"), F.col(rank_col).alias(out))
    return asof_join(games, r, [season, team], day, "_from", "_to", "left", ["_s0", "_t0"], disjoint=True,
                     cuts=cuts).drop("_from", "_to")
