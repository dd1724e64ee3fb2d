"""Leak-free per-participant features and the paired model rows.

All features of one entity window are produced by a single ``select``
so Catalyst shares one Exchange + Sort + Window between them; unused
features are pruned away by the optimizer before execution.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.scalar import fill_numeric, rounded
from duelframe.operators.pairing import pair_sides
from duelframe.operators.hot import Cuts, find_cuts
from duelframe.operators.sliced import Feat, sliced_window
from duelframe.plans.contest import day_index

WARMUP_GAMES = 5
LAST_N = 5


ENTITY = ("league", "team_id")
ORDER = ("day_num", "game_key")
GAME = ("league", "game_key", "day_num")


def team_cuts(events: DataFrame) -> Cuts:
    """Cuts of busy teams: every game takes one of a team's events."""
    return find_cuts(events.select(F.col("event_type").alias("league"), F.col("user_id").alias("team_id"),
                                   day_index("ts").alias("day_num"), F.col("event_id").alias("game_key")), ENTITY, ORDER)


def team_window(tg: DataFrame, feats: Sequence[Feat], cuts: Cuts | None = None) -> DataFrame:
    """Team-sequence features; a team with a huge share of the games is spread over
    many tasks. ``cuts``: of busy teams (``team_cuts``), by default looked for in ``tg``."""
    return sliced_window(tg, ENTITY, ORDER, feats, cuts)


def contest_feats(include_current: bool = False, n: int = LAST_N) -> list[Feat]:
    """Running and last-n features of a mirrored contest (``team_game``).
    A win share W / (W + L) is the mean of the 0/1 win flag."""
    cur = include_current
    return [Feat("win_pct_prior", "mean", "win", None, cur), Feat("win_pct_last5", "mean", "win", n, cur),
            Feat("points_mean_prior", "mean", "points", None, cur),
            Feat("points_mean_last5", "mean", "points", n, cur),
            Feat("allowed_mean_prior", "mean", "allowed", None, cur),
            Feat("allowed_mean_last5", "mean", "allowed", n, cur)]


def team_features(tg: DataFrame, include_current: bool = False, cuts: Cuts | None = None) -> DataFrame:
    base = tg.select("league", "game_key", "day_num", "team_id", "loc", "win", "points", "allowed")
    feats = contest_feats(include_current) + [Feat("game_number", "rownum")]
    return team_window(base, feats, cuts).drop("points", "allowed")


def game_features(tg: DataFrame, warmup: int = WARMUP_GAMES, places: int | None = 6,
                  cuts: Cuts | None = None) -> DataFrame:
    """Flagship: pre-game features of both sides of every game in which
    both teams are past their warm-up games; one row per game, side A =
    away team (or first id on a neutral court), label ``win_A``."""
    feats = team_features(tg, cuts=cuts).where(F.col("game_number") > warmup)
    feats = fill_numeric(feats, 0)
    if places is not None:
        feats = feats.withColumns({c: rounded(c, places) for c in
                                   ("win_pct_prior", "win_pct_last5", "points_mean_prior",
                                    "points_mean_last5", "allowed_mean_prior", "allowed_mean_last5")})
    return pair_sides(feats.drop("game_number"), GAME, "loc", "team_id", drop=["win_B"])
