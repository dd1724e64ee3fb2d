"""The two-sided sports pipeline on its own schema (detailed game results,
conferences, coaches, tournament history, seeds, published rankings).

Stage by stage:

    game_table        regular + tournament results, source flags, conference
                      tourney mark, both teams' conference, dense GameID
    mirror_games      one row per team and game, 40 canonical columns
    derived_columns   rebounds, shooting ratios, power-conference flags
    attach_coach      active coach by validity interval (inner)
    tourney_history   career tournament wins coming in, by school / coach
    attach_tourney_wins  sparse join + forward / backward fill
    attach_seeds      numeric seed on tournament rows
    attach_ranks      active AP / POM / NET rank on game day
    model_features    the 50 window features, warm-up cut, numeric fill
    final_pairs       A/B model rows, 77 columns
    serving_state     post-game features of each team's latest game

Each stage is a ``DataFrame -> DataFrame`` function; nothing is collected.
Sequence features of one team-season share a single window specification
and are produced by one ``select``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.scalar import (code_number, fill_numeric, in_set_flag, nan_ratio,
                                        safe_ratio)
from duelframe.operators import sequence as seq
from duelframe.operators.asof import stream_cuts
from duelframe.operators.hot import Cuts, find_cuts
from duelframe.operators.joins import dim_lookup, interval_join, mark_join
from duelframe.operators.mirror import mirror, mirror_compact
from duelframe.operators.ordinal import ordinal_within
from duelframe.operators.pairing import pair_sides
from duelframe.operators.ranks import active_rank, ranked_periods
from duelframe.operators.sliced import Feat, sliced_window
from duelframe.operators.written import written
from duelframe.sources.schemas import BOX_STEMS

# Output names of the mirrored box-score columns, by stem.
BOX_NAMES = {
    "FGM": "FieldGoalsMade", "FGA": "FieldGoalAttempts", "FGM3": "ThreePointersMade",
    "FGA3": "ThreePointerAttempts", "FTM": "FreeThrowsMade", "FTA": "FreeThrowAttempts",
    "OR": "OffensiveRebounds", "DR": "DefensiveRebounds", "Ast": "Assists", "TO": "Turnovers",
    "Stl": "Steals", "Blk": "Blocks", "PF": "PlayerFouls",
}

# The seven power-conference codes.
POWER_CONFERENCES = ("sec", "acc", "big_ten", "big_twelve", "pac_ten", "pac_twelve", "big_east")

# Fixed values: (feature stem, source column) of the 22 averaged statistics.
STAT_FEATURES = [
    ("PointsScoredAvg", "PointsScored"), ("PointsAllowedAvg", "PointsAllowed"),
    ("ReboundsAvg", "TotalRebounds"), ("OppReboundsAvg", "OppTotalRebounds"),
    ("OffensiveReboundsAvg", "OffensiveRebounds"), ("DefensiveReboundsAvg", "DefensiveRebounds"),
    ("OppOffensiveReboundsAvg", "OppOffensiveRebounds"),
    ("OppDefensiveReboundsAvg", "OppDefensiveRebounds"),
    ("TurnoversAvg", "Turnovers"), ("OppTurnoversAvg", "OppTurnovers"),
    ("StealsAvg", "Steals"), ("OppStealsAvg", "OppSteals"),
    ("BlocksAvg", "Blocks"), ("OppBlocksAvg", "OppBlocks"),
    ("FoulsAvg", "PlayerFouls"), ("OppFoulsAvg", "OppPlayerFouls"),
    ("FreeThrowPct", "FreeThrowPct"), ("OppFreeThrowPct", "OppFreeThrowPct"),
    ("FieldGoalPct", "FieldGoalPct"), ("OppFieldGoalPct", "OppFieldGoalPct"),
    ("ThreePtPct", "ThreePtPct"), ("OppThreePtPct", "OppThreePtPct"),
]

# The statistics whose features are kept for modelling.
KEPT_STATS = ["PointsScoredAvg", "PointsAllowedAvg", "ReboundsAvg", "OppReboundsAvg",
              "FreeThrowPct", "OppFreeThrowPct", "FieldGoalPct", "OppFieldGoalPct",
              "ThreePtPct", "OppThreePtPct"]

UNRANKED = 9999
NO_SEED = 9999
WARMUP_GAMES = 5

GAME_KEY = ["Season", "DayNum", "WTeamID", "LTeamID"]
TEAM_SEASON = ["Season", "TeamID"]
TEAM_ORDER = ["DayNum", "GameID"]

MIRRORED_COLUMNS = (["GameID", "Season", "RegSeasonFlag", "ConfTourneyFlag", "NCAATourneyFlag",
                     "DayNum", "TeamConf", "OppConf", "TeamID", "PointsScored", "GameLocation"]
                    + [BOX_NAMES[s] for s in BOX_STEMS] + ["PointsAllowed"]
                    + ["Opp" + BOX_NAMES[s] for s in BOX_STEMS] + ["WinFlag", "LoseFlag"])


# ---------------------------------------------------------------- game table

def game_table(regular: DataFrame, tourney: DataFrame, conf_games: DataFrame,
               team_confs: DataFrame) -> DataFrame:
    """One row per game of the season and the tournament."""
    reg = regular.withColumns({"RegSeasonFlag": F.lit(1), "NCAATourneyFlag": F.lit(0)})
    post = tourney.withColumns({"RegSeasonFlag": F.lit(0), "NCAATourneyFlag": F.lit(1)})
    games = reg.unionByName(post)
    games = mark_join(games, conf_games, GAME_KEY, "ConfTourneyFlag")
    games = dim_lookup(games, team_confs, ["Season", "WTeamID"], ["Season", "TeamID"],
                       {"ConfAbbrev": "WConf"})
    games = dim_lookup(games, team_confs, ["Season", "LTeamID"], ["Season", "TeamID"],
                       {"ConfAbbrev": "LConf"})
    # dense game id in (season, day, winner, loser) order
    return ordinal_within(games, [], GAME_KEY, "GameID", find_cuts(reg.unionByName(post), [], GAME_KEY))


def winner_id_range(games: DataFrame) -> DataFrame:
    """Optional cut of the original loop: ids outside the winners' id
    range are never visited, so their rows disappear after the mirror.
    Off by default; apply to the mirrored rows to reproduce it."""
    lo = games.agg(F.min("WTeamID")).scalar()
    hi = games.agg(F.max("WTeamID")).scalar()
    return lo, hi


def mirror_games(games: DataFrame, id_range: tuple | None = None) -> DataFrame:
    keep = ["GameID", "Season", "RegSeasonFlag", "ConfTourneyFlag", "NCAATourneyFlag", "DayNum"]
    sides: dict[str, tuple[str, str]] = {
        "TeamConf": ("WConf", "LConf"), "OppConf": ("LConf", "WConf"),
        "TeamID": ("WTeamID", "LTeamID"), "PointsScored": ("WScore", "LScore"),
        "PointsAllowed": ("LScore", "WScore")}
    for stem, name in BOX_NAMES.items():
        sides[name] = ("W" + stem, "L" + stem)
        sides["Opp" + name] = ("L" + stem, "W" + stem)
    m = mirror(games, keep, sides, loc=("WLoc", "GameLocation"), win_col="WinFlag",
               lose_col="LoseFlag").select(*MIRRORED_COLUMNS)
    if id_range is not None:
        m = m.where(F.col("TeamID").between(id_range[0], id_range[1]))
    return m


def derived_columns(df: DataFrame, zero_attempts: str = "skip") -> DataFrame:
    """Rebound sums, shooting ratios and power-conference outcome flags.

    ``zero_attempts``: ``"skip"`` makes a 0-attempt ratio null (it drops
    out of the running means); ``"nan"`` gives IEEE NaN, which then keeps
    every running mean of that team-season NaN (later filled with 0).
    """
    ratio = nan_ratio if zero_attempts == "nan" else safe_ratio
    won, lost = F.col("WinFlag") == 1, F.col("LoseFlag") == 1
    return df.withColumns({
        "TotalRebounds": F.col("OffensiveRebounds") + F.col("DefensiveRebounds"),
        "OppTotalRebounds": F.col("OppOffensiveRebounds") + F.col("OppDefensiveRebounds"),
        "FieldGoalPct": ratio("FieldGoalsMade", "FieldGoalAttempts"),
        "OppFieldGoalPct": ratio("OppFieldGoalsMade", "OppFieldGoalAttempts"),
        "ThreePtPct": ratio("ThreePointersMade", "ThreePointerAttempts"),
        "OppThreePtPct": ratio("OppThreePointersMade", "OppThreePointerAttempts"),
        "FreeThrowPct": ratio("FreeThrowsMade", "FreeThrowAttempts"),
        "OppFreeThrowPct": ratio("OppFreeThrowsMade", "OppFreeThrowAttempts"),
        "Power5WinFlag": in_set_flag("OppConf", POWER_CONFERENCES, won),
        "NonPower5WinFlag": in_set_flag("OppConf", POWER_CONFERENCES, won, negate=True),
        "Power5LoseFlag": in_set_flag("OppConf", POWER_CONFERENCES, lost),
        "NonPower5LoseFlag": in_set_flag("OppConf", POWER_CONFERENCES, lost, negate=True),
    })


# ---------------------------------------------------------------- enrichment

def attach_coach(df: DataFrame, coaches: DataFrame) -> DataFrame:
    """Active coach on game day. Inner semantics: a game with no covering
    tenure disappears, overlapping tenures duplicate it."""
    return interval_join(df, coaches.select("Season", "TeamID", "FirstDayNum", "LastDayNum",
                                            "CoachName"),
                         TEAM_SEASON, "DayNum", "FirstDayNum", "LastDayNum", "inner") \
        .drop("FirstDayNum", "LastDayNum")


def tourney_history(compact: DataFrame, coaches: DataFrame) -> DataFrame:
    """Tournament appearances (compact results, longer history) mirrored to
    one row per team, with the coach active that day."""
    m = mirror_compact(compact, ["Season", "DayNum"], "WTeamID", "LTeamID", "TeamID",
                       "TourneyWinFlag", "TourneyLoseFlag")
    return attach_coach(m, coaches)


def _carried(df: DataFrame, entity: str, order: list[str], col: str, back: bool, cuts: Cuts) -> DataFrame:
    """Replace ``col`` by its forward fill along ``entity`` and, with ``back``, the rows
    before the first value by that value."""
    feats = [Feat("_ff", "ffill", col)] + ([Feat("_bf", "bfill", col)] if back else [])
    out = sliced_window(df, [entity], order, feats, cuts)
    return out.withColumn(col, F.coalesce(*[f.name for f in feats])).drop(*[f.name for f in feats])


def school_wins(history: DataFrame) -> DataFrame:
    """Tournament wins of the school before each of its tournament games
    (career-long, across seasons; a team plays once a day)."""
    out = sliced_window(history, ["TeamID"], ["Season", "DayNum"], [Feat("_w", "sum", "TourneyWinFlag")],
                        find_cuts(history, ["TeamID"], ["Season", "DayNum"]))
    return out.select("Season", "TeamID", "DayNum",
                      F.coalesce("_w", F.lit(0)).cast("bigint").alias("ActiveTourneyWins_School"))


def coach_wins(history: DataFrame) -> DataFrame:
    order = ["Season", "DayNum", "TeamID"]
    out = sliced_window(history, ["CoachName"], order, [Feat("_w", "sum", "TourneyWinFlag")],
                        find_cuts(history, ["CoachName"], order))
    return out.select("Season", "CoachName", "DayNum",
                      F.coalesce("_w", F.lit(0)).cast("bigint").alias("ActiveTourneyWins_Coach"))


def attach_tourney_wins(df: DataFrame, school: DataFrame, coach: DataFrame,
                        backfill: str = "next", coach_order: str = "chronological",
                        history_seasons: tuple[int, int] = (1989, 2003)) -> DataFrame:
    """Sparse wins-coming-in joined on the game day, then carried.

    Forward fill along the school's (coach's) games keeps the last known
    value between tournaments. ``backfill="next"`` then fills the rows
    before the first known value from the *next* appearance (looks ahead,
    as the original does); ``"history"`` uses the maximum from the
    ``history_seasons`` half-open range instead (leak-free), then 0.
    ``coach_order="team"`` carries coach values in team order (the
    original's sort), ``"chronological"`` in time order.
    """
    j = (df.join(school, ["Season", "TeamID", "DayNum"], "left")
           .join(coach, ["Season", "CoachName", "DayNum"], "left"))
    t_order = ["Season", "DayNum", "GameID"]
    c_order = (["TeamID", "Season", "DayNum", "GameID"] if coach_order == "team"
               else ["Season", "DayNum", "TeamID", "GameID"])
    back = backfill == "next"
    j = _carried(j, "TeamID", t_order, "ActiveTourneyWins_School", back, find_cuts(df, ["TeamID"], t_order))
    j = _carried(j, "CoachName", c_order, "ActiveTourneyWins_Coach", back, find_cuts(df, ["CoachName"], c_order))
    if back:
        return j
    lo, hi = history_seasons
    old_s = (school.where((F.col("Season") >= lo) & (F.col("Season") < hi)).groupBy("TeamID")
             .agg(F.max("ActiveTourneyWins_School").alias("_hs")))
    old_c = (coach.where((F.col("Season") >= lo) & (F.col("Season") < hi)).groupBy("CoachName")
             .agg(F.max("ActiveTourneyWins_Coach").alias("_hc")))
    j = j.join(old_s, "TeamID", "left").join(old_c, "CoachName", "left")
    return j.withColumns({
        "ActiveTourneyWins_School": F.coalesce("ActiveTourneyWins_School", "_hs", F.lit(0)),
        "ActiveTourneyWins_Coach": F.coalesce("ActiveTourneyWins_Coach", "_hc", F.lit(0)),
    }).drop("_hs", "_hc")


def attach_seeds(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Numeric seed (``W16a`` -> 16) on tournament rows, null elsewhere.
    Written as the original full join + not-null filter; Catalyst reduces
    it to a left join."""
    j = df.join(seeds.select("Season", "TeamID", "Seed"), TEAM_SEASON, "full") \
          .where(F.col("GameID").isNotNull())
    return j.withColumn("NCAATourneySeed",
                        F.when(F.col("NCAATourneyFlag") == 1, code_number("Seed", 2, 2))
                        .otherwise(F.lit(None).cast("int"))).drop("Seed")


def attach_ranks(df: DataFrame, systems: Mapping[str, DataFrame], scope: str = "file") -> DataFrame:
    """``Active<name>Rank`` for every ranking system in ``systems``
    (e.g. ``{"AP": ap, "POM": pom, "NET": net}``). ``scope="file"``
    reproduces the original expiry across seasons; ``"season"`` keeps a
    season's last list active to day 200."""
    cuts = stream_cuts(df.select("Season", "TeamID", "DayNum", "GameID"), TEAM_SEASON, "DayNum")
    for name, ranks in systems.items():
        ranked = ranked_periods(ranks.select("Season", "RankingDayNum", "TeamID", "OrdinalRank"),
                                "Season", "RankingDayNum", scope)
        df = active_rank(df, ranked, "Season", "TeamID", "DayNum", "OrdinalRank",
                         f"Active{name}Rank", ranked_team="TeamID", cuts=cuts)
    return df


def team_games(regular, tourney, compact, conf_games, team_confs, coaches, seeds,
               systems: Mapping[str, DataFrame], zero_attempts: str = "skip",
               backfill: str = "next", coach_order: str = "chronological",
               rank_scope: str = "file") -> DataFrame:
    """All enrichment stages: the per team-game table before features."""
    g = game_table(regular, tourney, conf_games, team_confs)
    # written, as they are read for the cuts of their windows and for the windows
    t = written(attach_coach(derived_columns(mirror_games(g), zero_attempts), coaches), "games")
    hist = written(tourney_history(compact, coaches), "history")
    t = attach_tourney_wins(t, school_wins(hist), coach_wins(hist), backfill, coach_order)
    return written(attach_ranks(attach_seeds(t, seeds), systems, rank_scope), "team-games")


# ---------------------------------------------------------------- features

def _ratio(w: str, l: str, zero_as_nan: bool = True) -> F.Column:
    """W / (W + L) from two window sums; 0/0 -> NaN (filled with 0 later)."""
    tot = F.col(w) + F.col(l)
    share = F.try_divide(F.col(w).cast("double"), tot.cast("double"))
    return F.when(tot == 0, F.lit(float("nan"))).otherwise(share) if zero_as_nan else share


def with_features(df: DataFrame, include_current: bool = False, last_n: int = 5) -> DataFrame:
    """Input columns plus all 50 features of a team-season, from one window pass.
    Season bests and fills read the raw (unfilled) rank columns.
    """
    cur = include_current
    feats = [
        Feat("_pom_ff", "ffill", "ActivePOMRank"), Feat("_net_ff", "ffill", "ActiveNETRank"),
        Feat("_best_ap", "min", "ActiveAPRank", None, True), Feat("_best_pom", "min", "ActivePOMRank", None, True),
        Feat("_w", "sum", "WinFlag", None, cur), Feat("_l", "sum", "LoseFlag", None, cur),
        Feat("_w5", "sum", "WinFlag", last_n, cur), Feat("_l5", "sum", "LoseFlag", last_n, cur),
        Feat("_pw", "sum", "Power5WinFlag", None, cur), Feat("_pl", "sum", "Power5LoseFlag", None, cur),
        Feat("_nw", "sum", "NonPower5WinFlag", None, cur), Feat("_nl", "sum", "NonPower5LoseFlag", None, cur),
    ]
    for stem, src in STAT_FEATURES:
        feats += [Feat(f"{stem}_Overall", "mean", src, None, cur),
                  Feat(f"{stem}_Last{last_n}", "mean", src, last_n, cur)]
    out = sliced_window(df, TEAM_SEASON, TEAM_ORDER, feats, find_cuts(df, TEAM_SEASON, TEAM_ORDER))
    final = {
        "ActiveAPRank": F.coalesce("ActiveAPRank", F.lit(UNRANKED)),
        "ActivePOMRank": F.coalesce("_pom_ff", F.lit(UNRANKED)),
        "ActiveNETRank": F.coalesce("_net_ff", F.lit(UNRANKED)),
        "NCAATourneySeed": F.coalesce("NCAATourneySeed", F.lit(NO_SEED)),
        "ActiveTourneyWins_School": F.coalesce("ActiveTourneyWins_School", F.lit(0)),
        "ActiveTourneyWins_Coach": F.coalesce("ActiveTourneyWins_Coach", F.lit(0)),
        "SeasonBestAPRank": F.coalesce("_best_ap", F.lit(UNRANKED)),
        "SeasonBestPOMRank": F.coalesce("_best_pom", F.lit(UNRANKED)),
        "RollingWinPct_Overall": _ratio("_w", "_l"),
        f"RollingWinPct_Last{last_n}": _ratio("_w5", "_l5"),
        "RollingP5WinPct_Overall": _ratio("_pw", "_pl"),
        "RollingNP5WinPct_Overall": _ratio("_nw", "_nl"),
    }
    helpers = [f.name for f in feats if f.name.startswith("_")]
    return out.withColumns(final).drop(*helpers)


# The columns that the model is trained on.
MODEL_COLUMNS = (["WinFlag", "Season", "GameID", "DayNum", "TeamID", "RollingWinPct_Overall",
                  "RollingWinPct_Last5", "GameLocation", "TeamConf", "RegSeasonFlag",
                  "ConfTourneyFlag", "NCAATourneyFlag", "RollingP5WinPct_Overall",
                  "RollingNP5WinPct_Overall", "CoachName", "ActiveTourneyWins_School",
                  "ActiveTourneyWins_Coach", "NCAATourneySeed", "ActiveAPRank", "ActivePOMRank",
                  "ActiveNETRank", "SeasonBestAPRank", "SeasonBestPOMRank"]
                 + [f"{s}_{k}" for s in KEPT_STATS for k in ("Overall", "Last5")])


def model_features(df: DataFrame, warmup: int = WARMUP_GAMES) -> DataFrame:
    """Pre-game features, kept columns, warm-up cut (dense rank of the day
    > ``warmup``, joined from the distinct days - no row sort), then null
    and NaN -> 0 in numeric columns."""
    f = with_features(df).select(*MODEL_COLUMNS)
    f = seq.dense_rank_of(f, TEAM_SEASON, "DayNum", "GameNumber").select(*MODEL_COLUMNS, "GameNumber")
    return fill_numeric(f.where(F.col("GameNumber") > warmup), 0)


# Side-B columns removed from the paired rows.
DROP_AFTER_PAIRING = ["WinFlag_B", "RegSeasonFlag_B", "ConfTourneyFlag_B", "NCAATourneyFlag_B",
                      "GameID", "DayNum"]


def final_pairs(model_data: DataFrame) -> DataFrame:
    """A/B rows: A = away team (or lower id as string on a neutral court),
    B = home. A game survives only if both teams passed the warm-up."""
    return pair_sides(model_data.drop("GameNumber"), ["GameID"], "GameLocation", "TeamID",
                      shared=["Season", "DayNum"], drop=DROP_AFTER_PAIRING)


def serving_state(df: DataFrame) -> DataFrame:
    """Post-game features after each team's latest game (one row per team;
    a team with two games on its last day keeps the later GameID)."""
    f = with_features(df, include_current=True).select(*MODEL_COLUMNS)
    return fill_numeric(seq.latest(f, ["TeamID"], ["Season", "DayNum", "GameID"]), 0)


def split_rankings(ordinals: DataFrame, root: str, fmt: str = "csv") -> None:
    """One folder per ranking system in a single pass over the master file."""
    from duelframe.sources.files import write_partitioned
    write_partitioned(ordinals, "SystemName", root, key_copy="System", fmt=fmt)
