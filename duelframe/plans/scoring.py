"""Score any number of future pairings in one batch job.

The interactive form scores one pairing per request: look up two names,
pull each team's latest state, add constants, predict. Here the requests
are a table; names resolve by a join to the team dimension, each team's
serving state is joined twice (as side A and side B), constants become
literal columns, and the fitted pipeline scores all rows at once.
"""

from __future__ import annotations

from pyspark.ml import Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.scalar import fill_numeric, rounded
from duelframe.operators import sequence as seq
from duelframe.operators.hot import Cuts
from duelframe.plans.sports import MODEL_COLUMNS

# Fixed values of a hypothetical tournament game on a neutral court.
NEUTRAL_GAME = {"GameLocation_A": "N", "RegSeasonFlag_A": 0, "ConfTourneyFlag_A": 0,
                "NCAATourneyFlag_A": 1}
REQUEST_COLUMNS = ["team_1_name", "team_1_seed", "team_2_name", "team_2_seed"]


def resolve_names(requests: DataFrame, teams: DataFrame) -> DataFrame:
    """Requests with a missing field are dropped; names map to ids by join
    (an unknown name drops its request)."""
    r = requests.dropna(subset=REQUEST_COLUMNS)
    t1 = teams.select(F.col("TeamName").alias("team_1_name"), F.col("TeamID").alias("team_1_id"))
    t2 = teams.select(F.col("TeamName").alias("team_2_name"), F.col("TeamID").alias("team_2_id"))
    return r.join(t1, "team_1_name").join(t2, "team_2_name")


def sports_matchup_rows(requests: DataFrame, teams: DataFrame, state: DataFrame,
                        season: int) -> DataFrame:
    """Model-shaped rows (``*_A`` for team 1, ``*_B`` for team 2) from the
    serving state of ``sports.serving_state``."""
    r = resolve_names(requests, teams)
    per_team = [c for c in MODEL_COLUMNS if c not in ("Season", "GameID", "DayNum")]

    def side(s: str, id_col: str) -> DataFrame:
        return state.select(*[F.col(c).alias(f"{c}_{s}") for c in per_team]) \
                    .withColumnRenamed(f"TeamID_{s}", id_col)

    rows = r.join(side("A", "team_1_id"), "team_1_id").join(side("B", "team_2_id"), "team_2_id")
    const = {k: F.lit(v) for k, v in NEUTRAL_GAME.items()}
    const["Season"] = F.lit(season)
    const["TeamID_A"] = F.col("team_1_id")
    const["TeamID_B"] = F.col("team_2_id")
    const["NCAATourneySeed_A"] = F.col("team_1_seed").cast("int")
    const["NCAATourneySeed_B"] = F.col("team_2_seed").cast("int")
    return rows.withColumns(const)


def predict_winner(model: Transformer, rows: DataFrame) -> DataFrame:
    """Class 1 means team 1 (side A) wins."""
    out = model.transform(rows)
    return out.select(*REQUEST_COLUMNS,
                      F.when(F.col("prediction") == 1, F.col("team_1_name"))
                      .otherwise(F.col("team_2_name")).alias("winner"))


# ---------------------------------------------------------------- contest tables

CONTEST_ENTITY = ["league", "team_id"]
CONTEST_ORDER = ["day_num", "game_key"]


def contest_state(tg, cuts: Cuts | None = None) -> DataFrame:
    """Post-game features of each team's latest game, named like the
    pre-game training features so one model serves both."""
    from duelframe.plans.features import contest_feats, team_window
    feats = contest_feats(include_current=True)
    f = team_window(tg.select(*CONTEST_ENTITY, *CONTEST_ORDER, "win", "points", "allowed"), feats, cuts)
    s = f.select(*CONTEST_ENTITY, *CONTEST_ORDER, *[rounded(x.name).alias(x.name) for x in feats])
    return fill_numeric(seq.latest(s, CONTEST_ENTITY, CONTEST_ORDER).drop(*CONTEST_ORDER), 0)


def contest_matchup_rows(requests: DataFrame, state: DataFrame) -> DataFrame:
    """``requests(league, game_key, team_1, team_2)`` -> rows shaped like
    ``game_features`` (team 1 as side A on a neutral court)."""
    feats = [c for c in state.columns if c not in CONTEST_ENTITY]

    def side(s: str, id_col: str) -> DataFrame:
        return state.select("league", F.col("team_id").alias(id_col),
                            *[F.col(c).alias(f"{c}_{s}") for c in feats])

    r = requests.dropna(subset=["league", "team_1", "team_2"])
    rows = r.join(side("A", "team_1"), ["league", "team_1"]).join(side("B", "team_2"),
                                                                   ["league", "team_2"])
    return rows.withColumns({"loc_A": F.lit("N"), "loc_B": F.lit("N"),
                             "team_id_A": F.col("team_1"), "team_id_B": F.col("team_2"),
                             "win_A": F.lit(None).cast("int")})
