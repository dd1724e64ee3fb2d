"""Declared schemas of the two-sided sports sources (CSV, header row).

Column order follows the public file layouts; reading with a declared
schema skips the inference pass and fails fast on malformed rows.
"""

from __future__ import annotations

from pyspark.sql.types import IntegerType, StringType, StructField, StructType

INT, STR = IntegerType(), StringType()

# Box-score column stems of the detailed results, in file order.
BOX_STEMS = ["FGM", "FGA", "FGM3", "FGA3", "FTM", "FTA", "OR", "DR", "Ast", "TO", "Stl", "Blk", "PF"]


def _st(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(n, t, True) for n, t in fields])


COMPACT_RESULTS = _st(("Season", INT), ("DayNum", INT), ("WTeamID", INT), ("WScore", INT),
                      ("LTeamID", INT), ("LScore", INT), ("WLoc", STR), ("NumOT", INT))

DETAILED_RESULTS = StructType(
    COMPACT_RESULTS.fields
    + [StructField("W" + s, INT, True) for s in BOX_STEMS]
    + [StructField("L" + s, INT, True) for s in BOX_STEMS])

CONFERENCE_TOURNEY_GAMES = _st(("Season", INT), ("ConfAbbrev", STR), ("DayNum", INT),
                               ("WTeamID", INT), ("LTeamID", INT))

TEAM_CONFERENCES = _st(("Season", INT), ("TeamID", INT), ("ConfAbbrev", STR))

TEAM_COACHES = _st(("Season", INT), ("TeamID", INT), ("FirstDayNum", INT), ("LastDayNum", INT),
                   ("CoachName", STR))

ORDINALS = _st(("Season", INT), ("RankingDayNum", INT), ("SystemName", STR), ("TeamID", INT),
               ("OrdinalRank", INT))

TOURNEY_SEEDS = _st(("Season", INT), ("Seed", STR), ("TeamID", INT))

TEAMS = _st(("TeamID", INT), ("TeamName", STR), ("FirstD1Season", INT), ("LastD1Season", INT))

SCHEMAS = {
    "regular_detailed": DETAILED_RESULTS,
    "tourney_detailed": DETAILED_RESULTS,
    "tourney_compact": COMPACT_RESULTS,
    "conference_tourney": CONFERENCE_TOURNEY_GAMES,
    "team_conferences": TEAM_CONFERENCES,
    "team_coaches": TEAM_COACHES,
    "ordinals": ORDINALS,
    "seeds": TOURNEY_SEEDS,
    "teams": TEAMS,
}
