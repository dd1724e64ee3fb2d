"""Mirror a two-sided fact: one row per participant, in a single scan.

A game row with winner columns and loser columns becomes two rows: the
winner's view (own = winner, opponent = loser, win = 1) and the loser's
view (own = loser, opponent = winner, location flipped H<->A, win = 0).
Both views are built as structs of one projection and emitted by
``inline`` (a Generate node), so the input - often an expensive derived
table - is computed once and never shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The location code seen from the other side.
FLIP_LOCATION = {"H": "A", "A": "H"}
NEUTRAL = "N"


def flip_location(loc: str | Column) -> Column:
    c = F.col(loc) if isinstance(loc, str) else loc
    return (F.when(c == "H", F.lit(FLIP_LOCATION["H"]))
             .when(c == "A", F.lit(FLIP_LOCATION["A"]))
             .otherwise(F.lit(NEUTRAL)))


def mirror(df: DataFrame, keep: Sequence[str], sides: Mapping[str, tuple[str, str]],
           loc: tuple[str, str] | None = None, win_col: str | None = "win",
           lose_col: str | None = None) -> DataFrame:
    """Two rows per input row.

    keep  - columns copied unchanged to both rows (game keys, flags).
    sides - ``out_name -> (winner_col, loser_col)``; the winner row takes
            the first, the loser row the second. Give own/opponent pairs
            both ways, e.g. ``points: (w_score, l_score)`` and
            ``allowed: (l_score, w_score)``.
    loc   - ``(winner_loc_col, out_name)``: the loser row gets the flip.
    win_col / lose_col - names of the 1/0 outcome flags to add.
    """
    def view(is_winner: bool) -> Column:
        fields = [F.col(c).alias(c) for c in keep]
        for out, (w, l) in sides.items():
            fields.append(F.col(w if is_winner else l).alias(out))
        if loc is not None:
            src, out = loc
            fields.append((F.col(src) if is_winner else flip_location(src)).alias(out))
        if win_col:
            fields.append(F.lit(1 if is_winner else 0).alias(win_col))
        if lose_col:
            fields.append(F.lit(0 if is_winner else 1).alias(lose_col))
        return F.struct(*fields)

    return df.select(F.inline(F.array(view(True), view(False))))


def mirror_compact(df: DataFrame, keep: Sequence[str], winner: str, loser: str,
                   id_name: str = "team_id", win_col: str = "win",
                   lose_col: str | None = "lose") -> DataFrame:
    """Narrow mirror: ids and outcome flags only."""
    return mirror(df, keep, {id_name: (winner, loser)}, None, win_col, lose_col)
