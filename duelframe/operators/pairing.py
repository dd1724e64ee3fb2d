"""Re-pair the two participant rows of a game into one model row.

Side assignment ranks ``concat(location, id)`` inside the game: by byte
order A < H < N, the away team is side 1, the home team side 2, and on a
neutral court the id that sorts first as a string is side 1.

The window partitions by the game key, so its output is hash-partitioned
by that key; the self-join of side 1 with side 2 on the same key then
needs no further exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.scalar import concat_key


def assign_sides(df: DataFrame, game: Sequence[str], loc: str, entity: str,
                 name: str = "side") -> DataFrame:
    w = Window.partitionBy(*game).orderBy(concat_key(loc, entity))
    return df.withColumn(name, F.dense_rank().over(w).cast("bigint"))


def suffixed(df: DataFrame, suffix: str, keep: Sequence[str]) -> list[Column]:
    """All columns renamed ``c + suffix`` except the keys in ``keep``."""
    return [F.col(c) if c in keep else F.col(c).alias(c + suffix) for c in df.columns]


def pair_sides(df: DataFrame, game: Sequence[str], loc: str, entity: str,
               shared: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """One row per pair of a side-1 and a side-2 row of a game: side 1 columns
    with suffix ``_A``, side 2 columns with suffix ``_B``; a game where only one
    side survived an earlier filter disappears (inner-join semantics), and rows
    that repeat a participant multiply as in a join. Rows with a null in
    ``game`` match nothing.

    The sides are ranked and gathered on the game key, so the pairing is one
    Exchange and the input plan is evaluated once; a game holds its
    participants' rows only.
    """
    keep = list(game) + list(shared)
    cols = [c for c in df.columns if c not in keep]
    row = F.struct(*[F.col(c) for c in df.columns if c not in game])
    sided = assign_sides(df.where(F.concat(*[F.col(c).cast("string") for c in game]).isNotNull()),
                         game, loc, entity, "_side")
    both = sided.groupBy(*game).agg(F.collect_list(F.when(F.col("_side") == 1, row)).alias("_a"),
                                    F.collect_list(F.when(F.col("_side") == 2, row)).alias("_b"))
    pairs = both.select(*game, F.explode("_a").alias("_a"), "_b").select(*game, "_a", F.explode("_b").alias("_b"))
    out = pairs.select(*game, *[F.col("_a")[c].alias(c) for c in shared],
                       *[F.col("_a")[c].alias(c + "_A") for c in cols],
                       *[F.col("_b")[c].alias(c + "_B") for c in cols])
    return out.drop(*drop) if drop else out


def pair_sides_join(df: DataFrame, game: Sequence[str], side: str = "side",
                    shared: Sequence[str] = (), drop: Sequence[str] = ()) -> DataFrame:
    """Literal form: inner self-join of side 1 (``_A``) with side 2
    (``_B``) on the game key. Every side-1 row meets every side-2 row of
    its game, so duplicated participant rows multiply as in a join."""
    keep = list(game) + list(shared)
    a = df.where(F.col(side) == 1).drop(side)
    b = df.where(F.col(side) == 2).drop(side, *shared)
    a = a.select(suffixed(a, "_A", keep))
    b = b.select(suffixed(b, "_B", list(game)))
    out = a.join(b, list(game), "inner")
    return out.drop(*drop) if drop else out
