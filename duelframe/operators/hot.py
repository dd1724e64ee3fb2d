"""Slices of hot groups, so that one group's ordered rows need not be one task.

A window sorts each group in one task, and AQE cannot split a window partition. Every
group of more than ``HOT_ROWS`` rows is therefore cut along its order: into as many
slices as its rows need at about a quarter of ``HOT_ROWS`` each. The cuts are rows of the
data itself, compared as a whole by the order's columns, so they fall between rows
whatever the columns' types and values. Windows then run by (group, slice); rows of any
other group are slice 0, and only hot groups need offsets and carried rows.

Cuts come from a sample by hash of the order columns (one row in some thousands), so
the table of cuts holds at most one row's order columns for each slice: with 500,000 rows
to a slice, 10^12 rows make two million cuts.

``find_cuts`` looks for hot groups at once (one aggregate over the group columns) and
writes the cuts; where there are none, windows are planned plainly. The result serves all
windows over the same groups and order. ``lazy_cuts`` leaves the search in the plan.
Either way, and at every size, the rows are the same.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.keys import nonnull_keys
from duelframe.operators.written import written

HOT_ROWS = 2_000_000
SLICES_A_HOT_GROUP = 4  # the least: a slice has HOT_ROWS / 4 rows
SAMPLED = 32  # rows of the sample to a slice
MAX_BROADCAST_CUTS = 1_000_000
CONF = "spark.duelframe.hotRows"  # a session can set another number of rows


def hot_rows(spark) -> int:
    return int(spark.conf.get(CONF, str(HOT_ROWS)))


@dataclass(frozen=True)
class Cuts:
    """``table``: the stand-ins of a hot group's keys (``nonnull_keys``) and ``_cuts``, an
    array of structs of the order columns; None without hot groups. ``small``: whether
    the table may be broadcast. ``fixed``: whether it was written."""

    table: DataFrame | None
    small: bool = True
    fixed: bool = True


def _sizes(base: DataFrame, keys: list[str], most: int) -> DataFrame:
    return base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > most).select(*keys)


def _cut_table(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    base, keys = nonnull_keys(df.select(*dict.fromkeys([*group, *order])), group)
    rows = max(1, most // SLICES_A_HOT_GROUP)
    every = min(SAMPLED, rows)
    sample = (base.where(F.pmod(F.xxhash64(*order), F.lit(rows // every)) == 0)
              .join(_sizes(base, keys, most), keys, "left_semi"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (sample.select(*keys, F.struct(*order).alias("_at"), place.alias("_r")).where(F.col("_r") % every == 0)
            .groupBy(*keys).agg(F.array_sort(F.collect_list("_at")).alias("_cuts")))


def lazy_cuts(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> Cuts:
    return Cuts(_cut_table(df, group, order, hot_rows(df.sparkSession)), fixed=False)


def find_cuts(df: DataFrame, group: Sequence[str], order: Sequence[str], most: int | None = None) -> Cuts:
    """Cuts of the groups of ``df``: the rows of a window, or a cheaper table with as many
    rows of each group or more and the same order columns. ``most``: rows of a group that
    need no cut, by default those of the session."""
    most = hot_rows(df.sparkSession) if most is None else most
    base, keys = nonnull_keys(df.select(*group), group)
    if _sizes(base, keys, most).isEmpty():
        return Cuts(None)
    table = written(_cut_table(df, group, order, most), "cuts")
    return Cuts(table, (table.agg(F.sum(F.size("_cuts"))).first()[0] or 0) <= MAX_BROADCAST_CUTS)


def slice_of(at: Column, cuts: Column) -> Column:
    """Number of cuts below ``at`` by binary search; 0 for null cuts."""
    def step(s: Column, _: Column) -> Column:
        half = F.shiftright(s["lo"] + s["hi"], 1)
        below = F.get(cuts, half) < at
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(
            F.when(below, half + 1).otherwise(s["lo"]).alias("lo"),
            F.when(below, s["hi"]).otherwise(half).alias("hi")))

    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(cuts).cast("bigint"))))
    found = F.aggregate(rounds, F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi")), step, lambda s: s["lo"])
    return F.when(cuts.isNull(), F.lit(0)).otherwise(found)


def sliced(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Cuts) -> DataFrame:
    """``df`` (with the stand-ins ``keys``) and ``_sl``, a row's slice, and ``_hot``."""
    table = F.broadcast(cuts.table) if cuts.small else cuts.table
    at = F.struct(*order).cast(cuts.table.schema["_cuts"].dataType.elementType)
    joined = df.join(table, list(keys), "left")
    out = joined.withColumns({"_sl": slice_of(at, F.col("_cuts")), "_hot": F.col("_cuts").isNotNull()}).drop("_cuts")
    return written(out, "sliced") if cuts.fixed else out
