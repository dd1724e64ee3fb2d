"""Position of each row inside a group, whatever the group's size.

``ROW_NUMBER() OVER (PARTITION BY g ORDER BY k)`` sorts each group in a
single task. When a group holds a large share of the data (five event
types for a whole event log) that task is the job. Here a hot group's order
is cut into slices between rows of the data (``hot``):

1. local position: ``row_number`` over ``(g, slice)`` - each sort is one slice;
2. sizes of hot groups' slices: ``count`` with map-side partial aggregation;
3. slice offsets: running sum of the sizes over ``g`` ordered by slice -
   a window over the small count table (one row per slice, not per row);
4. position = offset + local position; groups that are not hot have one
   slice and no offset.

All steps are deterministic (the order key must be total), so a lost
executor recomputes exactly the same numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.hot import Cuts, lazy_cuts, sliced
from duelframe.operators.keys import nonnull_keys


def _cut_rows(df: DataFrame, group: Sequence[str], order: Sequence[str], cuts: Cuts | None
              ) -> tuple[DataFrame, list[str], bool]:
    """Rows with their slices, the columns that tell groups apart, whether any is cut."""
    cuts = lazy_cuts(df, group, order) if cuts is None else cuts
    base, keys = nonnull_keys(df, group)
    return (base, keys, False) if cuts.table is None else (sliced(base, keys, order, cuts), keys, True)


def ordinal_within(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "ordinal",
                   cuts: Cuts | None = None) -> DataFrame:
    """Add ``name``: 0-based position of the row in its group under ``order``. ``group`` may
    be empty (one global order). ``cuts``: what ``find_cuts`` found for this group and
    order, by default looked for in the plan."""
    d, ik, cut = _cut_rows(df, group, order, cuts)
    if not cut:
        return d.withColumn(name, (F.row_number().over(Window.partitionBy(*ik).orderBy(*order)) - 1).cast("bigint")).select(
            *df.columns, name)
    w_local = Window.partitionBy(*ik, "_sl").orderBy(*order)
    local = d.withColumn("_local", F.row_number().over(w_local) - 1)
    sizes = d.where("_hot").groupBy(*ik, "_sl").agg(F.count(F.lit(1)).alias("_n"))
    # the offset window runs over the slice-size table (one row per slice)
    w_off = Window.partitionBy(*ik).orderBy("_sl").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*ik, "_sl", F.coalesce(F.sum("_n").over(w_off), F.lit(0)).alias("_off"))
    return (local.join(offsets, [*ik, "_sl"], "left")
            .withColumn(name, (F.coalesce("_off", F.lit(0)) + F.col("_local")).cast("bigint"))
            .select(*df.columns, name))


def pair_consecutive(df: DataFrame, group: Sequence[str], order: Sequence[str], cols: Sequence[str],
                     cuts: Cuts | None = None) -> DataFrame:
    """Pair positions (0, 1), (2, 3), ... of each group under ``order``:
    one row per pair with ``a_<c>`` / ``b_<c>`` for every column in
    ``cols``; a trailing unpaired row is dropped.

    The log is shuffled once, by group and slice. Inside a slice the
    partner is read with ``lead`` in the same window that numbers the rows.
    A pair that straddles two slices of a hot group is made of the previous
    slice's last row and this slice's first row; both come from the per-slice
    summary (``min_by`` / ``max_by`` with map-side partial aggregation), so
    those pairs are formed from a table with one row per slice.
    """
    d, ik, cut = _cut_rows(df, group, order, cuts)
    if not cut:
        w = Window.partitionBy(*ik).orderBy(*order)
        numbered = d.select(*group, *cols, F.row_number().over(w).alias("_local"),
                            *[F.lead(c, 1).over(w).alias(f"_b_{c}") for c in cols], F.lead(F.lit(1), 1).over(w).alias("_has_b"))
        return numbered.where((F.col("_local") % 2 == 1) & F.col("_has_b").isNotNull()).select(
            *group, *[F.col(c).alias(f"a_{c}") for c in cols], *[F.col(f"_b_{c}").alias(f"b_{c}") for c in cols])
    row = F.struct(*[F.col(c) for c in cols])
    key = F.struct(*[F.col(c) for c in order])
    sizes = d.where("_hot").groupBy(*ik, *group, "_sl").agg(F.count(F.lit(1)).alias("_n"),
                                                F.min_by(row, key).alias("_first"),
                                                F.max_by(row, key).alias("_last"))
    w_s = Window.partitionBy(*ik).orderBy("_sl")
    offs = sizes.select(*ik, *group, "_sl", "_n", "_first",
                        F.coalesce(F.sum("_n").over(w_s.rowsBetween(Window.unboundedPreceding, -1)),
                                   F.lit(0)).alias("_off"),
                        F.lag("_last", 1).over(w_s).alias("_prev_last"))
    w = Window.partitionBy(*ik, "_sl").orderBy(*order)
    local = d.select(*ik, *group, "_sl", *cols, (F.row_number().over(w) - 1).alias("_local"),
                     *[F.lead(c, 1).over(w).alias(f"_b_{c}") for c in cols],
                     F.lead(F.lit(1), 1).over(w).alias("_has_b"))
    j = local.join(offs.select(*ik, "_sl", "_off"), [*ik, "_sl"], "left")
    even = ((F.coalesce("_off", F.lit(0)) + F.col("_local")) % 2) == 0
    inner = j.where(even & F.col("_has_b").isNotNull()).select(
        *group, *[F.col(c).alias(f"a_{c}") for c in cols],
        *[F.col(f"_b_{c}").alias(f"b_{c}") for c in cols])
    edge = offs.where(((F.col("_off") % 2) == 1) & F.col("_prev_last").isNotNull()).select(
        *group, *[F.col("_prev_last")[c].alias(f"a_{c}") for c in cols],
        *[F.col("_first")[c].alias(f"b_{c}") for c in cols])
    return inner.unionByName(edge)
