"""Per-entity sequence features over explicit window specifications.

Every window orders by a *total* key (the caller passes a unique
tiebreak), so results never depend on the physical row order. Features
that share partition and order keys are meant to go into one ``select``:
Catalyst then plans a single Exchange + Sort + Window for all of them,
even when the frames differ.

``include_current=False`` gives the pre-game (leak-free) value at a row,
computed only from earlier rows; ``True`` gives the post-game value used
for serving.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

UP = Window.unboundedPreceding
UF = Window.unboundedFollowing
CUR = Window.currentRow


def entity_window(partition: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*partition).orderBy(*order)


def _expanding_frame(w: WindowSpec, include_current: bool) -> WindowSpec:
    return w.rowsBetween(UP, CUR if include_current else -1)


def _rolling_frame(w: WindowSpec, n: int, include_current: bool) -> WindowSpec:
    return w.rowsBetween(-(n - 1), CUR) if include_current else w.rowsBetween(-n, -1)


def expanding_sum(c: str | Column, w: WindowSpec, include_current: bool = False) -> Column:
    """Running sum; the first row of a pre-game frame is null (no history)."""
    return F.sum(c).over(_expanding_frame(w, include_current))


def expanding_mean(c: str | Column, w: WindowSpec, include_current: bool = False) -> Column:
    return F.avg(c).over(_expanding_frame(w, include_current))


def rolling_sum(c: str | Column, w: WindowSpec, n: int = 5,
                include_current: bool = False) -> Column:
    """Sum of the last ``n`` rows, null until ``n`` non-null values exist
    (a full window is required, as with ``min_samples = window``)."""
    f = _rolling_frame(w, n, include_current)
    return F.when(F.count(c).over(f) == n, F.sum(c).over(f))


def rolling_mean(c: str | Column, w: WindowSpec, n: int = 5,
                 include_current: bool = False) -> Column:
    f = _rolling_frame(w, n, include_current)
    return F.when(F.count(c).over(f) == n, F.avg(c).over(f))


def ratio_of_sums(win: str | Column, lose: str | Column, w: WindowSpec,
                  n: int | None = None, include_current: bool = False,
                  zero_as_nan: bool = True) -> Column:
    """Win share ``W / (W + L)`` over an expanding (``n=None``) or last-n
    frame. With no decided games the share is 0/0: NaN when
    ``zero_as_nan`` (a later numeric fill turns it into 0), else null."""
    if n is None:
        ws, ls = expanding_sum(win, w, include_current), expanding_sum(lose, w, include_current)
    else:
        ws, ls = rolling_sum(win, w, n, include_current), rolling_sum(lose, w, n, include_current)
    tot = ws + ls
    share = F.try_divide(ws.cast("double"), tot.cast("double"))
    if zero_as_nan:
        share = F.when(tot == 0, F.lit(float("nan"))).otherwise(share)
    return share


def running_min(c: str | Column, w: WindowSpec) -> Column:
    """Best (lowest) value so far including today; nulls are skipped and
    the last minimum is carried over null rows."""
    return F.min(c).over(w.rowsBetween(UP, CUR))


def forward_fill(c: str | Column, w: WindowSpec) -> Column:
    return F.last(c, ignorenulls=True).over(w.rowsBetween(UP, CUR))


def backward_fill(c: str | Column, w: WindowSpec) -> Column:
    return F.first(c, ignorenulls=True).over(w.rowsBetween(CUR, UF))


def exclusive_running_sum(c: str | Column, w: WindowSpec) -> Column:
    """Sum of all earlier rows ("wins coming in"): 0 on the first row."""
    x = F.col(c) if isinstance(c, str) else c
    return F.sum(x).over(w.rowsBetween(UP, CUR)) - x


def sequence_number(w: WindowSpec, dense: bool = False) -> Column:
    """1-based position in the entity's order, as bigint."""
    return (F.dense_rank() if dense else F.row_number()).over(w).cast("bigint")


def partition_count(c: str | Column, partition: Sequence[str]) -> Column:
    """Non-null count over an unordered partition."""
    return F.count(c).over(Window.partitionBy(*partition)).cast("bigint")


def skip_first(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column],
               n: int = 5, name: str = "game_number") -> DataFrame:
    """Drop each entity's first ``n`` rows (warm-up cut)."""
    w = entity_window(partition, order)
    return df.withColumn(name, sequence_number(w)).where(F.col(name) > n)


def latest(df: DataFrame, partition: Sequence[str], order_desc: Sequence[str]) -> DataFrame:
    """The single latest row per entity. ``order_desc`` must end in a
    unique key so a team playing twice on its last day keeps one row.
    Spark plans a partial ``WindowGroupLimit`` before the shuffle."""
    w = Window.partitionBy(*partition).orderBy(*[F.col(c).desc() for c in order_desc])
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")


def days_since_previous(day: str, w: WindowSpec) -> Column:
    """Rest days: ``day - previous day`` of the same entity; null on the first row."""
    return (F.col(day) - F.lag(day, 1).over(w)).cast("bigint")


def with_streak(df: DataFrame, partition: Sequence[str], order: Sequence[str | Column],
                flag_col: str, name: str, include_current: bool = False) -> DataFrame:
    """Length of the run of ``flag_col == 1`` ending at each row
    (gaps-and-islands). Every row that is not a 1 opens a new island; the
    streak is the count of 1-rows in the island so far. The second window
    refines the first one's partition keys, so it reuses its shuffle.
    Pre-game (``include_current=False``): the streak coming into the row,
    0 on an entity's first row."""
    w = entity_window(partition, order)
    one = F.when(F.col(flag_col) == 1, 1).otherwise(0)
    island = F.sum(1 - one).over(w.rowsBetween(UP, CUR))
    w_island = entity_window([*partition, "_island"], order)
    out = (df.withColumn("_island", island)
             .withColumn(name, F.sum(one).over(w_island.rowsBetween(UP, CUR)).cast("bigint")))
    if not include_current:
        out = out.withColumn(name, F.coalesce(F.lag(name, 1).over(w), F.lit(0).cast("bigint")))
    return out.drop("_island")


def dense_rank_of(df: DataFrame, entity: Sequence[str], key: str, name: str) -> DataFrame:
    """``dense_rank`` of ``key`` inside each entity without sorting rows:
    the distinct (entity, key) pairs are ranked (one row per pair) and the
    rank is joined back, so an entity with a huge share of the rows costs a
    partial aggregation and a join that AQE can split, not a single sort."""
    keys = df.select(*entity, key).distinct()
    ranked = keys.withColumn(name, F.row_number().over(
        Window.partitionBy(*entity).orderBy(key)).cast("bigint"))
    from duelframe.operators.keys import join_on_keys
    return join_on_keys(df, ranked, [*entity, key], "inner")
