"""Interval and as-of joins by union and carry.

Points (games) and intervals (tenures, ranking periods) of a key go into one stream, sorted
by position with an interval's start before the points at it; the last interval seen is
carried along (``sliced_window``), and a point is matched if that interval has not ended.
One shuffle of both sides together, no range condition between them, and a key with a
large share of the points is cut over many tasks like any other window.

A carried value is one interval. Where intervals of a key overlap, what is carried is the
stretch that they cover together, and its points find their intervals by an equi-join:
an interval is the union of at most two aligned blocks of each power of two, and a point
lies in one block of each power, so every pair meets in exactly one block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.operators.hot import Cuts, find_cuts
from duelframe.operators.sliced import Feat, sliced_window
from duelframe.operators.written import written

STREAM = ("_at", "_kind", "_tie")


def _whole(df: DataFrame, name: str) -> Column:
    """A position as a whole number."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    raise TypeError(f"{name}: positions are whole numbers, dates or timestamps")


def stream_cuts(points: DataFrame, keys: Sequence[str], point: str) -> Cuts:
    """Cuts of the busy keys of ``points``, or of a cheaper table with the same columns."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = points.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], _whole(points, point).alias("_at"),
                         F.lit(1).alias("_kind"), F.xxhash64(*points.columns).alias("_tie"))
    return find_cuts(rows, names, STREAM)


def _spans(iv: DataFrame, names: list[str]) -> DataFrame:
    """Stretches that overlapping intervals cover together: ``_s``, ``_e``, the number ``_n`` of
    intervals, and ``_iv`` of one of them."""
    starts = iv.groupBy(*names, "_s").agg(F.max("_e").alias("_e"), F.count(F.lit(1)).alias("_n"), F.first("_iv").alias("_iv"))
    cuts = find_cuts(iv, names, ["_s"])
    reach = sliced_window(starts, names, ["_s"], [Feat("_before", "max", "_e")], cuts)
    new = F.coalesce(F.col("_s") > F.col("_before"), F.lit(True)).cast("int")
    numbered = sliced_window(reach.withColumn("_new", new), names, ["_s"], [Feat("_span", "sum", "_new", None, True)], cuts)
    return numbered.groupBy(*names, "_span").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e"), F.sum("_n").alias("_n"),
                                                 F.first("_iv").alias("_iv")).drop("_span")


def _blocks(iv: DataFrame, spans: DataFrame, names: list[str]) -> DataFrame:
    """Aligned blocks (``_level``, ``_no``) of the intervals in stretches of several, counted
    from the stretch's start ``_from``."""
    several = spans.where("_n > 1").select(*names, F.col("_s").alias("_from"), F.col("_e").alias("_to"))
    # the stretches of a key are disjoint, so this join is one by carry again
    inside = asof_join(iv, several, names, "_s", "_from", "_to", disjoint=True)
    lo, hi = F.col("_s") - F.col("_from"), F.col("_e") - F.col("_from") + 1

    levels = F.explode(F.sequence(F.lit(0), F.length(F.bin(F.col("_hi")))))
    rows = inside.select(*names, "_from", "_iv", lo.alias("_lo"), hi.alias("_hi")).withColumn("_l", levels)
    low = F.expr("shiftright(_lo + shiftleft(1L, _l) - 1, _l)")
    high = F.expr("shiftright(_hi, _l)")
    both = F.array(F.when((low < high) & (low % 2 == 1), low), F.when((low < high) & (high % 2 == 1), high - 1))
    return (rows.select(*names, "_from", "_iv", F.col("_l").alias("_level"), F.explode(both).alias("_no"))
            .where("_no is not null"))


def asof_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str,
              how: str = "inner", interval_keys: Sequence[str] | None = None, disjoint: bool = False,
              cuts: Cuts | None = None) -> DataFrame:
    """Rows of ``points`` with the intervals of the same key that contain ``point``
    (``start <= point <= end``) and the intervals' other columns.

    ``inner``: a point with several intervals is repeated, one with none drops out; ``left``
    keeps it with nulls; ``left_semi`` and ``left_anti`` keep covered and uncovered points
    once. A null key or position is in no interval; an interval with a null key or bound,
    or that ends before it starts, contains nothing. ``disjoint``: the intervals of a key
    are known not to overlap. ``cuts``: ``stream_cuts`` of the points, found here if None.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"no join {how}")
    of = list(interval_keys or keys)
    extra = [c for c in intervals.columns if c not in of]
    names = [f"_k{i}" for i in range(len(of))]
    while set(names) & set(points.columns):
        names = [f"_{n}" for n in names]
    iv = (intervals.select(*[F.col(k).alias(n) for k, n in zip(of, names)], _whole(intervals, start).alias("_s"),
                           _whole(intervals, end).alias("_e"), F.struct(*extra).alias("_iv"))
          .dropna(subset=[*names, "_s", "_e"]).where("_s <= _e"))
    cuts = stream_cuts(points, keys, point) if cuts is None else cuts
    spans, blocks = iv.withColumn("_n", F.lit(1).cast("long")), None
    if not disjoint:
        iv = written(iv, "intervals")
        spans = written(_spans(iv, names), "spans")
        if how in ("inner", "left") and not spans.where("_n > 1").isEmpty():
            blocks = written(_blocks(iv, spans, names), "blocks")

    span = F.struct(F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("_n").alias("n"), F.col("_iv").alias("iv"))
    starts = spans.select(*names, F.col("_s").alias("_at"), F.lit(0).alias("_kind"), F.lit(0).cast("long").alias("_tie"),
                          span.alias("_span"))
    rows = points.select(*points.columns, *[F.col(k).alias(n) for k, n in zip(keys, names)], _whole(points, point).alias("_at"),
                         F.lit(1).alias("_kind"), F.xxhash64(*points.columns).alias("_tie"))
    stream = sliced_window(rows.unionByName(starts, allowMissingColumns=True), names, STREAM,
                           [Feat("_last", "ffill", "_span")], cuts)
    covered = F.coalesce(F.col("_last.e") >= F.col("_at"), F.lit(False))
    hit = stream.where("_kind = 1")
    if how in ("left_semi", "left_anti"):
        return hit.where(covered if how == "left_semi" else ~covered).select(*points.columns)
    found = hit.select(*points.columns, *names, "_at", F.when(covered, F.col("_last")).alias("_last"))
    if how == "inner":
        found = found.where("_last is not null")
    if blocks is not None:
        length = F.col("_last.e") - F.col("_last.s") + 1
        levels = F.when(F.col("_last.n") > 1, F.sequence(F.lit(0), F.length(F.bin(length.cast("long")))))
        probes = found.withColumn("_level", F.explode_outer(levels)).withColumn(
            "_no", F.expr("shiftright(_at - _last.s, _level)"))
        on = ([F.col(n) == F.col(f"_b{n}") for n in names]
              + [F.col("_last.s") == F.col("_from"), F.col("_level") == F.col("_blevel"), F.col("_no") == F.col("_bno")])
        other = blocks.select(*[F.col(n).alias(f"_b{n}") for n in names], "_from", F.col("_level").alias("_blevel"),
                              F.col("_no").alias("_bno"), F.col("_iv").alias("_one"))
        found = (probes.join(other, on, "left").where("_level is null or _one is not null")
                 .withColumn("_found", F.when(F.col("_level").isNull(), F.col("_last.iv")).otherwise(F.col("_one"))))
    else:
        found = found.withColumn("_found", F.col("_last.iv"))
    return found.select(*points.columns, *[F.col("_found")[c].alias(c) for c in extra])
