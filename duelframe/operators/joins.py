"""Dimension enrichment: mark joins, keyed lookups, validity-interval joins.

Join strategy is left to Catalyst/AQE: a dimension whose *measured* size
is under ``spark.sql.autoBroadcastJoinThreshold`` is broadcast, anything
larger goes through a sort-merge join on the equi keys. No join here forces
a broadcast of data whose size grows with the input.

Validity intervals are joined by union and carry (``asof``): no range condition between
the sides, no explode of intervals into days.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.asof import asof_join
from duelframe.operators.hot import Cuts


def _on(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
        right_keys: Sequence[str]) -> Column:
    cond = None
    for lk, rk in zip(left_keys, right_keys):
        c = left[lk] == right[rk]
        cond = c if cond is None else cond & c
    return cond


def mark_join(df: DataFrame, marks: DataFrame, keys: Sequence[str],
              name: str = "mark", mark_keys: Sequence[str] | None = None) -> DataFrame:
    """``name`` = 1 where ``df``'s key occurs in ``marks``, else 0.

    The mark side is reduced to its distinct keys first, so a key repeated
    in ``marks`` cannot multiply rows of ``df`` (a plain left join would).
    """
    mark_keys = list(mark_keys or keys)
    m = (marks.select(*[F.col(mk).alias(k) for mk, k in zip(mark_keys, keys)])
              .distinct().withColumn("_hit", F.lit(1)))
    return (df.join(m, list(keys), "left")
              .withColumn(name, F.coalesce(F.col("_hit"), F.lit(0)))
              .drop("_hit"))


def dim_lookup(df: DataFrame, dim: DataFrame, left_keys: Sequence[str],
               right_keys: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Left lookup of ``dim`` columns (``dim_col -> output name``) where
    ``df[left_keys] == dim[right_keys]``; the key names may differ. Call it
    twice with different keys for a winner-side and a loser-side lookup.
    The dimension must be unique on its keys (see ``assert_unique``)."""
    rk = [f"_k{i}" for i in range(len(right_keys))]
    d = dim.select(*[F.col(k).alias(a) for k, a in zip(right_keys, rk)],
                   *[F.col(c).alias(o) for c, o in values.items()])
    return df.join(d, _on(df, d, left_keys, rk), "left").drop(*rk)


def interval_join(df: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str,
                  start: str, end: str, how: str = "inner",
                  interval_keys: Sequence[str] | None = None, cuts: Cuts | None = None) -> DataFrame:
    """Rows of ``df`` matched with every interval of the same key that
    contains ``point`` (``start <= point <= end``), by ``asof_join``.

    ``inner``: rows without a covering interval drop out and overlapping
    intervals duplicate a row (a left join followed by a range filter
    behaves exactly so). ``left``: uncovered rows are kept with nulls.
    ``left_semi``: keep covered rows once, no interval columns.
    """
    return asof_join(df, intervals, keys, point, start, end, how, interval_keys, cuts=cuts)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs more than once (empty when the key
    is unique). A lazy check: run ``.isEmpty()`` on it where it matters."""
    return df.groupBy(*keys).count().where(F.col("count") > 1)


def band_lookup(df: DataFrame, bands: DataFrame, key: str, value: str,
                band_key: str, lo: str, hi: str, label: str) -> DataFrame:
    """Classify ``value`` into the band of the same ``key`` with
    ``lo <= value <= hi`` (an open top band has ``hi`` null). ``bands`` is
    a fixed table of a few rows, so it is broadcast by size."""
    b = bands.select(F.col(band_key).alias("_bk"), F.col(lo).alias("_lo"),
                     F.col(hi).alias("_hi"), F.col(label).alias(label))
    cond = ((df[key] == b["_bk"]) & (df[value] >= b["_lo"])
            & (b["_hi"].isNull() | (df[value] <= b["_hi"])))
    return df.join(F.broadcast(b), cond, "left").drop("_bk", "_lo", "_hi")
