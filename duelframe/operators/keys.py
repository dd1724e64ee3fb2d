"""Joins on grouping keys that may be null.

A window or ``groupBy`` puts all null keys in one group; an ordinary
equi-join then loses those rows (``NULL = NULL`` is not true). Joining
per-group results back onto rows therefore uses null-safe equality, which
Spark still plans as an equi-join (hash or sort-merge on the keys).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with null-safe key equality; the
    key columns appear once, taken from ``left``."""
    if not keys:
        raise ValueError("join_on_keys needs at least one key")
    alias = {k: f"_rk_{i}" for i, k in enumerate(keys)}
    r = right.withColumnsRenamed(alias)
    cond = None
    for k, a in alias.items():
        c = left[k].eqNullSafe(r[a])
        cond = c if cond is None else cond & c
    return left.join(r, cond, how).drop(*alias.values())


def nonnull_keys(df: DataFrame, keys: Sequence[str], prefix: str = "_nk") -> tuple[DataFrame, list[str]]:
    """Add, per key, a pair of never-null columns ``(isnull(k), coalesce(k, default))``
    that group exactly like ``k`` (one group for nulls). Partitioning,
    aggregating and joining on these keeps a single hash partitioning
    through a plan - a null-safe join condition would hash other
    expressions and re-shuffle the large side. Without keys all rows get one
    and the same stand-in."""
    from pyspark.sql import functions as F
    from pyspark.sql.types import BooleanType, NumericType, StringType
    types = {f.name: f.dataType for f in df.schema.fields}
    if not keys:
        return df.withColumn(f"{prefix}0v", F.lit(0)), [f"{prefix}0v"]
    cols, names = {}, []
    for i, k in enumerate(keys):
        t = types[k]
        if isinstance(t, StringType):
            val = F.coalesce(F.col(k), F.lit(""))
        elif isinstance(t, (NumericType, BooleanType)):
            val = F.coalesce(F.col(k), F.lit(0).cast(t))
        else:
            val = F.coalesce(F.col(k).cast("string"), F.lit(""))
        cols[f"{prefix}{i}n"] = F.col(k).isNull()
        cols[f"{prefix}{i}v"] = val
        names += [f"{prefix}{i}n", f"{prefix}{i}v"]
    return df.withColumns(cols), names
