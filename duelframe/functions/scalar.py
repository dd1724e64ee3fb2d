"""Column-level helpers: every function returns a JVM-side ``Column``.

No Python UDF is involved anywhere; these compile into whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

def nan() -> Column:
    return F.lit(float("nan"))


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` that yields null where ``den`` is 0 (ANSI mode throws
    on plain division by zero). A zero-attempt row then drops out of
    running means instead of poisoning them."""
    return F.try_divide(col(num).cast("double"), col(den).cast("double"))


def nan_ratio(num: str | Column, den: str | Column) -> Column:
    """True division with IEEE results: 0/0 -> NaN, n/0 -> +-inf.

    This is the value a dataframe library without ANSI checks produces; a
    NaN carried into a running sum stays NaN for the rest of the frame.
    """
    n, d = col(num).cast("double"), col(den).cast("double")
    return (F.when(d != 0, n / d)
             .when(n.isNull() | d.isNull(), F.lit(None).cast("double"))
             .when(n == 0, nan())
             .when(n > 0, F.lit(float("inf")))
             .otherwise(F.lit(float("-inf"))))


def code_number(code: str | Column, start: int = 2, length: int = 2,
                lenient: bool = False) -> Column:
    """Digits inside a code string -> int, e.g. seed ``W16a`` -> 16.

    ``start`` is 1-based (Spark ``substring``). The strict cast fails the
    job on a non-numeric slice, like a strict cast would; ``lenient`` turns
    such a slice into null instead.
    """
    piece = F.substring(col(code), start, length)
    return piece.try_cast("int") if lenient else piece.cast("int")


def concat_key(*parts: str | Column) -> Column:
    """String concatenation of mixed types; null if any part is null."""
    return F.concat(*[col(p).cast("string") for p in parts])


def flag(cond: Column) -> Column:
    """1 where ``cond`` holds, else 0 (null counts as not holding)."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def in_set_flag(c: str | Column, values: Iterable, extra: Column | None = None,
                negate: bool = False) -> Column:
    """Membership flag with three-valued logic: a null value takes neither
    the ``isin`` nor the negated branch, as in the reference."""
    member = col(c).isin(list(values))
    cond = ~member if negate else member
    if extra is not None:
        cond = cond & extra
    return flag(cond)


def half_open(c: str | Column, lo, hi) -> Column:
    """``lo <= c < hi``; Spark ``between`` is closed on both ends."""
    return (col(c) >= F.lit(lo)) & (col(c) < F.lit(hi))


def day_range(start: str | Column, end: str | Column) -> Column:
    """Inclusive integer list ``[start .. end]``; empty when ``end < start``.

    ``sequence`` would count down for ``end < start``; the guard keeps the
    empty-range meaning of ``range(start, end + 1)``.
    """
    s, e = col(start).cast("bigint"), col(end).cast("bigint")
    return F.when(e >= s, F.sequence(s, e)).otherwise(F.array().cast("array<bigint>"))


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Per-column constant fill of nulls (``coalesce``), one projection."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def fill_numeric(df: DataFrame, value: float = 0) -> DataFrame:
    """Whole-frame fill of null *and* NaN in numeric columns; strings keep
    their nulls. ``na.fill`` with a number does both in one projection."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return df.na.fill(value, subset=numeric) if numeric else df


def rounded(c: str | Column, places: int = 6) -> Column:
    return F.round(col(c).cast("double"), places)
