"""Dictionary codes of categories as tables.

The distinct values of the training rows are numbered in order of (column, value), so a
column's codes follow each other and all columns together number the inputs of a model
from 0. Numbers are positions in a global order (``ordinal_within``), cut over many tasks
where there are many values; no list of values is on the driver. Rows become sparse: one
row (key, column, code) for each value that training has seen, none for any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.hot import find_cuts
from duelframe.operators.ordinal import ordinal_within
from duelframe.operators.written import written


def _long(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return (df.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot(list(keys), list(columns), "column", "value").where("value is not null"))


def fit_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(``column``, ``value``, ``code``): every distinct value of ``train`` as a string, nulls
    apart, numbered from 0 over all columns in order of column name and value."""
    values = written(_long(train, [], columns).distinct(), "values")
    order = ["column", "value"]
    return written(ordinal_within(values, [], order, "code", find_cuts(values, [], order)), "codes")


def encode_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], codes: DataFrame) -> DataFrame:
    """(``keys``, ``column``, ``code``) of ``df``: a row for each value that ``codes`` has. The
    join is by the size of ``codes``; a value that holds a large share of the rows is split
    by the skewed join like any other key."""
    return _long(df, keys, columns).join(codes, ["column", "value"]).select(*keys, "column", "code")
