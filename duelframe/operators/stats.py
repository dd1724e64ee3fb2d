"""Global statistics computed without funnelling rows into one task.

``exact_medians`` avoids ``percentile``/``median``, whose aggregation buffer holds every
value of the group in one task: the two middle positions of each column are selected by
narrowing (``select``), so no row and no table of distinct values is shuffled. The median
is the mean of the values at positions ``floor((n-1)/2)`` and ``ceil((n-1)/2)`` from 0,
nulls and NaN ignored (the interpolated median of an even count).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.select import GRID, kth_values


def long_form(df: DataFrame, cols: Sequence[str], name: str = "column",
              value: str = "v") -> DataFrame:
    """Unpivot numeric columns to (column, value) rows, as double."""
    return (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
              .unpivot([], list(cols), name, value))


def global_min_max(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    aggs = []
    for c in cols:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")]
    return df.agg(*aggs)


def exact_medians(df: DataFrame, cols: Sequence[str], buckets: int = GRID) -> DataFrame:
    """One row per column: ``column``, ``median`` (double; null if no values). ``buckets``:
    quantiles that a round of the selection looks at."""
    rows = long_form(df, cols).where(F.col("v").isNotNull() & ~F.isnan("v"))
    sizes = rows.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    middle = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    found = kth_values(rows, ["column"], "v", sizes.withColumn("k", F.explode(F.array_distinct(middle))), buckets)
    names = df.sparkSession.createDataFrame([(c,) for c in cols], "column string")
    return names.join(found.groupBy("column").agg(F.avg("value").alias("median")), "column", "left")


def mean_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: mean and *population* standard deviation (what a
    standard scaler divides by), all in one partial aggregation of the rows as they are."""
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.avg(F.col(c).cast("double")).alias("mean"),
                            F.stddev_pop(F.col(c).cast("double")).alias("std")).alias(f"_{i}") for i, c in enumerate(cols)])
    return one.select(F.explode(F.array(*[f"_{i}" for i in range(len(cols))])).alias("s")).select("s.*")


def brier_score(df: DataFrame, label: str, prob: str) -> DataFrame:
    """Mean squared error of a probability against a 0/1 label."""
    return df.agg(F.avg(F.pow(F.col(label).cast("double") - F.col(prob), 2)).alias("brier"))
