"""Running state of an entity that can be merged.

A state summarises the rows of an entity in an order: counts and sums for expanding means,
the last n values for rolling means, the extremes, the run of ones at the beginning and at
the end, and the first and last place. States of two stretches of rows, one after the
other, merge into the state of both, and merging is associative: a log is summarised in
parallel by any cut of it, and new rows update yesterday's state without reading the
history. Serving features are read off the state alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.hot import find_cuts, sliced
from duelframe.operators.keys import nonnull_keys
from duelframe.operators.written import written

LISTED = 20_000


def row_states(df: DataFrame, entity: Sequence[str], order: Sequence[str], values: Sequence[str], flag: str) -> DataFrame:
    """The state of every row for itself. ``values``: what is summed and kept; ``flag``: a 0/1
    column whose runs of 1 are kept. ``order`` tells the rows of an entity apart."""
    at = F.struct(*order)
    run = (F.coalesce(F.col(flag) == 1, F.lit(False))).cast("long")
    one = {"first": at, "last": at, "rows": F.lit(1).cast("long"), "head_run": run, "tail_run": run}
    for v in values:
        x = F.col(v).cast("double")
        one |= {f"sum_{v}": F.coalesce(x, F.lit(0.0)), f"cnt_{v}": F.col(v).isNotNull().cast("long"), f"min_{v}": x, f"max_{v}": x,
                f"ring_{v}": F.array(x)}
    return df.select(*entity, *[c.alias(k) for k, c in one.items()])


def merge_states(states: DataFrame, entity: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """One state of each entity out of the states of disjoint stretches of its order.

    No task holds a list of more than ``LISTED`` stretches: as long as an entity has more,
    its stretches are merged in slices of neighbours (``hot``), a slice to a state.
    """
    cols = [c for c in states.columns if c not in entity]

    def merged(df: DataFrame, by: list[str]) -> DataFrame:
        one = F.struct("first", *[c for c in cols if c != "first"])
        listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("_s"))
        zero = F.lit(0).cast("long")
        runs = F.aggregate(
            "_s", F.struct(zero.alias("rows"), zero.alias("head"), zero.alias("tail")),
            lambda a, s: F.struct(
                (a["rows"] + s["rows"]).alias("rows"),
                F.when(a["head"] == a["rows"], a["rows"] + s["head_run"]).otherwise(a["head"]).alias("head"),
                F.when(s["tail_run"] == s["rows"], a["tail"] + s["rows"]).otherwise(s["tail_run"]).alias("tail")))

        def each(name: str) -> Column:
            return F.transform("_s", lambda s: s[name])

        def total(name: str, start: Column) -> Column:
            return F.aggregate(each(name), start, lambda a, x: a + x)

        made = {"first": F.get("_s", F.lit(0))["first"], "last": F.element_at("_s", -1)["last"], "rows": F.col("_r.rows"),
                "head_run": F.col("_r.head"), "tail_run": F.col("_r.tail")}
        for v in values:
            rings = F.flatten(each(f"ring_{v}"))
            made |= {f"sum_{v}": total(f"sum_{v}", F.lit(0.0)), f"cnt_{v}": total(f"cnt_{v}", zero),
                     f"min_{v}": F.array_min(each(f"min_{v}")),
                     f"max_{v}": F.array_max(each(f"max_{v}")),
                     f"ring_{v}": F.slice(rings, F.greatest(F.size(rings) - n + 1, F.lit(1)), n)}
        return listed.withColumn("_r", runs).select(*by, *[c.alias(k) for k, c in made.items()])

    while (cuts := find_cuts(states, entity, ["first"], LISTED)).table is not None:
        base, keys = nonnull_keys(states, entity)
        states = written(merged(sliced(base, keys, ["first"], cuts), [*entity, "_sl"]).drop("_sl"), "states")
    return merged(states, list(entity))


def state_features(state: DataFrame, entity: Sequence[str], values: Sequence[str], n: int) -> DataFrame:
    """``mean_v``, ``last_v`` (mean of the last ``n``, null unless all ``n`` are there), extremes and the
    present run, from the state alone."""
    out = [F.col("rows"), F.col("tail_run").alias("run")]
    for v in values:
        ring = F.filter(f"ring_{v}", lambda x: x.isNotNull())
        out += [F.when(F.col(f"cnt_{v}") > 0, F.col(f"sum_{v}") / F.col(f"cnt_{v}")).alias(f"mean_{v}"),
                F.when(F.size(ring) == n, F.aggregate(ring, F.lit(0.0), lambda a, x: a + x) / n).alias(f"last_{v}"),
                F.col(f"min_{v}"), F.col(f"max_{v}")]
    return state.select(*entity, *out)
