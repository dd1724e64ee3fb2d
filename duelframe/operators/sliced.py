"""Entity windows that stay parallel when one entity holds most of the rows.

Without hot entities this is the plain window, one Exchange. With some, windows run per
``(entity, slice)``; see ``hot`` for what a slice is. All rows of any other entity are
slice 0. What a row of a hot entity needs from other slices comes from two tables over
hot entities alone:

* the **slice summary** (one row per slice: sums, counts, extremes, last and
  first non-null values, row count) accumulated over earlier / later slices with
  a window on the summary itself - for expanding aggregates, forward / backward
  fills and row numbers;
* the **carry table**: the last ``n`` rows of every slice, taken with a partial
  ``WindowGroupLimit`` (at most ``n`` rows per slice and map task cross the
  shuffle), positioned inside the entity and matched to the slice they precede -
  for last-``n`` frames and ``lag``. A slice has hundreds of thousands of rows,
  so the carried rows are a small part of them.

The full data is shuffled once, by ``(entity, slice)``; both helper tables join back on
that key. With cuts that were found beforehand the rows are written once with their
slices, and the three readings are of that table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.operators.hot import Cuts, lazy_cuts, sliced
from duelframe.operators.keys import nonnull_keys

UP, CUR = Window.unboundedPreceding, Window.currentRow

EXPANDING = ("sum", "count", "mean", "min", "max")


@dataclass(frozen=True)
class Feat:
    """One window feature.

    kind: ``sum count mean min max`` (expanding when ``n`` is None, else
    over the last ``n`` rows, null unless all ``n`` values are present -
    only ``sum``/``mean``/``count`` take ``n``), ``ffill`` (last non-null
    up to the row), ``bfill`` (first non-null from the row on), ``rownum``
    (1-based position), ``lag`` (previous row's value), ``run`` (rows with
    the value 1 in a row right before the row; up to it if inclusive).
    """
    name: str
    kind: str
    col: str | None = None
    n: int | None = None
    include_current: bool = False


def _combine_sum(a: Column, b: Column) -> Column:
    """Sum of two partial sums where null means "no values"."""
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(
        F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))


def _helpers(hot: DataFrame, entity: list[str], order: list[str], w, broken, feats: Sequence[Feat]
             ) -> tuple[DataFrame, DataFrame | None]:
    """Of every slice of a hot entity: what the slices before and after it add up to, and
    what the rows just before it do."""
    keys, sl = [*entity, "_sl"], ["_sl"]
    okey = F.struct(*[F.col(c) for c in order])
    expanding = [f for f in feats if f.kind in EXPANDING and f.n is None]
    rolling = [f for f in feats if f.kind in ("sum", "mean", "count") and f.n is not None]
    lags = [f for f in feats if f.kind == "lag"]
    ffills = [f for f in feats if f.kind == "ffill"]
    bfills = [f for f in feats if f.kind == "bfill"]
    runs = [f for f in feats if f.kind == "run"]

    # slice summary and its accumulation over earlier / later slices
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in sorted({f.col for f in expanding if f.kind in ("sum", "mean", "count")}):
        aggs += [F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_cnt_{c}")]
    for c in sorted({f.col for f in expanding if f.kind == "min"}):
        aggs.append(F.min(c).alias(f"_min_{c}"))
    for c in sorted({f.col for f in expanding if f.kind == "max"}):
        aggs.append(F.max(c).alias(f"_max_{c}"))
    for c in sorted({f.col for f in ffills}):
        aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_last_{c}"))
    for c in sorted({f.col for f in bfills}):
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), okey)).alias(f"_first_{c}"))
    if runs:
        hot = hot.withColumn("_k", F.row_number().over(w) - 1)
    for c in sorted({f.col for f in runs}):
        aggs.append(F.max(broken(c)).alias(f"_brk_{c}"))
    summary = hot.groupBy(*keys).agg(*aggs)
    ws = Window.partitionBy(*entity).orderBy(*sl)
    # what comes after a slice is seen from the end: a frame that only grows is added up as it goes
    before = ws.rowsBetween(UP, -1)
    after = Window.partitionBy(*entity).orderBy(*[F.col(c).desc() for c in sl]).rowsBetween(UP, -1)
    acc = [F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_o_rows")]
    for name in summary.columns:
        if name.startswith("_sum_"):
            acc.append(F.sum(name).over(before).alias("_o" + name))
        elif name.startswith("_cnt_"):
            acc.append(F.coalesce(F.sum(name).over(before), F.lit(0)).alias("_o" + name))
        elif name.startswith("_min_"):
            acc.append(F.min(name).over(before).alias("_o" + name))
        elif name.startswith("_max_"):
            acc.append(F.max(name).over(before).alias("_o" + name))
        elif name.startswith("_last_"):
            acc.append(F.last(name, ignorenulls=True).over(before).alias("_o" + name))
        elif name.startswith("_first_"):
            acc.append(F.last(name, ignorenulls=True).over(after).alias("_o" + name))
    breaks = [f"_brk_{f.col}" for f in runs]
    if breaks:  # positions in the entity: of the rows before a slice, and of the last break before it
        summary = summary.withColumn("_base", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        acc += [F.max(F.col("_base") + F.col(c)).over(before).alias("_o" + c) for c in set(breaks)]
    offsets = summary.select(*keys, *acc)

    # carry table: the rows just before each slice
    carry = None
    n_max = max([f.n for f in rolling] + ([1] if lags else []), default=0)
    carry_cols = sorted({f.col for f in rolling + lags})
    if n_max:
        w_rev = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
        tail = (hot.select(*keys, *order, *carry_cols, F.row_number().over(w_rev).alias("_r"))
                 .where(F.col("_r") <= n_max).drop("_r"))
        wt = Window.partitionBy(*entity).orderBy(*sl, *order)
        tail = tail.withColumn("_p", F.row_number().over(wt))
        first_pos = tail.groupBy(*keys).agg(F.min("_p").alias("_fp"))
        reach = tail.select(*entity, *carry_cols, "_p",
                            F.explode(F.sequence(F.col("_p") + 1, F.col("_p") + n_max)).alias("_fp"))
        matched = reach.join(first_pos, [*entity, "_fp"]).withColumn("_dist", F.col("_fp") - F.col("_p"))
        caggs = []
        for c in sorted({f.col for f in rolling}):
            caggs.append(F.array(*[F.sum(F.when(F.col("_dist") <= j, F.col(c))) for j in range(1, n_max + 1)])
                         .alias(f"_csum_{c}"))
            caggs.append(F.array(*[F.count(F.when(F.col("_dist") <= j, F.col(c))) for j in range(1, n_max + 1)])
                         .alias(f"_ccnt_{c}"))
        for c in sorted({f.col for f in lags}):
            caggs.append(F.max_by(F.col(c), F.when(F.col("_dist") == 1, F.lit(1))).alias(f"_clag_{c}"))
        carry = matched.groupBy(*keys).agg(*caggs)
    return offsets, carry


def sliced_window(df: DataFrame, entity: Sequence[str], order: Sequence[str], feats: Sequence[Feat],
                  cuts: Cuts | None = None) -> DataFrame:
    """Add ``feats`` over the rows of ``entity`` in ``order``. ``cuts``: what ``find_cuts``
    found for this entity and order, by default looked for in the plan."""
    entity, order = list(entity), list(order)
    cuts = lazy_cuts(df, entity, order) if cuts is None else cuts
    cut = cuts.table is not None
    if cut:
        base, entity = nonnull_keys(df, entity)
        d = sliced(base, entity, order, cuts)
        hot, sl = d.where("_hot"), ["_sl"]
    else:
        d, hot, sl = df, None, []
    keys = [*entity, *sl]
    w = Window.partitionBy(*keys).orderBy(*order)

    def broken(c: str) -> Column:
        """Position of the row in its slice if it ends a run of ``c``."""
        return F.when(F.coalesce(F.col(c) != 1, F.lit(True)), F.col("_k") + 1)

    offsets, carry = _helpers(hot, entity, order, w, broken, feats) if cut else (None, None)

    # ---- one window pass per (entity, slice)
    d = d.withColumn("_k", F.row_number().over(w) - 1)
    loc, back = {}, {}
    # a frame up to the last row would be read to its end for every row; backwards it only grows
    backwards = Window.partitionBy(*keys).orderBy(F.col("_k").desc()).rowsBetween(UP, CUR)
    for f in feats:
        c, cur = f.col, f.include_current
        if f.kind in EXPANDING and f.n is None:
            fr = w.rowsBetween(UP, CUR if cur else -1)
            if f.kind in ("sum", "mean", "count"):
                loc[f"_ls_{f.name}"] = F.sum(c).over(fr)
                loc[f"_lc_{f.name}"] = F.count(c).over(fr)
            else:
                loc[f"_lm_{f.name}"] = (F.min if f.kind == "min" else F.max)(c).over(fr)
        elif f.n is not None:
            fr = w.rowsBetween(-(f.n - 1), CUR) if cur else w.rowsBetween(-f.n, -1)
            loc[f"_ls_{f.name}"] = F.sum(c).over(fr)
            loc[f"_lc_{f.name}"] = F.count(c).over(fr)
        elif f.kind == "ffill":
            loc[f"_lf_{f.name}"] = F.last(c, ignorenulls=True).over(w.rowsBetween(UP, CUR))
        elif f.kind == "bfill":
            back[f"_lf_{f.name}"] = F.last(c, ignorenulls=True).over(backwards)
        elif f.kind == "lag":
            loc[f"_lf_{f.name}"] = F.lag(c, 1).over(w)
        elif f.kind == "run":
            loc[f"_lb_{f.name}"] = F.max(broken(c)).over(w.rowsBetween(UP, CUR if cur else -1))
    out = d.withColumns(loc).withColumns(back)
    for table in (offsets, carry):
        if table is not None:
            out = out.join(table, keys, "left")

    have = set(out.columns)

    def other(name: str) -> Column:
        """What the other slices of the row's entity add."""
        return F.col(name) if name in have else F.lit(None)

    k = F.col("_k")
    final = {}
    for f in feats:
        c, nm = f.col, f.name
        if f.kind in EXPANDING and f.n is None:
            if f.kind in ("min", "max"):
                pick = F.least if f.kind == "min" else F.greatest
                final[nm] = pick(F.col(f"_lm_{nm}"), F.col(f"_o_{f.kind}_{c}")) if cut else F.col(f"_lm_{nm}")
                continue
            s = _combine_sum(F.col(f"_ls_{nm}"), F.col(f"_o_sum_{c}")) if cut else F.col(f"_ls_{nm}")
            n = F.col(f"_lc_{nm}") + F.coalesce(other(f"_o_cnt_{c}"), F.lit(0))
            final[nm] = {"sum": s, "count": n,
                         "mean": F.when(n > 0, s / n)}[f.kind]
        elif f.n is not None:
            j = F.greatest(F.lit(f.n) - (k + 1 if f.include_current else k), F.lit(0))
            has = j > 0
            s, n = F.col(f"_ls_{nm}"), F.col(f"_lc_{nm}")
            if cut:
                s = _combine_sum(s, F.when(has, F.element_at(F.col(f"_csum_{c}"), j.cast("int"))))
                n = n + F.coalesce(F.when(has, F.element_at(F.col(f"_ccnt_{c}"), j.cast("int"))), F.lit(0))
            full = n == f.n
            final[nm] = {"sum": F.when(full, s), "count": n,
                         "mean": F.when(full, s / f.n)}[f.kind]
        elif f.kind == "ffill":
            final[nm] = F.coalesce(F.col(f"_lf_{nm}"), other(f"_o_last_{c}"))
        elif f.kind == "bfill":
            final[nm] = F.coalesce(F.col(f"_lf_{nm}"), other(f"_o_first_{c}"))
        elif f.kind == "lag":
            final[nm] = F.when(k > 0, F.col(f"_lf_{nm}")).otherwise(other(f"_clag_{c}"))
        elif f.kind == "run":
            base = F.coalesce(other("_o_rows"), F.lit(0))
            last = F.coalesce(base + F.col(f"_lb_{nm}"), other(f"_o_brk_{c}"), F.lit(0))
            final[nm] = (base + k + (1 if f.include_current else 0) - last).cast("bigint")
        elif f.kind == "rownum":
            final[nm] = (k + 1 + F.coalesce(other("_o_rows"), F.lit(0))).cast("bigint")
        else:
            raise ValueError(f"unsupported feature {f}")
    helper = sorted(x for x in have.difference(df.columns) if x.startswith("_"))
    return out.withColumns(final).drop(*helper)
