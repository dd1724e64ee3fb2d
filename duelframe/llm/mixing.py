"""Mixing of sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, read up to
``max_epochs`` times. A document copy has the virtual finish time (words of its
source up to and with it) / (weight of its source). All copies are range-sorted
by that time and the run is cut where the total budget is reached. A source that
runs dry leaves its share to the others by weight, which is also how the targets
are defined, so the cut lands each source within a document of its target.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.llm.tables import running_totals, saved

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than space and \\t..\\r; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fill_targets(sources: DataFrame, budget: int, max_epochs: int) -> DataFrame:
    """Add ``target`` to rows (``weight``, ``source_size``): the budget by weight,
    none above ``max_epochs`` times its size, the excess reshared by weight.

    Every round is one aggregate over the table of sources; only its two sums come
    to the driver. A round caps at least one source or is the last.
    """
    cap = F.col("source_size") * max_epochs
    level = 0.0  # budget for a unit of weight
    while True:
        open_ = cap > F.col("weight") * F.lit(level)
        row = sources.agg(F.sum(F.when(open_, F.col("weight"))).alias("w"),
                          F.sum(F.when(~open_, cap)).alias("full")).first()
        if not row["w"]:
            break
        new = (budget - (row["full"] or 0)) / row["w"]
        if new <= level:
            break
        level = new
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3,
                share: float = 1.0, seed: str = "mix", key: str = "doc_id", text: str = "text",
                source: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: ``key``, the ``keep`` columns, ``size``,
    ``source_size``, ``target`` (both of its source), ``copies`` (0 to
    ``max_epochs``) and ``taken`` (``size * copies``).

    Sources in code-point order, null last, take the ``weights`` in turn; the
    budget is ``share`` of all sizes. The shuffle is the md5 of seed and key, so
    reruns over the same rows agree. A null or blank text has size 0 and is never
    taken; a null key is shuffled as the empty string; repeated rows are queued
    each on their own. An empty table gives no rows.
    """
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    rows, _ = saved(docs.select(
        F.col(key), *[F.col(c) for c in keep if c != key], F.col(source).alias("_src"),
        word_count(F.col(text)).alias("size"), digest.alias("_h"),
        F.monotonically_increasing_id().alias("_row")), "sizes")

    # ---- sources: sizes, weights in turn, targets
    sums = rows.groupBy("_src").agg(F.sum("size").alias("source_size"))
    numbered = running_totals(sums, [F.col("_src").isNull(), F.col("_src")],
                              {"_i": F.lit(1), "_upto": F.col("source_size")}, ["_src", "source_size"])
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    weighted = numbered.withColumn(
        "weight", F.element_at(cycle, ((F.col("_i") - 1) % len(weights) + 1).cast("int")))
    weighted, _ = saved(weighted, "sources")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    budget = int(total * share)
    sources, _ = saved(fill_targets(weighted, budget, max_epochs)
                       .select("_src", "source_size", "weight", "target", "_upto"), "targets")

    # ---- queues: running words inside each source, in shuffled order. A source
    # may hold a third of all rows, so the total runs over (source, shuffle) ranges.
    filled = rows.where("size > 0")
    ran = running_totals(filled, [F.col("_src").isNull(), F.col("_src"), F.col("_h"), F.col(key),
                                  F.col("size"), F.col("_row")],
                         {"_all": F.col("size")}, ["_src", "_h", "size", "_row"])
    queued = ran.join(sources.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s")))
    copies = queued.select("_row", "size", "_h", "weight", (F.col("_all") - F.col("_upto") + F.col("source_size")).alias("_words"),
                           "source_size",
                           F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("_epoch"))
    finish = ((F.col("_epoch") * F.col("source_size") + F.col("_words")).cast("double")
              / F.col("weight"))

    # ---- global order and the cut at the budget
    served = running_totals(copies, [finish, F.col("_h"), F.col("size"), F.col("_epoch"), F.col("_row")],
                            {"_sent": F.col("size")}, ["_row"])
    taken = served.where(F.col("_sent") <= budget).groupBy("_row").agg(F.count(F.lit(1)).alias("copies"))

    out = (rows.join(taken, "_row", "left")
           .join(sources.withColumnRenamed("_src", "_s"), F.col("_src").eqNullSafe(F.col("_s"))))
    n = F.coalesce(F.col("copies"), F.lit(0)).cast("long")
    return out.select(key, *[c for c in keep if c != key], "size", "source_size", "target",
                      n.alias("copies"), (F.col("size") * n).alias("taken"))
