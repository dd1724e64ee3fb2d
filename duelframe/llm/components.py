"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.tables import drop, saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # a hub's rows are split over tasks by the skew join; only its minimum is one row
    return both.where("v > u").join(least, "u").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    hung = down.join(least, "u").where("v > m").select("v", "m")
    return hung.union(least.select("u", "m")).toDF("a", "b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``comp``) of every node of ``edges`` (long columns ``a``, ``b``):
    ``comp`` is the smallest node that it reaches. Loops and repeated edges do no
    harm; no edges give no rows. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    now, path, state = edges.where("a <> b").select("a", "b"), None, None
    while True:
        new, new_path = saved(_small_star(_large_star(now)), "edges")
        new_state = _state(new)
        if path:
            drop(spark, path)
        now, path = new, new_path
        if new_state == state:
            break
        state = new_state
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(
        now.select("b", "b").distinct())
