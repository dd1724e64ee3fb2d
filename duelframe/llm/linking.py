"""Components of items that share tokens, without pairing all items of a token.

Items come as postings (``token``, ``node``, ``x``): an item is a candidate partner of
every other item of one of its tokens. Linking rounds pair each posting with a few of its
token: with the leader and those before it in one random order for all tokens; then in an
order of each token's own, which gives an item other partners under each of its tokens;
then with the hubs, which have the most links so far, as an item that is linked to few of
a large group finds them among those. Components over the verified links then rule out most other pairs, as
two items of one component need no link of their own. The last round pairs all
postings of a token that are still in different components, so no link between two
components is missed, whatever the rounds before skipped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.components import components
from duelframe.llm.tables import drop, saved

# Linking rounds: whether a posting is paired with its token's hubs or with the postings before
# it, beside the leader, and how many.
ROUNDS = (("before", 1), ("before", 8), ("hubs", 8))


def shared_tokens(postings: DataFrame, column: str = "node") -> DataFrame:
    """Postings of the tokens under which ``column`` has at least two values."""
    same = Window.partitionBy("token")
    return (postings.withColumns({"_lo": F.min(column).over(same), "_hi": F.max(column).over(same)})
            .where("_lo <> _hi").drop("_lo", "_hi"))


def _pairs(rows: DataFrame, fits: str) -> DataFrame:
    return (rows.where("x.node <> y.node and x.comp <> y.comp").where(fits)
            .select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())


def _near_pairs(postings: DataFrame, turn: int, before: int, fits: str) -> DataFrame:
    own = [F.col("token")] if turn else []
    order = Window.partitionBy("token").orderBy(F.xxhash64("x.node", F.lit(turn), *own), "x.node")
    near = postings.select("x", F.array(
        F.first("x").over(order), *[F.lag("x", i).over(order) for i in range(1, before + 1)]).alias("near"))
    return _pairs(near.select("x", F.explode("near").alias("y")).where("y is not null"), fits)


def _hub_pairs(postings: DataFrame, turn: int, hubs: int, fits: str) -> DataFrame:
    order = (Window.partitionBy("token").orderBy(F.desc("x.links"), F.xxhash64("x.node", F.lit(turn)), "x.node")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    near = postings.select("x", F.array(*[F.nth_value("x", i).over(order) for i in range(1, hubs + 1)]).alias("near"))
    return _pairs(near.select("x", F.explode("near").alias("y")).where("y is not null"), fits)


def _meetings(postings: DataFrame) -> DataFrame:
    """(``x``, ``y``): each pair of postings of a token whose components differ, once. The
    components of a token are numbered; two numbers meet at the highest bit in which they
    differ, so pairs inside a component are never formed."""
    same = Window.partitionBy("token")
    ranked = (postings.withColumn("_n", F.dense_rank().over(same.orderBy("x.comp")) - 1)
              .withColumn("_top", F.max("_n").over(same)).where("_top > 0"))
    rows = (ranked.select("token", "x", "_n", F.explode(F.sequence(F.lit(0), F.length(F.bin("_top")) - 1)).alias("_bit"))
            .selectExpr("token", "x", "_bit", "shiftright(_n, _bit + 1) as _above", "shiftright(_n, _bit) & 1 as _side"))
    low, high = rows.where("_side = 0").drop("_side"), rows.where("_side = 1").drop("_side")
    return low.join(high.withColumnRenamed("x", "y"), ["token", "_bit", "_above"]).select("x", "y")


def _all_pairs(postings: DataFrame, fits: str) -> DataFrame:
    return _pairs(_meetings(postings), fits)


def linked_components(postings: DataFrame, fits: str, verify: Callable[[DataFrame], DataFrame],
                      rounds: tuple[tuple[str, int], ...] = ROUNDS) -> DataFrame | None:
    """(``node``, ``comp``) of all nodes with a link; None without any link.

    ``postings``: ``token``, ``node`` (long) and any columns that ``fits`` looks at, which
    are the same in all postings of one node and token; one of those is used.
    ``fits``: SQL condition that every linked pair meets, as structs ``x`` and ``y``,
    under at least one token that they share. ``verify``: (a, b) to the links among them,
    a written table.
    Every pair is verified once at most.
    """
    spark = postings.sparkSession
    extra = [c for c in postings.columns if c != "token"]
    table, table_path = saved(shared_tokens(postings).dropDuplicates(["token", "node"]), "postings")
    links, comps, tried = None, None, None
    for turn in range(len(rounds) + 1):
        if comps is None:
            labelled = table.withColumns({"comp": F.col("node"), "links": F.lit(0)})
        else:
            labelled = shared_tokens(table.join(comps, "node", "left").withColumns(
                {"comp": F.coalesce("comp", "node"), "links": F.coalesce("links", F.lit(0))}), "comp")
        kind, width = rounds[turn] if turn < len(rounds) else ("all", 0)
        labelled = labelled.select("token", F.struct(*extra, "comp", *(["links"] if kind == "hubs" else [])).alias("x"))
        found = (_hub_pairs(labelled, turn, width, fits) if kind == "hubs"
                 else _near_pairs(labelled, turn, width, fits) if kind == "before" else _all_pairs(labelled, fits))
        if tried is not None:
            found = found.join(tried, ["a", "b"], "left_anti")
        pairs, _ = saved(found, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        if not pairs.isEmpty():
            new = verify(pairs)
            links = new if links is None else links.union(new)
            counts = links.select("a").union(links.select("b")).toDF("node").groupBy("node").agg(
                F.count(F.lit(1)).cast("int").alias("links"))
            comps, _ = saved(components(links).join(counts, "node"), "components")
    drop(spark, table_path)
    return None if comps is None else comps.drop("links")
