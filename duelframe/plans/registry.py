"""Registered queries: one per operator of the inventory, each with the
DuckDB SQL that must give the same multiset of rows.

Every query reads the driver tables of one scale factor (or tables Spark
derives from them) in full. Doubles computed here are rounded to 6 places
on both sides so that summation order cannot flip a comparison.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions.scalar import (code_number, day_range, fill_constants,
                                        fill_numeric, flag, half_open, in_set_flag, nan_ratio,
                                        rounded, safe_ratio)
from duelframe.operators import sequence as seq
from duelframe.operators.asof import stream_cuts
from duelframe.operators.joins import band_lookup, dim_lookup, interval_join, mark_join
from duelframe.operators.mirror import mirror_compact
from duelframe.operators.hot import Cuts, find_cuts
from duelframe.operators.ordinal import ordinal_within, pair_consecutive
from duelframe.operators.pairing import assign_sides, pair_sides_join
from duelframe.operators.ranks import active_rank, rank_periods, ranked_periods
from duelframe.operators.split import recency_weight, stratified_split
from duelframe.operators.stats import brier_score, exact_medians, global_min_max, mean_std
from duelframe.plans import contest as C
from duelframe.operators.sliced import Feat, sliced_window
from duelframe.operators.written import written
from duelframe.plans.features import game_features, team_cuts, team_window
from duelframe.plans.oracle_views import (ACTIVE_RANK, CONF, GAME_VIEWS, PERIODS_FILE,
                                          PERIODS_SEASON, PUBLICATION, RANKED, TEAM_VIEWS,
                                          TENURE, with_views)
from duelframe.session import checkpoint_dir
from duelframe.sources.files import (read_csv, read_partition, season_slice, write_csv, write_parquet,
                                     write_partitioned)
from duelframe.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

ENTITY = ["league", "team_id"]
ORDER = ["day_num", "game_key"]
W_TEAM = "PARTITION BY league, team_id ORDER BY day_num, game_key"


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _events(spark, sf) -> DataFrame:
    return Tables(spark, sf).events


def _cuts(spark, sf) -> Cuts:
    return team_cuts(Tables(spark, sf).events)


def _day_cuts(spark, sf, *keys: str) -> Cuts:
    """Busy teams' cuts for joins of their games by day."""
    rows = Tables(spark, sf).events.select(F.col("event_type").alias("league"), F.col("user_id").alias("team_id"),
                                           C.day_index("ts").alias("day_num"), "event_id")
    return stream_cuts(rows.select(*keys, "day_num", "event_id"), keys, "day_num")


def _team_games(spark, sf) -> DataFrame:
    return C.team_game(C.contest(Tables(spark, sf).events))


def _pubs(spark, sf) -> DataFrame:
    return C.publication(Tables(spark, sf).events)


def _periods(spark, sf, scope: str) -> DataFrame:
    return rank_periods(_pubs(spark, sf), "league", "pub_day", scope, C.open_end())


def _ranked(spark, sf, scope: str) -> DataFrame:
    return ranked_periods(_pubs(spark, sf), "league", "pub_day", scope, C.open_end())


# --------------------------------------------------------------------------
# Scans, projections, predicates (S, P)

@register("scan_filter_project", """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem
WHERE l_returnflag = 'R' AND l_quantity <= 10 AND l_discount >= 0.05""")
def scan_filter_project(spark, sf):
    li = Tables(spark, sf).lineitem
    return (li.where((F.col("l_returnflag") == "R") & (F.col("l_quantity") <= 10)
                     & (F.col("l_discount") >= 0.05))
              .select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice"))


@register("partition_split_counts", """
SELECT p_brand, COUNT(*) AS n, CAST(SUM(CASE WHEN p_brand = 'Brand#1' THEN 1 ELSE 0 END) AS BIGINT) AS n_pruned
FROM part GROUP BY p_brand""")
def partition_split_counts(spark, sf):
    """Split ``part`` by brand in one partitioned write, read it back; the
    single-brand read is pruned to one folder."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/split-{uuid.uuid4().hex}"
    write_partitioned(Tables(spark, sf).part, "p_brand", root, key_copy="brand")
    back = spark.read.parquet(root)
    one = read_partition(spark, root, "brand", "Brand#1").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n_pruned"))
    allc = back.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return (allc.join(one, "p_brand", "left")
                .select("p_brand", "n", F.coalesce("n_pruned", F.lit(0)).cast("bigint").alias("n_pruned")))


@register("disjunctive_filter", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
WHERE o_orderstatus = 'F' OR o_totalprice > 400000""")
def disjunctive_filter(spark, sf):
    o = Tables(spark, sf).orders
    return (o.where((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 400000))
             .drop("o_orderdate", "o_orderpriority"))


@register("half_open_range_max", """
SELECT o_custkey, MAX(o_totalprice) AS max_price, COUNT(*) AS n_orders FROM orders
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1999-01-01'
GROUP BY o_custkey""")
def half_open_range_max(spark, sf):
    o = Tables(spark, sf).orders
    lo = F.lit("1996-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit("1999-01-01 00:00:00").cast("timestamp_ntz")
    return (o.where(half_open("o_orderdate", lo, hi))
             .groupBy("o_custkey")
             .agg(F.max("o_totalprice").alias("max_price"), F.count(F.lit(1)).alias("n_orders")))


POWER_REGIONS = ("EUROPE", "AMERICA")


@register("case_flags", """
SELECT o.o_orderkey, r.r_name,
  CASE WHEN o.o_totalprice > 300000 THEN 'large'
       WHEN o.o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_band,
  CASE WHEN r.r_name IN ('EUROPE','AMERICA') AND o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS power_win,
  CASE WHEN NOT (r.r_name IN ('EUROPE','AMERICA')) AND o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS non_power_win,
  CASE WHEN r.r_name IN ('EUROPE','AMERICA') AND o.o_orderstatus = 'O' THEN 1 ELSE 0 END AS power_loss,
  CASE WHEN NOT (r.r_name IN ('EUROPE','AMERICA')) AND o.o_orderstatus = 'O' THEN 1 ELSE 0 END AS non_power_loss,
  1 AS source_flag
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""")
def case_flags(spark, sf):
    t = Tables(spark, sf)
    geo = (t.customer.select("c_custkey", "c_nationkey")
           .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
           .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
           .select("c_custkey", "r_name"))
    j = t.orders.join(geo, F.col("o_custkey") == F.col("c_custkey"))
    won, lost = F.col("o_orderstatus") == "F", F.col("o_orderstatus") == "O"
    price = F.col("o_totalprice")
    return j.select(
        "o_orderkey", "r_name",
        F.when(price > 300000, "large").when(price > 100000, "medium").otherwise("small").alias("size_band"),
        in_set_flag("r_name", POWER_REGIONS, won).alias("power_win"),
        in_set_flag("r_name", POWER_REGIONS, won, negate=True).alias("non_power_win"),
        in_set_flag("r_name", POWER_REGIONS, lost).alias("power_loss"),
        in_set_flag("r_name", POWER_REGIONS, lost, negate=True).alias("non_power_loss"),
        F.lit(1).alias("source_flag"))


@register("label_lookup", """
SELECT s.s_suppkey, s.requested, n.n_nationkey AS nation_id
FROM (SELECT s_suppkey, 'NATION_' || CAST((s_nationkey * 7) % 30 AS VARCHAR) AS requested FROM supplier) s
JOIN nation n ON s.requested = n.n_name""")
def label_lookup(spark, sf):
    """Name -> id for a request list; requests naming no known label drop
    out (the null guard of the interactive form)."""
    t = Tables(spark, sf)
    req = t.supplier.select("s_suppkey", F.concat(F.lit("NATION_"), ((F.col("s_nationkey") * 7) % 30)
                                                  .cast("string")).alias("requested"))
    names = t.nation.select(F.col("n_name").alias("requested"), F.col("n_nationkey").alias("nation_id"))
    return (req.join(names, "requested", "left").where(F.col("nation_id").isNotNull())
               .select("s_suppkey", "requested", "nation_id"))


@register("suffix_rename_pair", """
WITH s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS pos FROM supplier)
SELECT a.s_nationkey, a.s_suppkey AS s_suppkey_A, a.s_name AS s_name_A, a.s_acctbal AS s_acctbal_A,
       b.s_suppkey AS s_suppkey_B, b.s_name AS s_name_B, b.s_acctbal AS s_acctbal_B
FROM s a JOIN s b ON a.s_nationkey = b.s_nationkey AND b.pos = a.pos + 1 AND a.pos % 2 = 0""")
def suffix_rename_pair(spark, sf):
    """Consecutive suppliers of a nation paired into one row, every
    non-key column suffixed by its side (positions 0-1, 2-3, ...)."""
    s = Tables(spark, sf).supplier.select("s_nationkey", "s_suppkey", "s_name", "s_acctbal")
    cols = ["s_suppkey", "s_name", "s_acctbal"]
    p = pair_consecutive(s, ["s_nationkey"], ["s_suppkey"], cols, find_cuts(s, ["s_nationkey"], ["s_suppkey"]))
    return p.select("s_nationkey", *[F.col(f"a_{c}").alias(f"{c}_A") for c in cols],
                    *[F.col(f"b_{c}").alias(f"{c}_B") for c in cols])


@register("union_with_source_flag", """
SELECT o_orderkey, o_orderstatus, 1 AS reg_flag, 0 AS post_flag FROM orders WHERE o_orderstatus = 'F'
UNION ALL
SELECT o_orderkey, o_orderstatus, 0, 1 FROM orders WHERE o_orderstatus <> 'F'""")
def union_with_source_flag(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    reg = o.where(F.col("o_orderstatus") == "F").withColumns({"reg_flag": F.lit(1), "post_flag": F.lit(0)})
    post = o.where(F.col("o_orderstatus") != "F").withColumns({"reg_flag": F.lit(0), "post_flag": F.lit(1)})
    return reg.unionByName(post)


# --------------------------------------------------------------------------
# Mirror (U2, U3) and joins (J)

@register("mirror_two_sided", with_views(*TEAM_VIEWS, body="SELECT * FROM team_game"))
def mirror_two_sided(spark, sf):
    return _team_games(spark, sf)


@register("mirror_compact", with_views(*GAME_VIEWS, body="""
SELECT league, game_key, day_num, w_id AS team_id, 1 AS win, 0 AS lose FROM contest
UNION ALL SELECT league, game_key, day_num, l_id, 0, 1 FROM contest"""))
def mirror_compact_q(spark, sf):
    games = C.contest(Tables(spark, sf).events)
    return mirror_compact(games, ["league", "game_key", "day_num"], "w_id", "l_id")


@register("mark_join_flag", with_views(*GAME_VIEWS, body="""
SELECT c.league, c.game_key, c.day_num, c.w_id, c.l_id,
       CASE WHEN p.user_id IS NOT NULL THEN 1 ELSE 0 END AS purchase_flag
FROM contest c LEFT JOIN (SELECT DISTINCT user_id, CAST(datediff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS pday
                          FROM events WHERE event_type = 'purchase') p
  ON c.w_id = p.user_id AND c.day_num = p.pday"""))
def mark_join_flag(spark, sf):
    """Flag games on whose day the winner made a purchase."""
    ev = Tables(spark, sf).events
    games = C.contest(ev).select("league", "game_key", "day_num", "w_id", "l_id")
    buys = ev.where(F.col("event_type") == "purchase").select(
        "user_id", C.day_index("ts").alias("pday"))
    return mark_join(games, buys, ["w_id", "day_num"], "purchase_flag", ["user_id", "pday"])


@register("double_dim_lookup", with_views(*GAME_VIEWS, CONF, body="""
SELECT c.league, c.game_key, c.w_id, c.l_id, dw.n_name AS w_conf, dl.n_name AS l_conf
FROM contest c LEFT JOIN conf dw ON c.w_id = dw.c_custkey LEFT JOIN conf dl ON c.l_id = dl.c_custkey"""))
def double_dim_lookup(spark, sf):
    """Winner's and loser's "conference" (nation of the customer with the
    team's id) from the same dimension, looked up twice."""
    t = Tables(spark, sf)
    conf = (t.customer.select("c_custkey", "c_nationkey")
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"))
    games = C.contest(t.events).select("league", "game_key", "w_id", "l_id")
    g = dim_lookup(games, conf, ["w_id"], ["c_custkey"], {"n_name": "w_conf"})
    return dim_lookup(g, conf, ["l_id"], ["c_custkey"], {"n_name": "l_conf"})


@register("interval_join_tenure", with_views(*TEAM_VIEWS, TENURE, body="""
SELECT t.league, t.game_key, t.team_id, t.day_num, u.manager
FROM team_game t JOIN tenure u
  ON t.team_id = u.team_id AND u.first_day <= t.day_num AND t.day_num <= u.last_day"""))
def interval_join_tenure(spark, sf):
    ev = Tables(spark, sf).events
    tg = C.team_game(C.contest(ev)).select("league", "game_key", "team_id", "day_num")
    return interval_join(tg, C.tenure(ev), ["team_id"], "day_num", "first_day", "last_day",
                         "inner", cuts=_day_cuts(spark, sf, "team_id")).select("league", "game_key", "team_id", "day_num", "manager")


@register("interval_semi_join", with_views(*TEAM_VIEWS, TENURE, body="""
SELECT * FROM team_game t WHERE EXISTS (
  SELECT 1 FROM tenure u WHERE t.team_id = u.team_id AND u.first_day <= t.day_num AND t.day_num <= u.last_day)"""))
def interval_semi_join(spark, sf):
    ev = Tables(spark, sf).events
    return interval_join(C.team_game(C.contest(ev)), C.tenure(ev), ["team_id"], "day_num",
                         "first_day", "last_day", "left_semi", cuts=_day_cuts(spark, sf, "team_id"))


NEUTRAL_WINS = """tw AS (
  SELECT league, team_id, day_num, game_key,
         CAST(SUM(win) OVER (""" + W_TEAM + """ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - win AS BIGINT) AS wins_in
  FROM team_game WHERE loc = 'N')"""


def _neutral_wins(tg: DataFrame, cuts: Cuts) -> DataFrame:
    """Sparse fact: wins coming in, counted over neutral-site games only
    (the "tournament" games)."""
    n = tg.where(F.col("loc") == "N").select(*ENTITY, *ORDER, "win")
    w = team_window(n, [Feat("wins_in", "sum", "win")], cuts)
    return w.select(*ENTITY, *ORDER, F.coalesce("wins_in", F.lit(0)).cast("bigint").alias("wins_in"))


@register("sparse_fact_left_join", with_views(*TEAM_VIEWS, NEUTRAL_WINS, body="""
SELECT t.league, t.game_key, t.team_id, t.day_num, tw.wins_in
FROM team_game t LEFT JOIN tw ON t.league = tw.league AND t.team_id = tw.team_id
 AND t.day_num = tw.day_num AND t.game_key = tw.game_key"""))
def sparse_fact_left_join(spark, sf):
    tg = _team_games(spark, sf)
    return (tg.select(*ENTITY, *ORDER).join(_neutral_wins(tg, _cuts(spark, sf)), [*ENTITY, *ORDER], "left")
              .select("league", "game_key", "team_id", "day_num", "wins_in"))


@register("wins_coming_in_filled", with_views(*TEAM_VIEWS, NEUTRAL_WINS, body="""
, j AS (SELECT t.league, t.game_key, t.team_id, t.day_num, tw.wins_in
        FROM team_game t LEFT JOIN tw ON t.league = tw.league AND t.team_id = tw.team_id
         AND t.day_num = tw.day_num AND t.game_key = tw.game_key)
, f AS (SELECT *, LAST_VALUE(wins_in IGNORE NULLS) OVER (""" + W_TEAM + """
          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ff FROM j)
SELECT league, game_key, team_id, day_num,
       COALESCE(ff, FIRST_VALUE(ff IGNORE NULLS) OVER (""" + W_TEAM + """
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS wins_in
FROM f"""))
def wins_coming_in_filled(spark, sf):
    """Sparse wins, forward-filled along the team's games, then
    back-filled from its next neutral game, then 0."""
    tg, cuts = _team_games(spark, sf), _cuts(spark, sf)
    j = tg.select(*ENTITY, *ORDER).join(_neutral_wins(tg, cuts), [*ENTITY, *ORDER], "left")
    # a back fill after the forward fill only sees the rows before the first value
    b = team_window(j, [Feat("ff", "ffill", "wins_in"), Feat("bf", "bfill", "wins_in")], cuts)
    return b.select("league", "game_key", "team_id", "day_num",
                    F.coalesce("ff", "bf", F.lit(0).cast("bigint")).alias("wins_in"))


# --------------------------------------------------------------------------
# Rank periods

@register("distinct_periods", with_views(PUBLICATION, body="SELECT DISTINCT league, pub_day FROM publication"))
def distinct_periods(spark, sf):
    return C.publication(Tables(spark, sf).events).select("league", "pub_day").distinct()


@register("rank_period_season_lead", with_views(PUBLICATION, PERIODS_SEASON, body="SELECT * FROM periods"))
def rank_period_season_lead(spark, sf):
    return _periods(spark, sf, "season")


@register("rank_period_global_lead", with_views(PUBLICATION, PERIODS_FILE, body="SELECT * FROM periods"))
def rank_period_global_lead(spark, sf):
    return _periods(spark, sf, "file")


@register("rank_period_table", with_views(PUBLICATION, PERIODS_SEASON, RANKED, body="SELECT * FROM ranked"))
def rank_period_table(spark, sf):
    return _ranked(spark, sf, "season").select(
        "league", "period_start", "period_end", "team_id", "ordinal")


def _active(spark, sf, scope: str) -> DataFrame:
    ev = Tables(spark, sf).events
    tg = C.team_game(C.contest(ev)).select("league", "game_key", "team_id", "day_num")
    ranked = _ranked(spark, sf, scope)
    return active_rank(tg, ranked, "league", "team_id", "day_num", "ordinal", "ordinal",
                       cuts=_day_cuts(spark, sf, "league", "team_id"))


@register("rank_asof_range_join", with_views(*TEAM_VIEWS, PUBLICATION, PERIODS_SEASON, RANKED, ACTIVE_RANK,
                                             body="SELECT league, game_key, team_id, day_num, ordinal FROM active"))
def rank_asof_range_join(spark, sf):
    return _active(spark, sf, "season")


@register("rank_asof_range_join_file", with_views(*TEAM_VIEWS, PUBLICATION, PERIODS_FILE, RANKED, ACTIVE_RANK,
                                                  body="SELECT league, game_key, team_id, day_num, ordinal FROM active"))
def rank_asof_range_join_file(spark, sf):
    return _active(spark, sf, "file")


@register("range_explode", with_views(PUBLICATION, PERIODS_FILE, body="""
SELECT league, period_start, period_end,
       UNNEST(CASE WHEN period_end >= period_start THEN generate_series(period_start, period_end)
                   ELSE CAST([NULL] AS BIGINT[]) END) AS day_num
FROM periods"""))
def range_explode(spark, sf):
    """Periods expanded to one row per covered day; an empty period keeps
    one row with a null day (``explode_outer``)."""
    p = _periods(spark, sf, "file")
    return p.select("league", "period_start", "period_end",
                    F.explode_outer(day_range("period_start", "period_end")).alias("day_num"))


@register("season_best_rank", with_views(*TEAM_VIEWS, PUBLICATION, PERIODS_SEASON, RANKED, ACTIVE_RANK, body="""
SELECT league, game_key, team_id, COALESCE(ordinal, 9999) AS active_rank,
       COALESCE(MIN(ordinal) OVER (""" + W_TEAM + """ ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9999)
         AS season_best
FROM active"""))
def season_best_rank(spark, sf):
    a = team_window(_active(spark, sf, "season"), [Feat("best", "min", "ordinal", None, True)], _cuts(spark, sf))
    return a.select("league", "game_key", "team_id",
                    F.coalesce("ordinal", F.lit(9999).cast("bigint")).alias("active_rank"),
                    F.coalesce("best", F.lit(9999).cast("bigint")).alias("season_best"))


@register("fill_constants", with_views(*TEAM_VIEWS, PUBLICATION, PERIODS_SEASON, RANKED, ACTIVE_RANK, body="""
SELECT league, game_key, team_id, day_num, COALESCE(ordinal, 9999) AS ordinal FROM active"""))
def fill_constants_q(spark, sf):
    return fill_constants(_active(spark, sf, "season"), {"ordinal": 9999})


# --------------------------------------------------------------------------
# Other joins

@register("history_aggregate_join", """
WITH hist AS (SELECT o_custkey AS hk, 1998 AS season, MAX(o_totalprice) AS hist_max FROM orders
              WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1998-01-01'
              GROUP BY o_custkey)
SELECT o.o_orderkey, o.o_custkey, CAST(year(o.o_orderdate) AS BIGINT) AS season, h.hist_max
FROM orders o LEFT JOIN hist h ON o.o_custkey = h.hk AND CAST(year(o.o_orderdate) AS BIGINT) = h.season""")
def history_aggregate_join(spark, sf):
    """Pre-period maxima attached to the first season after the period."""
    o = Tables(spark, sf).orders
    lo = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    hi = F.lit("1998-01-01 00:00:00").cast("timestamp_ntz")
    hist = (o.where(half_open("o_orderdate", lo, hi)).groupBy("o_custkey")
             .agg(F.max("o_totalprice").alias("hist_max"))
             .withColumn("season", F.lit(1998).cast("bigint")))
    base = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").cast("bigint").alias("season"))
    return base.join(hist, ["o_custkey", "season"], "left").select("o_orderkey", "o_custkey", "season",
                                                                   "hist_max")


@register("full_join_null_filter", """
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment
FROM orders o FULL OUTER JOIN customer c ON o.o_custkey = c.c_custkey
WHERE o.o_orderkey IS NOT NULL""")
def full_join_null_filter(spark, sf):
    t = Tables(spark, sf)
    o, c = t.orders, t.customer
    return (o.join(c, o["o_custkey"] == c["c_custkey"], "full")
             .where(o["o_orderkey"].isNotNull())
             .select("o_orderkey", "o_custkey", "c_mktsegment"))


SIDES = """s AS (SELECT *, DENSE_RANK() OVER (PARTITION BY league, game_key, day_num
                     ORDER BY loc || CAST(team_id AS VARCHAR)) AS side FROM team_game)"""


@register("pair_self_join", with_views(*TEAM_VIEWS, SIDES, body="""
SELECT a.league, a.game_key, a.day_num, a.team_id AS team_id_A, a.loc AS loc_A, a.win AS win_A,
       b.team_id AS team_id_B, b.loc AS loc_B
FROM s a JOIN s b ON a.league = b.league AND a.game_key = b.game_key AND a.day_num = b.day_num
 AND a.side = 1 AND b.side = 2"""))
def pair_self_join(spark, sf):
    tg = _team_games(spark, sf).select("league", "game_key", "day_num", "team_id", "loc", "win")
    sided = assign_sides(tg, ["league", "game_key", "day_num"], "loc", "team_id")
    return pair_sides_join(sided, ["league", "game_key", "day_num"], drop=["win_B"])


@register("side_assignment", with_views(*TEAM_VIEWS, SIDES,
                                        body="SELECT league, game_key, team_id, loc, CAST(side AS BIGINT) AS side FROM s"))
def side_assignment(spark, sf):
    tg = _team_games(spark, sf).select("league", "game_key", "day_num", "team_id", "loc")
    return assign_sides(tg, ["league", "game_key", "day_num"], "loc", "team_id").drop("day_num")


# --------------------------------------------------------------------------
# Aggregations (A)

@register("global_min_max", """
SELECT MIN(l_quantity) AS min_l_quantity, MAX(l_quantity) AS max_l_quantity,
       MIN(l_extendedprice) AS min_l_extendedprice, MAX(l_extendedprice) AS max_l_extendedprice,
       MIN(l_orderkey) AS min_l_orderkey, MAX(l_orderkey) AS max_l_orderkey FROM lineitem""")
def global_min_max_q(spark, sf):
    return global_min_max(Tables(spark, sf).lineitem, ["l_quantity", "l_extendedprice", "l_orderkey"])


MEDIAN_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


@register("global_medians", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col_name, ROUND(MEDIAN(CAST({c} AS DOUBLE)), 6) AS median FROM lineitem"
    for c in MEDIAN_COLS))
def global_medians(spark, sf):
    m = exact_medians(Tables(spark, sf).lineitem, MEDIAN_COLS)
    return m.select(F.col("column").alias("col_name"), rounded("median").alias("median"))


@register("brier_score", """
SELECT ROUND(AVG(POWER(CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS DOUBLE)
                       - LEAST(value / 100.0, 1.0), 2)), 6) AS brier FROM events""")
def brier_score_q(spark, sf):
    ev = Tables(spark, sf).events.select(
        flag(F.col("event_type") == "purchase").alias("y"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("p"))
    return brier_score(ev, "y", "p").select(rounded("brier").alias("brier"))


STD_COLS = ("l_quantity", "l_extendedprice", "l_discount")


@register("standardize_columns", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS col_name, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_POP({c}), 6) AS std FROM lineitem"
    for c in STD_COLS))
def standardize_columns(spark, sf):
    s = mean_std(Tables(spark, sf).lineitem, STD_COLS)
    return s.select(F.col("column").alias("col_name"), rounded("mean").alias("mean"), rounded("std").alias("std"))


# --------------------------------------------------------------------------
# Sequence windows (W)

def _frame(lo: str, hi: str = "1 PRECEDING") -> str:
    return f"({W_TEAM} ROWS BETWEEN {lo} AND {hi})"


PRIOR = _frame("UNBOUNDED PRECEDING")
LAST5 = _frame("5 PRECEDING")
INCL = _frame("UNBOUNDED PRECEDING", "CURRENT ROW")
INCL5 = _frame("4 PRECEDING", "CURRENT ROW")


@register("expanding_win_pct", with_views(*TEAM_VIEWS, body=f"""
SELECT league, game_key, team_id,
       ROUND(CAST(SUM(win) OVER {PRIOR} AS DOUBLE) / (SUM(win) OVER {PRIOR} + SUM(1 - win) OVER {PRIOR}), 6)
         AS win_pct_prior
FROM team_game"""))
def expanding_win_pct(spark, sf):
    tg = team_window(_team_games(spark, sf), [Feat("pct", "mean", "win")], _cuts(spark, sf))
    return tg.select("league", "game_key", "team_id", rounded("pct").alias("win_pct_prior"))


@register("rolling5_win_pct", with_views(*TEAM_VIEWS, body=f"""
SELECT league, game_key, team_id,
       ROUND(CASE WHEN COUNT(win) OVER {LAST5} = 5 THEN
             CAST(SUM(win) OVER {LAST5} AS DOUBLE) / (SUM(win) OVER {LAST5} + SUM(1 - win) OVER {LAST5}) END, 6)
         AS win_pct_last5
FROM team_game"""))
def rolling5_win_pct(spark, sf):
    tg = team_window(_team_games(spark, sf), [Feat("pct", "mean", "win", 5)], _cuts(spark, sf))
    return tg.select("league", "game_key", "team_id", rounded("pct").alias("win_pct_last5"))


def _means(spark, sf, include_current: bool, n: int | None):
    tg = team_window(_team_games(spark, sf), [Feat("p", "mean", "points", n, include_current),
                                               Feat("a", "mean", "allowed", n, include_current)],
                     _cuts(spark, sf))
    return tg.select("league", "game_key", "team_id", rounded("p").alias("points_mean"),
                     rounded("a").alias("allowed_mean"))


def _mean_sql(frame: str, full: int | None) -> str:
    def m(c):
        avg = f"AVG({c}) OVER {frame}"
        if full:
            avg = f"CASE WHEN COUNT({c}) OVER {frame} = {full} THEN {avg} END"
        return f"ROUND({avg}, 6)"
    return with_views(*TEAM_VIEWS, body=f"""
SELECT league, game_key, team_id, {m('points')} AS points_mean, {m('allowed')} AS allowed_mean
FROM team_game""")


@register("expanding_mean_prior", _mean_sql(PRIOR, None))
def expanding_mean_prior(spark, sf):
    return _means(spark, sf, False, None)


@register("rolling5_mean_prior", _mean_sql(LAST5, 5))
def rolling5_mean_prior(spark, sf):
    return _means(spark, sf, False, 5)


@register("expanding_mean_inclusive", _mean_sql(INCL, None))
def expanding_mean_inclusive(spark, sf):
    return _means(spark, sf, True, None)


@register("rolling5_mean_inclusive", _mean_sql(INCL5, 5))
def rolling5_mean_inclusive(spark, sf):
    return _means(spark, sf, True, 5)


USER_W = "PARTITION BY user_id ORDER BY ts, event_id"


def _user_fill(spark, sf, kind: str, name: str) -> DataFrame:
    """Purchase value carried along a user's events."""
    ev = Tables(spark, sf).events.select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("pv"))
    entity, order = ["user_id"], ["ts", "event_id"]
    out = sliced_window(ev, entity, order, [Feat(name, kind, "pv")], find_cuts(ev, entity, order))
    return out.select("event_id", "user_id", name)


@register("forward_fill", f"""
SELECT event_id, user_id, LAST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER ({USER_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase
FROM events""")
def forward_fill(spark, sf):
    return _user_fill(spark, sf, "ffill", "last_purchase")


@register("backward_fill", f"""
SELECT event_id, user_id, FIRST_VALUE(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER ({USER_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_purchase
FROM events""")
def backward_fill(spark, sf):
    return _user_fill(spark, sf, "bfill", "next_purchase")


@register("exclusive_running_wins", with_views(*TEAM_VIEWS, body=f"""
SELECT league, game_key, team_id,
       CAST(SUM(win) OVER {INCL} - win AS BIGINT) AS wins_before FROM team_game"""))
def exclusive_running_wins(spark, sf):
    tg = team_window(_team_games(spark, sf), [Feat("w", "sum", "win")], _cuts(spark, sf))
    return tg.select("league", "game_key", "team_id",
                     F.coalesce("w", F.lit(0)).cast("bigint").alias("wins_before"))


@register("skip_first_n", """
SELECT o_orderkey, o_custkey, game_number FROM (
  SELECT o_orderkey, o_custkey, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS game_number
  FROM orders) t WHERE game_number > 5""")
def skip_first_n(spark, sf):
    """Warm-up cut by dense rank of the day, as the reference ranks games
    (two orders of one day share a number)."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderdate")
    return (seq.dense_rank_of(o, ["o_custkey"], "o_orderdate", "game_number")
            .where(F.col("game_number") > 5).select("o_orderkey", "o_custkey", "game_number"))


@register("latest_state", """
SELECT o_custkey, o_orderkey, o_totalprice FROM (
  SELECT o_custkey, o_orderkey, o_totalprice,
         ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rk
  FROM orders) t WHERE rk = 1""")
def latest_state(spark, sf):
    o = Tables(spark, sf).orders.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return seq.latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@register("surrogate_key", with_views(*GAME_VIEWS, body="""
SELECT league, game_key, day_num, ROW_NUMBER() OVER (ORDER BY league, day_num, game_key) - 1 AS game_id
FROM contest"""))
def surrogate_key(spark, sf):
    """Dense 0-based game id in (league, day, key) order: the position in the
    league after the games of the leagues before it (a row for each league)."""
    g = C.contest(Tables(spark, sf).events).select("league", "game_key", "day_num")
    sizes = g.groupBy("league").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("league", (F.sum("_n").over(Window.orderBy("league")) - F.col("_n")).alias("_before"))
    events = Tables(spark, sf).events
    cuts = find_cuts(events.select(F.col("event_type").alias("league"), C.day_index("ts").alias("day_num"),
                                   F.col("event_id").alias("game_key")), ["league"], ORDER)
    inside = ordinal_within(g, ["league"], ORDER, "_pos", cuts)
    return inside.join(before, "league").select("league", "game_key", "day_num",
                                                (F.col("_before") + F.col("_pos")).alias("game_id"))


@register("partition_count", """
SELECT l_orderkey, l_linenumber, l_partkey, COUNT(l_partkey) OVER (PARTITION BY l_orderkey) AS n_lines
FROM lineitem""")
def partition_count(spark, sf):
    """Per-order non-null count attached to every line: one window over the order."""
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey", seq.partition_count("l_partkey", ["l_orderkey"]).alias("n_lines"))


@register("days_since_previous", with_views(*TEAM_VIEWS, body=f"""
SELECT league, game_key, team_id, CAST(day_num - LAG(day_num) OVER ({W_TEAM}) AS BIGINT) AS rest_days
FROM team_game"""))
def days_since_previous(spark, sf):
    tg = team_window(_team_games(spark, sf), [Feat("prev", "lag", "day_num")], _cuts(spark, sf))
    return tg.select("league", "game_key", "team_id", (F.col("day_num") - F.col("prev")).alias("rest_days"))


@register("streak_length", with_views(*TEAM_VIEWS, body=f"""
, isl AS (SELECT *, SUM(1 - win) OVER {INCL} AS island FROM team_game)
, inc AS (SELECT *, SUM(win) OVER (PARTITION BY league, team_id, island ORDER BY day_num, game_key
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM isl)
SELECT league, game_key, team_id, CAST(COALESCE(LAG(s) OVER ({W_TEAM}), 0) AS BIGINT) AS win_streak
FROM inc"""))
def streak_length(spark, sf):
    """Win streak coming into each game."""
    tg = team_window(_team_games(spark, sf), [Feat("win_streak", "run", "win")], _cuts(spark, sf))
    return tg.select("league", "game_key", "team_id", "win_streak")


@register("lose_streak_length", with_views(*TEAM_VIEWS, body=f"""
, isl AS (SELECT *, 1 - win AS lose, SUM(win) OVER {INCL} AS island FROM team_game)
, inc AS (SELECT *, SUM(lose) OVER (PARTITION BY league, team_id, island ORDER BY day_num, game_key
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM isl)
SELECT league, game_key, team_id, CAST(COALESCE(LAG(s) OVER ({W_TEAM}), 0) AS BIGINT) AS lose_streak
FROM inc"""))
def lose_streak_length(spark, sf):
    """Lose streak coming into each game."""
    tg = _team_games(spark, sf).withColumn("lose", 1 - F.col("win"))
    return team_window(tg, [Feat("lose_streak", "run", "lose")], _cuts(spark, sf)).select("league", "game_key", "team_id", "lose_streak")


# --------------------------------------------------------------------------
# Scalar functions (F)

@register("safe_ratio", """
SELECT l_orderkey, l_linenumber, l_partkey,
       ROUND(CASE WHEN l_tax <> 0 THEN l_discount / l_tax END, 6) AS discount_per_tax,
       ROUND(l_discount + l_tax, 6) AS total_rate
FROM lineitem""")
def safe_ratio_q(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     rounded(safe_ratio("l_discount", "l_tax")).alias("discount_per_tax"),
                     rounded(F.col("l_discount") + F.col("l_tax")).alias("total_rate"))


NAN_RATIO_SQL = """CASE WHEN l_tax <> 0 THEN l_discount / l_tax
            WHEN l_discount = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN l_discount > 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST('-Infinity' AS DOUBLE) END"""


@register("safe_ratio_nan", f"""
SELECT l_orderkey, l_linenumber, l_partkey, ROUND({NAN_RATIO_SQL}, 6) AS discount_per_tax FROM lineitem""")
def safe_ratio_nan(spark, sf):
    li = Tables(spark, sf).lineitem
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     rounded(nan_ratio("l_discount", "l_tax")).alias("discount_per_tax"))


@register("code_substring_cast", """
SELECT p_partkey, p_brand, CAST(substring(p_brand, 7, 2) AS INTEGER) AS brand_no FROM part""")
def code_substring_cast(spark, sf):
    p = Tables(spark, sf).part
    return p.select("p_partkey", "p_brand", code_number("p_brand", 7, 2).alias("brand_no"))


@register("fill_null_nan", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, {NAN_RATIO_SQL} AS r FROM lineitem),
big AS (SELECT p_partkey, p_brand, p_retailprice FROM part WHERE p_size > 40)
SELECT l_orderkey, l_linenumber, l_partkey,
       ROUND(CASE WHEN r IS NULL OR isnan(r) THEN 0 ELSE r END, 6) AS discount_per_tax,
       p_brand, COALESCE(p_retailprice, 0) AS p_retailprice
FROM x LEFT JOIN big ON x.l_partkey = big.p_partkey""")
def fill_null_nan(spark, sf):
    """Whole-frame numeric fill: NaN and null become 0, strings stay null."""
    t = Tables(spark, sf)
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                          nan_ratio("l_discount", "l_tax").alias("discount_per_tax"))
    big = t.part.where(F.col("p_size") > 40).select("p_partkey", "p_brand", "p_retailprice")
    j = x.join(big, x["l_partkey"] == big["p_partkey"], "left").drop("p_partkey")
    return fill_numeric(j, 0).withColumn("discount_per_tax", rounded("discount_per_tax"))


# --------------------------------------------------------------------------
# Model-side data preparation (M2, M7) and dimension bands

@register("stratified_split", """
WITH h AS (SELECT o_orderkey, o_orderstatus,
                  ROW_NUMBER() OVER (PARTITION BY o_orderstatus
                                     ORDER BY md5('42' || CAST(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS pos,
                  COUNT(*) OVER (PARTITION BY o_orderstatus) AS n
           FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN pos < (n * 7) // 10 THEN 1 ELSE 0 END AS is_train FROM h""")
def stratified_split_q(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", "o_orderstatus")
    return stratified_split(o, "o_orderstatus", "o_orderkey")


@register("recency_weights", """
SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS season,
       CASE WHEN year(o_orderdate) = (SELECT MAX(year(o_orderdate)) FROM orders) THEN 2 ELSE 1 END AS weight
FROM orders""")
def recency_weights(spark, sf):
    o = Tables(spark, sf).orders.select("o_orderkey", F.year("o_orderdate").cast("bigint").alias("season"))
    latest = o.agg(F.max("season")).scalar()  # scalar subquery, evaluated once
    return o.select("o_orderkey", "season", recency_weight("season", latest).alias("weight"))


# Opponent-rank bands by game location (quadrants 1-4; the
# last band of each location is open-ended).
QUAD_BANDS = [
    ("quad1", "H", 1, 30), ("quad1", "N", 1, 50), ("quad1", "A", 1, 75),
    ("quad2", "H", 31, 75), ("quad2", "N", 51, 100), ("quad2", "A", 76, 135),
    ("quad3", "H", 76, 160), ("quad3", "N", 101, 200), ("quad3", "A", 136, 240),
    ("quad4", "H", 161, None), ("quad4", "N", 201, None), ("quad4", "A", 241, None),
]


def _bands_sql() -> str:
    rows = ", ".join(f"('{q}', '{l}', {lo}, {'NULL' if hi is None else hi})" for q, l, lo, hi in QUAD_BANDS)
    return f"bands AS (SELECT * FROM (VALUES {rows}) b(quad, band_loc, lo, hi))"


@register("band_lookup", with_views(*TEAM_VIEWS, PUBLICATION, PERIODS_SEASON, RANKED, _bands_sql(), body="""
, opp AS (SELECT t.league, t.game_key, t.team_id, t.loc, r.ordinal AS opp_rank
          FROM team_game t LEFT JOIN ranked r ON t.league = r.league AND t.opp_id = r.team_id
           AND r.period_start <= t.day_num AND t.day_num <= r.period_end)
SELECT o.league, o.game_key, o.team_id, o.loc, o.opp_rank, b.quad
FROM opp o LEFT JOIN bands b ON o.loc = b.band_loc AND o.opp_rank >= b.lo
 AND (b.hi IS NULL OR o.opp_rank <= b.hi)"""))
def band_lookup_q(spark, sf):
    """Opponent's active rank classified into location-dependent bands."""
    ev = Tables(spark, sf).events
    tg = C.team_game(C.contest(ev)).select("league", "game_key", "team_id", "opp_id", "loc", "day_num")
    ranked = _ranked(spark, sf, "season")
    opp = active_rank(tg, ranked, "league", "opp_id", "day_num", "ordinal", "opp_rank",
                      cuts=_day_cuts(spark, sf, "league", "team_id"))
    bands = spark.createDataFrame(QUAD_BANDS, "quad string, band_loc string, lo int, hi int")
    return band_lookup(opp, bands, "loc", "opp_rank", "band_loc", "lo", "hi", "quad").select(
        "league", "game_key", "team_id", "loc", "opp_rank", "quad")


# --------------------------------------------------------------------------
# Composite features: flagship and serving state

def _flagship_sql() -> str:
    feats = []
    for name, expr in (
        ("win_pct_prior", f"CAST(SUM(win) OVER {PRIOR} AS DOUBLE) / COUNT(win) OVER {PRIOR}"),
        ("win_pct_last5", f"CAST(SUM(win) OVER {LAST5} AS DOUBLE) / COUNT(win) OVER {LAST5}"),
        ("points_mean_prior", f"AVG(points) OVER {PRIOR}"),
        ("points_mean_last5", f"AVG(points) OVER {LAST5}"),
        ("allowed_mean_prior", f"AVG(allowed) OVER {PRIOR}"),
        ("allowed_mean_last5", f"AVG(allowed) OVER {LAST5}"),
    ):
        feats.append(f"ROUND({expr}, 6) AS {name}")
    sel = ",\n         ".join(feats)
    cols = ["team_id", "loc", "win_pct_prior", "win_pct_last5", "points_mean_prior",
            "points_mean_last5", "allowed_mean_prior", "allowed_mean_last5"]
    a = ", ".join(f"a.{c} AS {c}_A" for c in cols + ["win"])
    b = ", ".join(f"b.{c} AS {c}_B" for c in cols)
    return with_views(*TEAM_VIEWS, body=f"""
, f AS (SELECT league, game_key, day_num, team_id, loc, win,
         {sel},
         ROW_NUMBER() OVER ({W_TEAM}) AS game_number
  FROM team_game)
, s AS (SELECT *, DENSE_RANK() OVER (PARTITION BY league, game_key, day_num
                                     ORDER BY loc || CAST(team_id AS VARCHAR)) AS side
        FROM f WHERE game_number > 5)
SELECT a.league, a.game_key, a.day_num, {a}, {b}
FROM s a JOIN s b ON a.league = b.league AND a.game_key = b.game_key AND a.day_num = b.day_num
 AND a.side = 1 AND b.side = 2""")


@register("game_features", _flagship_sql())
def game_features_q(spark, sf):
    return game_features(_team_games(spark, sf), cuts=_cuts(spark, sf))


STATE_COLS = ("win_pct", "points_mean", "points_mean_last5", "allowed_mean")


def latest_team_state(tg: DataFrame, cuts: Cuts | None = None) -> DataFrame:
    """Post-game state of each team after its latest game (serving
    features: inclusive windows, then the last row by day and key)."""
    f = team_window(tg.select(*ENTITY, *ORDER, "win", "points", "allowed"),
                    [Feat("win_pct", "mean", "win", None, True), Feat("points_mean", "mean", "points", None, True),
                     Feat("points_mean_last5", "mean", "points", 5, True),
                     Feat("allowed_mean", "mean", "allowed", None, True)], cuts)
    s = f.select(*ENTITY, *ORDER, *[rounded(c).alias(c) for c in STATE_COLS])
    return fill_numeric(seq.latest(s, ENTITY, ORDER).drop(*ORDER), 0)


@register("matchup_features", with_views(*TEAM_VIEWS, body=f"""
, st AS (SELECT league, team_id,
          ROUND(CAST(SUM(win) OVER {INCL} AS DOUBLE) / COUNT(win) OVER {INCL}, 6) AS win_pct,
          ROUND(AVG(points) OVER {INCL}, 6) AS points_mean,
          COALESCE(ROUND(CASE WHEN COUNT(points) OVER {INCL5} = 5 THEN AVG(points) OVER {INCL5} END, 6), 0)
            AS points_mean_last5,
          ROUND(AVG(allowed) OVER {INCL}, 6) AS allowed_mean,
          ROW_NUMBER() OVER (PARTITION BY league, team_id ORDER BY day_num DESC, game_key DESC) AS rk
   FROM team_game)
SELECT c.league, c.game_key, c.w_id AS team_1, c.l_id AS team_2,
       s1.win_pct AS win_pct_1, s1.points_mean AS points_mean_1, s1.points_mean_last5 AS points_mean_last5_1,
       s1.allowed_mean AS allowed_mean_1,
       s2.win_pct AS win_pct_2, s2.points_mean AS points_mean_2, s2.points_mean_last5 AS points_mean_last5_2,
       s2.allowed_mean AS allowed_mean_2
FROM contest c JOIN st s1 ON c.league = s1.league AND c.w_id = s1.team_id AND s1.rk = 1
JOIN st s2 ON c.league = s2.league AND c.l_id = s2.team_id AND s2.rk = 1"""))
def matchup_features(spark, sf):
    """Bulk scoring input: every requested pairing (here: each contest's
    two teams) joined twice to the latest serving state."""
    games = C.contest(Tables(spark, sf).events)
    state = latest_team_state(C.team_game(games), _cuts(spark, sf))
    req = games.select("league", "game_key", F.col("w_id").alias("team_1"), F.col("l_id").alias("team_2")) \
               .dropna()

    def side(k: str) -> DataFrame:
        return state.select(F.col("league"), F.col("team_id").alias(f"team_{k}"),
                            *[F.col(c).alias(f"{c}_{k}") for c in STATE_COLS])
    return req.join(side("1"), ["league", "team_1"]).join(side("2"), ["league", "team_2"])


@register("merged_state", with_views(*TEAM_VIEWS, body=f"""
, x AS (SELECT *, SUM(1 - win) OVER {INCL} AS island, ROW_NUMBER() OVER ({W_TEAM}) AS rn,
               AVG(points) OVER {INCL} AS mean_points, MIN(points) OVER {INCL} AS min_points, MAX(points) OVER {INCL} AS max_points,
               CASE WHEN COUNT(points) OVER {INCL5} = 5 THEN AVG(points) OVER {INCL5} END AS last_points,
               AVG(allowed) OVER {INCL} AS mean_allowed,
               ROW_NUMBER() OVER (PARTITION BY league, team_id ORDER BY day_num DESC, game_key DESC) AS rk FROM team_game)
SELECT league, team_id, rn AS games, (SELECT CAST(COALESCE(SUM(y.win), 0) AS BIGINT) FROM x y
         WHERE y.league = x.league AND y.team_id = x.team_id AND y.island = x.island) AS win_run,
       ROUND(mean_points, 6) AS mean_points, ROUND(last_points, 6) AS last_points, min_points, max_points,
       ROUND(mean_allowed, 6) AS mean_allowed
FROM x WHERE rk = 1"""))
def merged_state(spark, sf):
    """Serving state by merging: the games before a day and those since it are summarised
    apart, and the two states of a team merged."""
    from duelframe.operators.state import merge_states, row_states, state_features
    tg = written(_team_games(spark, sf), "team-games")
    values, middle = ["points", "allowed"], tg.agg(F.floor(F.avg("day_num"))).first()[0]
    rows = row_states(tg, ENTITY, ORDER, values, "win")
    old = written(merge_states(rows.where(F.col("first.day_num") < middle), ENTITY, values, 5), "state")
    new = merge_states(rows.where(F.col("first.day_num") >= middle), ENTITY, values, 5)
    s = state_features(merge_states(old.unionByName(new), ENTITY, values, 5), ENTITY, values, 5)
    return s.select(*ENTITY, F.col("rows").alias("games"), F.col("run").alias("win_run"), rounded("mean_points").alias("mean_points"),
                    rounded("last_points").alias("last_points"), "min_points", "max_points", rounded("mean_allowed").alias("mean_allowed"))


# --------------------------------------------------------------------------
# Model jobs (M1-M17). Iterative, so no SQL oracle: the driver checks rows.

def _model_rows(spark, sf) -> DataFrame:
    """Paired features with a seeded exact 70/30 split per league. The
    table is checkpointed into the shared checkpoint folder so the many
    passes of fitting do not recompute the feature plan."""
    checkpoint_dir(spark)
    gf = game_features(_team_games(spark, sf), cuts=_cuts(spark, sf))
    return stratified_split(gf, "league", "game_key").checkpoint(eager=True)


def _train_test(spark, sf):
    d = _model_rows(spark, sf)
    return d.where(F.col("is_train") == 1), d.where(F.col("is_train") == 0)


@register("train_logistic_score")
def train_logistic_score(spark, sf):
    """L2 logistic regression at the deployed strength, scored on the
    held-out rows."""
    from duelframe.plans import model as M
    train, test = _train_test(spark, sf)
    spec = M.contest_spec(train)
    fitted = M.fit(train, spec, M.logistic(train, spec, M.DEPLOYED_C, "l2"))
    return M.scored(fitted, test, ["league", "game_key"], spec)


@register("soft_vote")
def soft_vote(spark, sf):
    """Random forest + logistic regression, soft-voted probabilities. The trees' number
    and depth are this query's own parameters."""
    from duelframe.plans import model as M
    train, test = _train_test(spark, sf)
    spec = M.contest_spec(train)
    rf = M.fit(train, spec, M.forest(spec, n_trees=40, min_split=4, max_depth=12))
    lr = M.fit(train, spec, M.logistic(train, spec, 0.05, "l2"))
    return M.soft_vote([rf, lr], test, ["league", "game_key"], spec)


@register("search_trials")
def search_trials(spark, sf):
    """Seeded random search over the L2 logistic strength, one row per
    trial with its held-out Brier score; all 100 trials in the same scans."""
    from duelframe.plans import model as M
    train, test = _train_test(spark, sf)
    return M.search(train, test, M.contest_spec(train), "logistic_l2")


# Logistic fits with two inputs, in SQL by recursion.
DIFFERENCES = {"pct_diff": "win_pct_prior_A - win_pct_prior_B",
               "points_diff": "(points_mean_prior_A - points_mean_prior_B) / 10"}
_LOGIT_DATA = _flagship_sql().replace("WITH ", "WITH RECURSIVE ", 1).replace("SELECT a.league", ", g AS (SELECT a.league", 1) + """)
, d AS MATERIALIZED (SELECT CAST(win_A AS DOUBLE) AS y, game_key % 10 < 7 AS train, """ + ", ".join(
    f"CAST({e} AS DOUBLE) AS x{i}" for i, e in enumerate(DIFFERENCES.values(), 1)) + " FROM g)"

# Newton steps on the mean loss plus lam / 2 (b1^2 + b2^2), the 3 x 3 system by Cramer's rule.
_NEWTON = """
, it AS (
  SELECT 0 AS k, t, lam, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM setting
  UNION ALL
  SELECT k + 1, t, lam,
    b0 - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det,
    b1 - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det,
    b2 - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det
  FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det
        FROM (SELECT k, t, lam, b0, b1, b2, avg(p - y) AS g0, avg((p - y) * x1) + lam * b1 AS g1,
                     avg((p - y) * x2) + lam * b2 AS g2, avg(v) AS h00, avg(v * x1) AS h01, avg(v * x2) AS h02,
                     avg(v * x1 * x1) + lam AS h11, avg(v * x1 * x2) AS h12, avg(v * x2 * x2) + lam AS h22
              FROM (SELECT *, p * (1 - p) AS v
                    FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p FROM it, d WHERE k < 9 AND {rows}))
              GROUP BY k, t, lam, b0, b1, b2)))
"""


def _differences(spark, sf) -> DataFrame:
    gf = game_features(_team_games(spark, sf), cuts=_cuts(spark, sf))
    return written(gf.select(F.col("win_A").alias("y"), (F.col("game_key") % 10 < 7).alias("train"),
                             *[F.expr(e).alias(n) for n, e in DIFFERENCES.items()]), "differences")


@register("logistic_newton", _LOGIT_DATA + ", setting AS (SELECT 0 AS t, 0.01::DOUBLE AS lam)" + _NEWTON.format(rows="true") + """
SELECT x.name, ROUND(x.v, 6) AS coefficient FROM it,
  (VALUES ('constant', 0), ('pct_diff', 1), ('points_diff', 2)) n(name, i),
  LATERAL (SELECT n.name, CASE n.i WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS v) x WHERE k = 9""")
def logistic_newton(spark, sf):
    """Coefficients of the ridge fit of a win on two differences of the sides' features."""
    from duelframe.operators.logistic import Penalty, fit_all
    fit, = fit_all(_differences(spark, sf), "y", list(DIFFERENCES), [Penalty(0.01)])
    rows = [("constant", fit.constant), *zip(DIFFERENCES, fit.coefficients.tolist())]
    return spark.createDataFrame(rows, "name string, v double").select("name", rounded("v").alias("coefficient"))


# One step by hand: the mean gradient of a network of one rectified unit at fixed weights.
@register("network_gradient", _LOGIT_DATA.replace("WITH RECURSIVE", "WITH", 1) + """
, unit AS (SELECT *, greatest(0.3 + 0.8 * x1 - 0.5 * x2, 0) AS h, 0.3 + 0.8 * x1 - 0.5 * x2 > 0 AS act FROM d)
, err AS (SELECT *, 1 / (1 + exp(-(0.1 + 1.5 * h))) - y AS r FROM unit)
, m AS (SELECT avg(CASE WHEN act THEN r * 1.5 * x1 ELSE 0 END) AS w0, avg(CASE WHEN act THEN r * 1.5 * x2 ELSE 0 END) AS w1,
               avg(r * h) AS w2, avg(CASE WHEN act THEN r * 1.5 ELSE 0 END) AS b0, avg(r) AS b1 FROM err)
SELECT n.name, ROUND(CASE n.name WHEN 'w0' THEN w0 WHEN 'w1' THEN w1 WHEN 'w2' THEN w2 WHEN 'b0' THEN b0 ELSE b1 END, 6) AS slope
FROM m, (VALUES ('w0'), ('w1'), ('w2'), ('b0'), ('b1')) n(name)""")
def network_gradient(spark, sf):
    """The gradient that one synchronous step of the network adds up, at given weights."""
    import numpy as np
    from duelframe.operators.network import Network, summed_gradient
    net = Network(list(DIFFERENCES), [np.array([[0.8], [-0.5]]), np.array([[1.5]])], [np.array([0.3]), np.array([0.1])])
    rows = _differences(spark, sf).select(F.col("y").cast("double").alias("y"), F.lit(1.0).alias("w"), *DIFFERENCES)
    g, _, n = summed_gradient(rows, net)
    return spark.createDataFrame(list(zip(("w0", "w1", "w2", "b0", "b1"), (g / n).tolist())), "name string, v double").select(
        "name", rounded("v").alias("slope"))


@register("network_scores")
def network_scores(spark, sf):
    """Held-out probabilities of a network trained in synchronous mini-batches for 10 epochs."""
    from duelframe.operators.network import fit_network, score_network
    train, test = _train_test(spark, sf)
    scale = {c: (r.mean or 0.0, r.std or 1.0) for r in mean_std(train, SCALED).collect() for c in [r.column]}

    def scaled(d):
        return d.withColumns({f"{c}_z": (F.col(c) - m) / s for c, (m, s) in scale.items()})
    inputs = ["win_pct_prior_A", "win_pct_prior_B", "win_pct_last5_A", "win_pct_last5_B", *[f"{c}_z" for c in SCALED]]
    net = fit_network(scaled(train), "win_A", inputs, neurons=32, layers=2, batches=5)
    return score_network(scaled(test), net).select("league", "game_key", "p1", (F.col("p1") > 0.5).cast("int").alias("prediction"))


# A tree in SQL: each round cuts every node at its best place, ties to the lower input and value.
@register("tree_leaves", _LOGIT_DATA + """
, t AS MATERIALIZED (SELECT row_number() OVER () AS r, y, x1, x2 FROM d WHERE train)
, it AS (
  SELECT '' AS path, r FROM t
  UNION ALL
  (WITH cur AS (SELECT path, r, y, f, CASE f WHEN 1 THEN x1 ELSE x2 END AS v
                FROM it JOIN t USING (r), (VALUES (1), (2)) n(f)),
   cum AS (SELECT path, f, v, lead(v) OVER w AS nv, CAST(count(*) OVER c AS DOUBLE) AS cw, sum(y) OVER c AS co,
                  CAST(count(*) OVER (PARTITION BY path, f) AS DOUBLE) AS n, sum(y) OVER (PARTITION BY path, f) AS o
           FROM cur WINDOW w AS (PARTITION BY path, f ORDER BY v),
                           c AS (PARTITION BY path, f ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
   cut AS (SELECT path, f, v, nv, 2 * co * (cw - co) / cw + 2 * (o - co) * ((n - cw) - (o - co)) / (n - cw) AS rest
           FROM cum WHERE nv > v AND o > 0 AND o < n AND n >= 20),
   best AS (SELECT path, f, CASE WHEN (v + nv) / 2 >= nv THEN v ELSE (v + nv) / 2 END AS thr
            FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY rest, f, v) AS k FROM cut) WHERE k = 1)
   SELECT path || CASE WHEN v <= thr THEN 'L' ELSE 'R' END, r FROM cur JOIN best USING (path, f)))
SELECT path, ROUND(avg(y), 6) AS value, count(*) AS n FROM (
  SELECT r, arg_max(path, length(path)) AS path FROM it GROUP BY r) JOIN t USING (r) GROUP BY path""")
def tree_leaves(spark, sf):
    """Leaves of one exact tree without sampling, no limit of depth, at least 20 rows to a cut."""
    from duelframe.operators.forest import fit_forest, leaves, score_forest
    train = _differences(spark, sf).where("train")
    made = fit_forest(train, "y", list(DIFFERENCES), n_trees=1, min_split=20, sample=False, features=2)
    # rows of a leaf: by the leaf that each training row falls in
    rows = score_forest(train, made, leaf="leaf").groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))
    return leaves(made).join(rows, "leaf").select("path", rounded("value").alias("value"), "n")


@register("forest_scores")
def forest_scores(spark, sf):
    """Held-out probabilities of a forest of 100 trees without a limit of depth."""
    from duelframe.operators.forest import fit_forest, score_forest
    train, test = _train_test(spark, sf)
    inputs = ["win_pct_prior_A", "win_pct_prior_B", "win_pct_last5_A", "win_pct_last5_B", *SCALED]
    made = fit_forest(train, "win_A", inputs, n_trees=100, min_split=4)
    return score_forest(test, made).select("league", "game_key", "p1", (F.col("p1") > 0.5).cast("int").alias("prediction"))


STRENGTHS = [10 ** (-5 + 7 * i / 99) for i in range(100)]


@register("strength_search", _LOGIT_DATA + """, setting AS (
  SELECT i AS t, 1 / (pow(10::DOUBLE, -5 + 7 * i / 99::DOUBLE) * (SELECT count(*) FROM d WHERE train)) AS lam FROM range(100) r(i))"""
          + _NEWTON.format(rows="train") + """
SELECT CAST(t AS INTEGER) AS trial, ROUND(avg(pow(1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) - y, 2)), 6) AS brier
FROM it, d WHERE k = 9 AND NOT train GROUP BY t""")
def strength_search(spark, sf):
    """100 strengths of one study fitted together, their held-out Brier scores."""
    from duelframe.operators.logistic import brier_scores, fit_all, inverse_strength
    d = _differences(spark, sf)
    train, test = d.where("train"), d.where("not train")
    n = train.count()
    fits = fit_all(train, "y", list(DIFFERENCES), [inverse_strength(c, n) for c in STRENGTHS])
    scores = list(enumerate(brier_scores(test, "y", list(DIFFERENCES), fits)))
    return spark.createDataFrame(scores, "trial int, v double").select("trial", rounded("v").alias("brier"))


PATH = [(s, r) for s in (0.1, 0.03, 0.01, 0.003, 0.001) for r in (0.25, 0.5, 1.0)]


# One coordinate a step: b <- soft(h b - g, lam ratio) / (h + lam (1 - ratio)), slopes anew each time.
@register("penalty_path", _LOGIT_DATA + ", setting AS (SELECT * FROM (VALUES "
          + ", ".join(f"({s}::DOUBLE, {r}::DOUBLE)" for s, r in PATH) + """) s(lam, ratio))
, it AS (
  SELECT 0 AS k, lam, ratio, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM setting
  UNION ALL
  SELECT k + 1, lam, ratio, CASE WHEN k % 3 = 0 THEN b0 - g / h ELSE b0 END,
    CASE WHEN k % 3 = 1 THEN sign(h * b1 - g) * greatest(abs(h * b1 - g) - lam * ratio, 0) / (h + lam * (1 - ratio)) ELSE b1 END,
    CASE WHEN k % 3 = 2 THEN sign(h * b2 - g) * greatest(abs(h * b2 - g) - lam * ratio, 0) / (h + lam * (1 - ratio)) ELSE b2 END
  FROM (SELECT k, lam, ratio, b0, b1, b2, avg((p - y) * x) AS g, avg(p * (1 - p) * x * x) AS h
        FROM (SELECT *, 1 / (1 + exp(-(b0 + b1 * x1 + b2 * x2))) AS p, CASE k % 3 WHEN 0 THEN 1 WHEN 1 THEN x1 ELSE x2 END AS x
              FROM it, d WHERE k < 180)
        GROUP BY k, lam, ratio, b0, b1, b2))
SELECT lam AS strength, ratio, x.name, ROUND(x.v, 6) AS coefficient FROM it,
  (VALUES ('constant', 0), ('pct_diff', 1), ('points_diff', 2)) n(name, i),
  LATERAL (SELECT n.name, CASE n.i WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS v) x WHERE k = 180""")
def penalty_path(spark, sf):
    """Coefficients along a path of strengths for three shares of the absolute-value penalty."""
    from duelframe.operators.logistic import Penalty, fit_all
    fits = fit_all(_differences(spark, sf), "y", list(DIFFERENCES), [Penalty(*x) for x in PATH])
    rows = [(f.penalty.strength, f.penalty.ratio, n, v) for f in fits
            for n, v in [("constant", f.constant), *zip(DIFFERENCES, f.coefficients.tolist())]]
    return spark.createDataFrame(rows, "strength double, ratio double, name string, v double").select(
        "strength", "ratio", "name", rounded("v").alias("coefficient"))


@register("matchup_scores")
def matchup_scores(spark, sf):
    """Bulk scoring: every contest pairing scored as a neutral-court game
    from both teams' latest serving state, by a model fitted on the
    paired pre-game features."""
    from duelframe.plans import model as M
    from duelframe.plans import scoring as S
    train, _ = _train_test(spark, sf)
    spec = M.contest_spec(train)
    fitted = M.fit(train, spec, M.logistic(train, spec, M.DEPLOYED_C, "l2"))
    games = C.contest(Tables(spark, sf).events)
    req = games.select("league", "game_key", F.col("w_id").alias("team_1"), F.col("l_id").alias("team_2"))
    rows = S.contest_matchup_rows(req, S.contest_state(C.team_game(games), _cuts(spark, sf)))
    out = fitted.transform(rows)
    return out.select("league", "game_key", "team_1", "team_2",
                      M.prob1().alias("p_team_1"),
                      F.when(F.col("prediction") == 1, F.col("team_1")).otherwise(F.col("team_2"))
                      .alias("winner"))


# --------------------------------------------------------------------------
# Model preparation as data (M1, M3-M6, M13, M15), with SQL

SCALED = ("points_mean_prior_A", "points_mean_prior_B", "allowed_mean_prior_A", "allowed_mean_prior_B")


@register("one_hot_long", _flagship_sql().replace("SELECT a.league", ", g AS (SELECT a.league", 1) + """)
, train AS (SELECT DISTINCT loc_A FROM g WHERE game_key % 10 < 7)
SELECT g.league, g.game_key, t.loc_A AS category, CASE WHEN g.loc_A = t.loc_A THEN 1 ELSE 0 END AS hot
FROM g CROSS JOIN train t""")
def one_hot_long(spark, sf):
    """One-hot rows of side A's location: one row per game and category seen in training
    (keys ending in 0-6); an unseen category is 0 everywhere."""
    from pyspark.ml import Pipeline
    from pyspark.ml.functions import vector_to_array
    from duelframe.plans import model as M
    g = game_features(_team_games(spark, sf), cuts=_cuts(spark, sf)).select("league", "game_key", "loc_A")
    train = g.where(F.col("game_key") % 10 < 7)
    prep = Pipeline(stages=M.feature_stages(train, M.ModelSpec("win_A", onehot=["loc_A"]))).fit(train)
    labels = F.array(*[F.lit(x) for x in prep.stages[1].labelsArray[0]])  # three locations
    return prep.transform(g).select("league", "game_key", F.explode(F.arrays_zip(
        labels.alias("category"), vector_to_array("features").alias("hot"))).alias("x")).select(
        "league", "game_key", "x.category", F.col("x.hot").cast("int").alias("hot"))


CODED = ("o_custkey", "o_orderpriority")


@register("category_codes", """
WITH l AS (""" + " UNION ALL ".join(f"SELECT o_orderkey, '{c}' AS col_name, CAST({c} AS VARCHAR) AS value FROM orders" for c in CODED) + """),
codes AS (SELECT col_name, value, ROW_NUMBER() OVER (ORDER BY col_name, value) - 1 AS code
          FROM (SELECT DISTINCT col_name, value FROM l WHERE o_orderkey % 10 < 7))
SELECT o_orderkey, col_name, code FROM l JOIN codes USING (col_name, value)""")
def category_codes(spark, sf):
    """Customers and priorities as sparse codes of the values seen in training (keys ending
    in 0-6); a customer unseen there has no row."""
    from duelframe.operators.encode import encode_long, fit_codes
    o = Tables(spark, sf).orders.select("o_orderkey", *CODED)
    codes = fit_codes(o.where(F.col("o_orderkey") % 10 < 7), CODED)
    return encode_long(o, ["o_orderkey"], CODED, codes).withColumnRenamed("column", "col_name")


@register("scaled_features", _flagship_sql().replace("SELECT a.league", ", g AS (SELECT a.league", 1) + ")\n"
          + "SELECT league, game_key, " + ", ".join(
              f"ROUND(({c} - (SELECT AVG({c}) FROM g)) / (SELECT STDDEV_POP({c}) FROM g), 6) AS {c}" for c in SCALED)
          + " FROM g")
def scaled_features(spark, sf):
    """Features scaled by their mean and population deviation over all rows."""
    from duelframe.plans import model as M
    g = game_features(_team_games(spark, sf), cuts=_cuts(spark, sf))
    z = M.population_scaler(g, SCALED).transform(g)
    return z.select("league", "game_key", *[rounded(f"{c}__z").alias(c) for c in SCALED])


VOTE = {"win_pct_prior_A": 1.7, "win_pct_prior_B": -1.3}


@register("voted_probability", _flagship_sql().replace("SELECT a.league", ", g AS (SELECT a.league", 1) + """)
, p AS (SELECT league, game_key, 1 / (1 + EXP(-(0.1 + 1.7 * win_pct_prior_A - 1.3 * win_pct_prior_B))) AS p1,
               CASE WHEN points_mean_prior_A > points_mean_prior_B THEN 0.75 ELSE 0.25 END AS p2 FROM g)
SELECT league, game_key, ROUND((2 * p1 + p2) / 3, 6) AS p1, CASE WHEN (2 * p1 + p2) / 3 > 0.5 THEN 1 ELSE 0 END AS prediction
FROM p""")
def voted_probability(spark, sf):
    """Weighted soft vote of two fixed scorers: given logistic coefficients, and a rule on
    the scoring means."""
    from duelframe.plans import model as M
    g = game_features(_team_games(spark, sf), cuts=_cuts(spark, sf))
    rule = F.when(F.col("points_mean_prior_A") > F.col("points_mean_prior_B"), 0.75).otherwise(0.25)
    vote = M.soft_vote([M.fixed_logistic(VOTE, 0.1), rule], g, ["league", "game_key"], M.ModelSpec("win_A"), [2.0, 1.0])
    return vote.select("league", "game_key", rounded("p1").alias("p1"), "prediction")


# --------------------------------------------------------------------------
# The full feature set on the two-sided table

STATS = {"points": "points", "allowed": "allowed", "margin": "points - allowed", "total": "points + allowed",
         "share": "points / (points + allowed)", "points_third": "points / 3", "allowed_third": "allowed / 3",
         "home_points": "CASE WHEN loc = 'H' THEN points END", "away_points": "CASE WHEN loc = 'A' THEN points END",
         "neutral_points": "CASE WHEN loc = 'N' THEN points END", "home_allowed": "CASE WHEN loc = 'H' THEN allowed END",
         "away_allowed": "CASE WHEN loc = 'A' THEN allowed END",
         "neutral_allowed": "CASE WHEN loc = 'N' THEN allowed END",
         "win_points": "CASE WHEN win = 1 THEN points END", "loss_points": "CASE WHEN win = 0 THEN points END",
         "win_margin": "CASE WHEN win = 1 THEN points - allowed END",
         "loss_margin": "CASE WHEN win = 0 THEN points - allowed END", "high": "CASE WHEN points > 50 THEN 1 ELSE 0 END",
         "low": "CASE WHEN allowed < 50 THEN 1 ELSE 0 END", "close": "CASE WHEN abs(points - allowed) < 10 THEN 1 ELSE 0 END",
         "home": "CASE WHEN loc = 'H' THEN 1 ELSE 0 END", "away": "CASE WHEN loc = 'A' THEN 1 ELSE 0 END"}


@register("statistics_means", with_views(*TEAM_VIEWS, body=", x AS (SELECT league, game_key, team_id, day_num, "
          + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in STATS.items()) + " FROM team_game)\n"
          + "SELECT league, game_key, team_id, " + ", ".join(
              f"ROUND(AVG({n}) OVER {PRIOR}, 9) AS {n}_overall, "
              f"ROUND(CASE WHEN COUNT({n}) OVER {LAST5} = 5 THEN AVG({n}) OVER {LAST5} END, 9) AS {n}_last5" for n in STATS)
          + " FROM x"))
def statistics_means(spark, sf):
    """22 statistics, each as an expanding and a last-5 pre-game mean, in one window pass."""
    tg = _team_games(spark, sf).select("league", "game_key", "team_id", "day_num",
                                       *[F.expr(e).cast("double").alias(n) for n, e in STATS.items()])
    feats = [f for n in STATS for f in (Feat(f"{n}_overall", "mean", n), Feat(f"{n}_last5", "mean", n, 5))]
    out = team_window(tg, feats, _cuts(spark, sf))
    return out.select("league", "game_key", "team_id", *[rounded(f.name, 9).alias(f.name) for f in feats])


@register("power_win_shares", with_views(*TEAM_VIEWS, body=f"""
, x AS (SELECT *, opp_id % 5 = 0 AS power FROM team_game)
, s AS (SELECT league, game_key, team_id,
  SUM(CASE WHEN power AND win = 1 THEN 1 ELSE 0 END) OVER {PRIOR} AS pw,
  SUM(CASE WHEN power AND win = 0 THEN 1 ELSE 0 END) OVER {PRIOR} AS pl,
  SUM(CASE WHEN NOT power AND win = 1 THEN 1 ELSE 0 END) OVER {PRIOR} AS nw,
  SUM(CASE WHEN NOT power AND win = 0 THEN 1 ELSE 0 END) OVER {PRIOR} AS nl FROM x)
SELECT league, game_key, team_id,
  CASE WHEN pw + pl = 0 THEN CAST('NaN' AS DOUBLE) ELSE ROUND(CAST(pw AS DOUBLE) / (pw + pl), 6) END AS power_share,
  CASE WHEN nw + nl = 0 THEN CAST('NaN' AS DOUBLE) ELSE ROUND(CAST(nw AS DOUBLE) / (nw + nl), 6) END AS other_share
FROM s"""))
def power_win_shares(spark, sf):
    """Win shares against power and other opponents as ratios of two sums: 0 / 0 is NaN
    before any such game, null on a team's first game."""
    power = (F.col("opp_id") % 5) == 0
    tg = _team_games(spark, sf).withColumns({
        "pw": flag(power & (F.col("win") == 1)), "pl": flag(power & (F.col("win") == 0)),
        "nw": flag(~power & (F.col("win") == 1)), "nl": flag(~power & (F.col("win") == 0))})
    out = team_window(tg, [Feat(f"s_{c}", "sum", c) for c in ("pw", "pl", "nw", "nl")], _cuts(spark, sf))

    def share(w: str, l: str):
        total = F.col(f"s_{w}") + F.col(f"s_{l}")
        return F.when(total == 0, F.lit(float("nan"))).otherwise(
            F.round(F.try_divide(F.col(f"s_{w}").cast("double"), total), 6))
    return out.select("league", "game_key", "team_id", share("pw", "pl").alias("power_share"),
                      share("nw", "nl").alias("other_share"))


@register("manager_wins_filled", with_views(*TEAM_VIEWS, TENURE, body="""
, g AS (SELECT t.league, t.game_key, t.team_id, t.day_num, t.win, t.loc, u.manager
        FROM team_game t JOIN tenure u ON t.team_id = u.team_id AND u.first_day <= t.day_num AND t.day_num <= u.last_day)
, tw AS (SELECT game_key, team_id, manager,
           SUM(win) OVER (PARTITION BY manager ORDER BY day_num, game_key, team_id
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - win AS wins_in
         FROM g WHERE loc = 'N')
, j AS (SELECT g.*, tw.wins_in FROM g LEFT JOIN tw ON g.game_key = tw.game_key AND g.team_id = tw.team_id
                                               AND g.manager = tw.manager)
SELECT league, game_key, team_id, manager, CAST(COALESCE(
  LAST_VALUE(wins_in IGNORE NULLS) OVER (PARTITION BY manager ORDER BY day_num, game_key, team_id
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  FIRST_VALUE(wins_in IGNORE NULLS) OVER (PARTITION BY manager ORDER BY day_num, game_key, team_id
                                          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS BIGINT) AS wins_in
FROM j"""))
def manager_wins_filled(spark, sf):
    """Neutral-site wins coming in by manager, across teams and leagues: forward filled
    along the manager's career, then back filled, then 0."""
    ev = _events(spark, sf)
    tg = _team_games(spark, sf).select("league", "game_key", "team_id", "day_num", "win", "loc")
    g = interval_join(tg, C.tenure(ev), ["team_id"], "day_num", "first_day", "last_day", "inner",
                      cuts=_day_cuts(spark, sf, "team_id")).select(
        "league", "game_key", "team_id", "day_num", "win", "loc", "manager")
    g = written(g, "games")  # read three times
    order = ["day_num", "game_key", "team_id"]
    cuts = find_cuts(g, ["manager"], order)
    n = g.where(F.col("loc") == "N").select("manager", *order, "win")
    wins = sliced_window(n, ["manager"], order, [Feat("w", "sum", "win")], cuts).select(
        "manager", "game_key", "team_id", F.coalesce("w", F.lit(0)).cast("bigint").alias("wins_in"))
    j = g.join(wins, ["manager", "game_key", "team_id"], "left")
    out = sliced_window(j, ["manager"], order, [Feat("ff", "ffill", "wins_in"), Feat("bf", "bfill", "wins_in")], cuts)
    return out.select("league", "game_key", "team_id", "manager",
                      F.coalesce("ff", "bf", F.lit(0).cast("bigint")).alias("wins_in"))


@register("carried_rank", with_views(*TEAM_VIEWS, PUBLICATION, PERIODS_FILE, RANKED, ACTIVE_RANK, body=f"""
SELECT league, game_key, team_id, COALESCE(ordinal, 9999) AS active_rank,
       COALESCE(LAST_VALUE(ordinal IGNORE NULLS) OVER ({W_TEAM} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9999)
         AS carried_rank
FROM active"""))
def carried_rank(spark, sf):
    """The active rank as published, and carried over expired lists."""
    a = team_window(_active(spark, sf, "file"), [Feat("ff", "ffill", "ordinal")], _cuts(spark, sf))
    none = F.lit(9999).cast("bigint")
    return a.select("league", "game_key", "team_id", F.coalesce("ordinal", none).alias("active_rank"),
                    F.coalesce("ff", none).alias("carried_rank"))


@register("seeds_on_neutral_games", with_views(*TEAM_VIEWS, body="""
, s AS (SELECT c_custkey AS team_id, substring(c_mktsegment, 1, 1) || printf('%02d', c_custkey % 16 + 1) || 'a' AS seed
        FROM customer)
SELECT league, game_key, t.team_id, loc,
       CASE WHEN loc = 'N' THEN CAST(substring(seed, 2, 2) AS INTEGER) END AS seed
FROM team_game t LEFT JOIN s ON t.team_id = s.team_id"""))
def seeds_on_neutral_games(spark, sf):
    """Seed codes (region, two digits, letter) as numbers, on neutral games only."""
    seeds = Tables(spark, sf).customer.select(F.col("c_custkey").alias("team_id"), F.concat(
        F.substring("c_mktsegment", 1, 1), F.lpad((F.col("c_custkey") % 16 + 1).cast("string"), 2, "0"),
        F.lit("a")).alias("code"))
    tg = _team_games(spark, sf).select("league", "game_key", "team_id", "loc").join(seeds, "team_id", "left")
    return tg.select("league", "game_key", "team_id", "loc",
                     F.when(F.col("loc") == "N", code_number("code", 2, 2)).alias("seed"))


# --------------------------------------------------------------------------
# Files (S1, S4, S7, S8)

@register("csv_round_trip", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS season, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total
FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1""")
def csv_round_trip(spark, sf):
    """Orders written as CSV, split by season, read back with a declared schema that the
    header must match, and one season sliced (a pruned read)."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/csv-{uuid.uuid4().hex}"
    o = Tables(spark, sf).orders.select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season"))
    write_csv(o, f"{root}/flat")
    back = read_csv(spark, f"{root}/flat", o.schema)
    write_parquet(back, f"{root}/seasons", partition_by=["season"])
    one = season_slice(spark.read.parquet(f"{root}/seasons"), "season", 1996)
    return one.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@register("model_reload")
def model_reload(spark, sf):
    """A fitted pipeline saved, loaded and applied."""
    from duelframe.plans import model as M
    train, test = _train_test(spark, sf)
    spec = M.contest_spec(train)
    path = f"{checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    M.save(M.fit(train, spec, M.logistic(train, spec, M.DEPLOYED_C, "l2")), path)
    return M.scored(M.load(path), test, ["league", "game_key"], spec)


# --------------------------------------------------------------------------
# Declared-but-unexecuted ideas of the reference

LAST10 = _frame("10 PRECEDING")


@register("rolling10_mean_prior", _mean_sql(LAST10, 10))
def rolling10_mean_prior(spark, sf):
    """Last-10 variant of the last-n means (a window parameter)."""
    return _means(spark, sf, False, 10)


@register("win_pct_by_opp_conf", with_views(*TEAM_VIEWS, CONF, body="""
, t AS (SELECT g.*, c.n_name AS opp_conf FROM team_game g LEFT JOIN conf c ON g.opp_id = c.c_custkey)
SELECT league, game_key, team_id, opp_conf,
       ROUND(CAST(SUM(win) OVER (PARTITION BY league, team_id, opp_conf ORDER BY day_num, game_key
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE)
             / COUNT(win) OVER (PARTITION BY league, team_id, opp_conf ORDER BY day_num, game_key
                                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS win_pct_vs_conf
FROM t"""))
def win_pct_by_opp_conf(spark, sf):
    """Win share coming in against each opponent conference (the
    opponent's nation): the entity window gains the conference key."""
    t = Tables(spark, sf)
    conf = (t.customer.select("c_custkey", "c_nationkey")
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name"))
    tg = dim_lookup(_team_games(spark, sf), conf, ["opp_id"], ["c_custkey"], {"n_name": "opp_conf"})
    # a team's games against one conference are no more than its games
    cuts = Cuts(None) if _cuts(spark, sf).table is None else None
    out = sliced_window(tg, ["league", "team_id", "opp_conf"], ORDER, [Feat("pct", "mean", "win")], cuts)
    return out.select("league", "game_key", "team_id", "opp_conf", rounded("pct").alias("win_pct_vs_conf"))


@register("prior_season_status", """
WITH s AS (SELECT o_custkey AS ck, CAST(year(o_orderdate) AS BIGINT) AS season,
                  MAX(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent
           FROM orders GROUP BY o_custkey, CAST(year(o_orderdate) AS BIGINT))
SELECT o.o_orderkey, o.o_custkey, CAST(year(o.o_orderdate) AS BIGINT) AS season,
       COALESCE(s.urgent, 0) AS prior_urgent
FROM orders o LEFT JOIN s ON o.o_custkey = s.ck AND CAST(year(o.o_orderdate) AS BIGINT) - 1 = s.season""")
def prior_season_status(spark, sf):
    """Status of the previous season attached by a left join on
    ``season - 1`` (here: whether the customer placed an urgent order)."""
    o = Tables(spark, sf).orders.select("o_orderkey", "o_custkey", "o_orderpriority",
                                         F.year("o_orderdate").cast("bigint").alias("season"))
    status = (o.groupBy("o_custkey", "season")
               .agg(F.max(flag(F.col("o_orderpriority") == "1-URGENT")).alias("urgent"))
               .select("o_custkey", (F.col("season") + 1).alias("season"), "urgent"))
    return (o.join(status, ["o_custkey", "season"], "left")
             .select("o_orderkey", "o_custkey", "season", F.coalesce("urgent", F.lit(0)).alias("prior_urgent")))
