"""Golden values of the contest views and the flagship (FIXTURES §3; the rankings, which
are published weekly and hold every team, from the oracle SQL)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF0001, SF001
from duelframe.operators.hot import CONF as HOT_CONF
from duelframe.operators.joins import interval_join
from duelframe.operators.ranks import active_rank, ranked_periods
from duelframe.plans import contest as C
from duelframe.plans.features import game_features
from duelframe.sources.tables import Tables

GOLD = {
    SF0001: dict(contest=(462, 3269, 3364, 35046.86, 6537), h_a=(263, 98), tg=924, tenure=(20, 17),
                 interval=914, pub=(298, 16420), ranked_season=(683, 5448), ranked_file=(637, 5034),
                 flag=(231, 77, 178, 11635.5807, 11868.244)),
    SF001: dict(contest=(4966, 371663, 365731, 369762.85, 72029), h_a=(2985, 1014), tg=9932,
                tenure=(200, 20), interval=9831, pub=(2963, 16336303), ranked_season=(7496, 554985),
                ranked_file=(6970, 517401), flag=(2634, 791, 2107, 131652.1654, 130878.426)),
}


@pytest.fixture(scope="module", params=[SF0001, SF001])
def views(request, spark):
    ev = Tables(spark, request.param).events
    games = C.contest(ev)
    return request.param, ev, games, C.team_game(games)


@pytest.mark.parametrize("hot_rows", ["15", "2000000"])
def test_contest_goldens(views, spark, hot_rows):
    sf, ev, _, _ = views
    spark.conf.set(HOT_CONF, hot_rows)
    games = C.contest(ev)
    spark.conf.unset(HOT_CONF)
    r = games.agg(F.count("*"), F.sum("w_id"), F.sum("l_id"), F.round(F.sum("w_score"), 2),
                  F.sum("day_num")).first()
    assert tuple(r) == GOLD[sf]["contest"]
    locs = {x["w_loc"]: x["count"] for x in games.groupBy("w_loc").count().collect()}
    assert (locs["H"], locs["A"]) == GOLD[sf]["h_a"]


def test_mirror_invariants(views):
    sf, _, games, tg = views
    assert tg.count() == GOLD[sf]["tg"] == 2 * games.count()
    r = tg.agg(F.sum("win"), F.sum(1 - F.col("win")),
               F.sum(F.when(F.col("loc") == "H", 1).otherwise(0)),
               F.sum(F.when(F.col("loc") == "A", 1).otherwise(0))).first()
    assert r[0] == r[1] and r[2] == r[3]
    # every game has exactly its two teams
    assert tg.groupBy("league", "game_key").count().where("count <> 2").count() == 0


def test_tenure_and_interval_join(views):
    sf, ev, _, tg = views
    ten = C.tenure(ev)
    assert (ten.count(), ten.select("manager").distinct().count()) == GOLD[sf]["tenure"]
    j = interval_join(tg, ten, ["team_id"], "day_num", "first_day", "last_day", "inner")
    assert j.count() == GOLD[sf]["interval"]


def test_publication_and_rank_join(views):
    sf, ev, _, tg = views
    pub = C.publication(ev)
    r = pub.agg(F.count("*"), F.sum(F.col("ordinal") * F.col("team_id"))).first()
    assert tuple(r) == GOLD[sf]["pub"]
    for scope, key in (("season", "ranked_season"), ("file", "ranked_file")):
        a = active_rank(tg, ranked_periods(pub, "league", "pub_day", scope, C.open_end()), "league", "team_id",
                        "day_num", "ordinal", "ordinal")
        r = a.agg(F.count("ordinal"), F.sum("ordinal")).first()
        assert tuple(r) == GOLD[sf][key], scope


def test_flagship(views):
    sf, _, _, tg = views
    g = game_features(tg)
    r = g.agg(F.count("*"), F.sum("win_A"), F.sum(F.when(F.col("loc_A") == "A", 1).otherwise(0)),
              F.round(F.sum("points_mean_prior_A"), 4), F.round(F.sum("points_mean_last5_B"), 4)).first()
    assert tuple(r) == GOLD[sf]["flag"]


def test_contest_independent_of_session_zone(spark):
    """Slices come from wall-clock fields, so a daylight-saving session
    zone gives the same games."""
    ev = Tables(spark, SF0001).events
    spark.conf.set(HOT_CONF, "15")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = C.contest(ev).agg(F.count("*"), F.sum("w_id"), F.sum("day_num")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.unset(HOT_CONF)
    assert (r[0], r[1], r[2]) == (462, 3269, 6537)
