"""Driver contract and plan shape of the registered queries."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001
from duelframe.sources.tables import TABLES

MODEL_JOBS = {"train_logistic_score", "soft_vote", "search_trials", "matchup_scores", "model_reload", "network_scores",
              "forest_scores"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() == 231
    assert "win_A" in df.columns and "win_B" not in df.columns


def test_every_query_has_an_oracle_except_model_jobs():
    q, o = E.queries(), E.oracle_sql()
    document = set(E.LLM_QUERIES)
    assert set(q) - set(o) - document == MODEL_JOBS
    assert set(o) <= set(q)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF0001}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float) and v != v:
        return "nan"
    return repr(v)


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - set(E.LLM_QUERIES)))
def test_differential_sf0001(spark, duck, name):
    df = E.queries()[name](spark, SF0001)
    cur = duck.execute(E.oracle_sql()[name])
    d_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(d_cols)
    s = sorted(tuple(_norm(r[c]) for c in sorted(df.columns)) for r in df.collect())
    idx = sorted(range(len(d_cols)), key=lambda i: d_cols[i])
    d = sorted(tuple(_norm(row[i]) for i in idx) for row in cur.fetchall())
    assert s == d


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR"}


@pytest.mark.parametrize("name", sorted(set(E.oracle_sql()) - set(E.LLM_QUERIES)))
def test_oracle_types_match(spark, duck, name):
    """Column types agree too (e.g. integer sums cast to BIGINT on the SQL side)."""
    df = E.queries()[name](spark, SF0001)
    rel = duck.sql(E.oracle_sql()[name])
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for c, t in df.dtypes:
        assert SPARK_TO_DUCK.get(t, t) == duck_types[c], (c, t, duck_types[c])


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - MODEL_JOBS - set(E.LLM_QUERIES)))
def test_no_python_udf_in_plans(spark, name):
    plan = _plan(E.queries()[name](spark, SF0001))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_features_cross_one_wide_exchange(spark):
    """All team features share one exchange of the team's rows; with no hot team the
    run drops what would treat one: the executed plan has at most twice the exchanges
    of the plain window plan (one for the pairs, one for the teams, one for the games)."""
    import re
    df = E.queries()["game_features"](spark, SF0001)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    used = [x for x in re.findall(r"(\w*)Exchange ", plan) if x not in ("Broadcast", "Reused")]
    assert len(used) <= 6, plan


def test_rank_join_has_no_explode(spark):
    plan = _plan(E.queries()["rank_asof_range_join"](spark, SF0001))
    # periods are matched by a range condition, never expanded into days
    assert "sequence(period" not in plan


def test_scan_prunes_and_pushes(spark):
    plan = _plan(E.queries()["scan_filter_project"](spark, SF0001))
    assert "PushedFilters: [IsNotNull(l_returnflag), IsNotNull(l_quantity)" in plan
    assert "l_shipdate" not in plan.split("ReadSchema:")[1].split("\n")[0]


SLICED_SENSITIVE = ["mirror_two_sided", "game_features", "streak_length", "surrogate_key",
                    "stratified_split", "global_medians", "forward_fill", "wins_coming_in_filled",
                    "season_best_rank", "rolling5_mean_prior", "suffix_rename_pair",
                    "days_since_previous", "matchup_features"]


@pytest.mark.parametrize("name", SLICED_SENSITIVE)
def test_differential_sliced_plans(spark, duck, name):
    """Groups of more than a few rows treated as hot: the oracle's rows too."""
    spark.conf.set("spark.duelframe.hotRows", "15")
    try:
        test_differential_sf0001(spark, duck, name)
    finally:
        spark.conf.unset("spark.duelframe.hotRows")
