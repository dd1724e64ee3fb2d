"""Model jobs: seeded, finite, unseen categories, save / load."""

import math

import pytest
from pyspark.sql import functions as F

from duelframe.plans import model as M
from duelframe.plans import scoring as S
from duelframe.plans import sports as SP


@pytest.fixture(scope="module")
def pairs(fx):
    tg = SP.team_games(fx["regular"], fx["tourney"], fx["compact"], fx["conf_games"], fx["team_confs"],
                       fx["coaches"], fx["seeds"], fx["systems"]).cache()
    return SP.final_pairs(SP.model_features(tg)).cache(), tg


def test_sports_model_fit_score_reload(spark, pairs, tmp_path):
    fp, tg = pairs
    spec = M.sports_spec(fp)
    assert len(spec.scale) == 16 and len(spec.ratios) == 32 and len(spec.onehot) == 24
    model = M.fit(fp, spec, M.logistic(fp, spec, M.DEPLOYED_C, "l2", max_iter=50))
    out = M.scored(model, fp, ["Season"], spec)
    b = M.brier(out)
    assert math.isfinite(b) and b < 0.25
    path = str(tmp_path / "m")
    M.save(model, path)
    again = M.scored(M.load(path), fp, ["Season"], spec)
    assert math.isclose(M.brier(again), b, rel_tol=1e-12)
    # bulk scoring of requested pairings; unseen seeds and an unknown name
    state = SP.serving_state(tg.where("Season = 2025"))
    req = spark.createDataFrame([("Team 1101", 3, "Team 1102", 99), ("Team 1103", 1, "Nobody", 2),
                                 ("Team 1104", None, "Team 1105", 4)], ",".join(
        f"{c} {'string' if 'name' in c else 'int'}" for c in S.REQUEST_COLUMNS))
    rows = S.sports_matchup_rows(req, fx_teams(spark), state, 2025)
    res = S.predict_winner(model, rows).collect()
    assert len(res) == 1 and res[0]["winner"] in ("Team 1101", "Team 1102")


def fx_teams(spark):
    return spark.createDataFrame([(t, f"Team {t}") for t in range(1101, 1113)], "TeamID int, TeamName string")


def test_weighted_forest_vote_and_search(spark, pairs):
    fp, _ = pairs
    rows = M.sports_training_rows(fp, 2025)
    rows = rows.withColumn("rid", F.xxhash64(*[F.col(c) for c in fp.columns]))
    assert rows.select("rid").distinct().count() == rows.count()
    spec = M.sports_spec(rows, weight="train_weight")
    rf = M.fit(rows, spec, M.forest(spec, n_trees=10, min_split=4))
    lr = M.fit(rows, spec, M.logistic(rows, spec, 0.1, "elasticnet", 0.5, max_iter=30))
    vote = M.soft_vote([rf, lr], rows, ["rid"], spec).collect()
    assert len(vote) == rows.count()
    assert all(0.0 <= r["p1"] <= 1.0 and r["prediction"] == int(r["p1"] > 0.5) for r in vote)
    res = M.search(rows, rows, spec, "logistic_l1", n_trials=3, parallelism=2, max_iter=20).collect()
    assert len(res) == 3 and all(math.isfinite(r["brier"]) for r in res)
    res2 = M.search(rows, rows, spec, "logistic_l1", n_trials=3, parallelism=1, max_iter=20).collect()
    assert sorted(r["params"] for r in res) == sorted(r["params"] for r in res2)


def test_network_search(spark, pairs):
    fp, _ = pairs
    spec = M.sports_spec(fp)
    res = M.search(fp, fp, spec, "network", n_trials=2, parallelism=2, max_iter=5).collect()
    assert len(res) == 2 and all(math.isfinite(r["brier"]) for r in res)
    assert res[0]["brier"] <= res[1]["brier"]  # best first
