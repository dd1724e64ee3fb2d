"""The end-to-end job from CSV files to model rows and a saved model."""

from pyspark.sql import functions as F

from duelframe.plans import job, sports as SP


def test_job_from_csv(spark, fx, tmp_path):
    paths = {}
    for k in job.INPUTS:
        p = str(tmp_path / "in" / k)
        fx[k].coalesce(1).write.option("header", True).csv(p)
        paths[k] = p
    out = str(tmp_path / "out")
    written = job.run(spark, paths, out, season=2025, train=True)
    assert set(written) == {"rankings", "team_games", "model_rows", "model"}
    pairs = spark.read.parquet(written["model_rows"])
    assert len(pairs.columns) == 77 and pairs.count() > 0
    # same rows as the in-memory pipeline
    tg = SP.team_games(fx["regular"], fx["tourney"], fx["compact"], fx["conf_games"], fx["team_confs"],
                       fx["coaches"], fx["seeds"], fx["systems"])
    assert spark.read.parquet(written["team_games"]).count() == tg.count()
    s25 = job.season_slice(spark, out, 2025)
    plan = s25._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and s25.count() == tg.where(F.col("Season") == 2025).count()
    # score requested pairings with the saved model, in one batch
    teams = str(tmp_path / "in" / "teams")
    fx["teams"].coalesce(1).write.option("header", True).csv(teams)
    req = str(tmp_path / "in" / "requests.csv")
    with open(req, "w") as f:
        f.write("team_1_name,team_1_seed,team_2_name,team_2_seed\n"
                "Team 1101,1,Team 1102,8\nTeam 1103,4,Nobody,5\nTeam 1104,,Team 1105,3\n"
                "Team 1106,2,Team 1107,7\n")
    pred = spark.read.parquet(job.score(spark, out, req, teams, 2025)).collect()
    assert len(pred) == 2
    assert all(r["winner"] in (r["team_1_name"], r["team_2_name"]) for r in pred)
