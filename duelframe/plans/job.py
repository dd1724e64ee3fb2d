"""End-to-end batch job on the sports CSV inputs.

    python -m duelframe.plans.job --regular R.csv --tourney T.csv --compact C.csv \\
        --conf-games G.csv --team-confs TC.csv --coaches CO.csv --seeds S.csv \\
        --ordinals O.csv --out OUT [--season 2025] [--train]

Steps: read every input with its declared schema; split the all-systems
ranking file by system in one partitioned write and read the AP / POM /
NET partitions back (pruned); enrich the per team-game table; write it
partitioned by season (a later season slice is a pruned read); build the
paired model rows and write them; optionally fit the deployed logistic
model on the tournament games plus the latest season and save it, and
score a file of requested pairings with it in one batch.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from duelframe.plans import sports as SP
from duelframe.sources import schemas as S
from duelframe.operators.joins import assert_unique
from duelframe.sources.files import read_csv, read_partition, season_slice as slice_rows, write_parquet

INPUTS = {
    "regular": S.DETAILED_RESULTS, "tourney": S.DETAILED_RESULTS, "compact": S.COMPACT_RESULTS,
    "conf_games": S.CONFERENCE_TOURNEY_GAMES, "team_confs": S.TEAM_CONFERENCES,
    "coaches": S.TEAM_COACHES, "seeds": S.TOURNEY_SEEDS, "ordinals": S.ORDINALS,
}
SYSTEMS = ("AP", "POM", "NET")
UNIQUE = {"team_confs": ["Season", "TeamID"], "seeds": ["Season", "TeamID"]}


def run(spark: SparkSession, paths: dict[str, str], out: str, season: int = 2025,
        train: bool = False, rank_scope: str = "file") -> dict[str, str]:
    d = {k: read_csv(spark, paths[k], INPUTS[k]) for k in INPUTS}
    for name, keys in UNIQUE.items():  # a repeated dimension key would repeat games
        again = assert_unique(d[name], keys)
        if not again.isEmpty():
            raise ValueError(f"{name} repeats a key: {again.first().asDict()}")
    split_root = f"{out}/rankings"
    SP.split_rankings(d["ordinals"], split_root, fmt="parquet")
    systems = {s: read_partition(spark, split_root, "System", s).drop("System") for s in SYSTEMS}
    tg = SP.team_games(d["regular"], d["tourney"], d["compact"], d["conf_games"], d["team_confs"],
                       d["coaches"], d["seeds"], systems, rank_scope=rank_scope)
    games_path = f"{out}/team_games"
    write_parquet(tg, games_path, partition_by=["Season"])
    tg = spark.read.parquet(games_path)  # lineage cut at a written table
    pairs_path = f"{out}/model_rows"
    write_parquet(SP.final_pairs(SP.model_features(tg)), pairs_path)
    written = {"rankings": split_root, "team_games": games_path, "model_rows": pairs_path}
    if train:
        from duelframe.plans import model as M
        rows = M.sports_training_rows(spark.read.parquet(pairs_path), season)
        spec = M.sports_spec(rows)
        fitted = M.fit(rows, spec, M.logistic(rows, spec, M.DEPLOYED_C, "l2"))
        M.save(fitted, f"{out}/model")
        written["model"] = f"{out}/model"
    return written


REQUESTS = "team_1_name string, team_1_seed int, team_2_name string, team_2_seed int"


def score(spark: SparkSession, out: str, requests_path: str, teams_path: str, season: int = 2025) -> str:
    """Score a CSV of requested pairings (team names and seeds) as neutral
    tournament games with the saved model and the serving state of the
    season; write (pairing, winner) rows. Incomplete requests and unknown
    names are dropped, as the interactive form ignores them."""
    from duelframe.plans import model as M
    from duelframe.plans import scoring as SC
    requests = spark.read.schema(REQUESTS).option("header", True).csv(requests_path)
    teams = read_csv(spark, teams_path, S.TEAMS)
    state = SP.serving_state(season_slice(spark, out, season))
    rows = SC.sports_matchup_rows(requests, teams, state, season)
    path = f"{out}/predictions"
    write_parquet(SC.predict_winner(M.load(f"{out}/model"), rows), path)
    return path


def season_slice(spark: SparkSession, out: str, season: int):
    """The per team-game rows of one season (partition-pruned read)."""
    return slice_rows(spark.read.parquet(f"{out}/team_games"), "Season", season)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for k in INPUTS:
        ap.add_argument("--" + k.replace("_", "-"), required=True, dest=k)
    ap.add_argument("--out", required=True)
    ap.add_argument("--season", type=int, default=2025)
    ap.add_argument("--train", action="store_true")
    ap.add_argument("--rank-scope", choices=("file", "season"), default="file")
    ap.add_argument("--requests", help="CSV of pairings to score (needs --teams and --train)")
    ap.add_argument("--teams", help="team dimension CSV (TeamID, TeamName, ...)")
    a = ap.parse_args(argv)
    from duelframe.session import get_session
    spark = get_session()
    written = run(spark, {k: getattr(a, k) for k in INPUTS}, a.out, a.season, a.train, a.rank_scope)
    if a.requests and a.teams:
        written["predictions"] = score(spark, a.out, a.requests, a.teams, a.season)
    for k, v in written.items():
        print(k, v)


if __name__ == "__main__":
    main()
