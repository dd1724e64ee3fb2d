"""Model building on the paired feature rows with Spark ML.

- Categorical columns: ``StringIndexer(handleInvalid="keep")`` +
  ``OneHotEncoder(dropLast=True)``: every category seen in training gets a
  slot, an unseen one scores as all zeros. Inputs are cast to string
  first so training and scoring encode numbers the same way.
- Scaling uses the *population* standard deviation (divide by n), fitted
  with one distributed aggregation; Spark's ``StandardScaler`` would use
  the sample deviation. A zero deviation scales by 1.
- Logistic regression with an inverse strength ``C`` minimises
  ``C * sum(loss) + penalty``; Spark minimises ``mean(loss) + regParam *
  penalty``, so ``regParam = 1 / (C * n)`` with ``n`` the (weighted)
  training size and ``standardization=False``.
- Search: seeded random draws from the given ranges (log-uniform where
  asked). All trials of a logistic study are fitted in the same scans
  (``operators.logistic``); forests and networks are a distributed fit each,
  on a small driver thread pool. The result is a DataFrame of (trial, params,
  score).
"""

from __future__ import annotations

import json
import math
import random
import re
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.forest import fit_forest, score_forest
from duelframe.operators.logistic import brier_scores, fit_all, inverse_strength, probability
from duelframe.operators.network import fit_network, score_network
from duelframe.operators.stats import mean_std
from duelframe.operators.written import written

DEPLOYED_C = 0.0216474637891819


@dataclass
class ModelSpec:
    label: str
    onehot: Sequence[str] = ()
    flags: Sequence[str] = ()
    scale: Sequence[str] = ()
    ratios: Sequence[str] = ()
    weight: str | None = None
    extra: dict = field(default_factory=dict)


def regex_columns(df: DataFrame, pattern: str) -> list[str]:
    """Columns whose name matches ``pattern`` from the start (``re.match``)."""
    rx = re.compile(pattern)
    return [c for c in df.columns if rx.match(c)]


def population_scaler(train: DataFrame, cols: Sequence[str], suffix: str = "__z") -> SQLTransformer:
    """Fit mean / population std on ``train`` (one aggregation; one row per
    column comes back) and return the scaling step as a SQL transformer."""
    if not cols:
        return SQLTransformer(statement="SELECT * FROM __THIS__")
    stats = {r["column"]: (r["mean"], r["std"]) for r in mean_std(train, cols).collect()}
    parts = []
    for c in cols:
        m, s = stats[c]
        m = 0.0 if m is None else m
        s = 1.0 if not s else s
        parts.append(f"(CAST(`{c}` AS DOUBLE) - {m!r}) / {s!r} AS `{c}{suffix}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")


def feature_stages(train: DataFrame, spec: ModelSpec) -> list:
    casts = ", ".join(f"CAST(`{c}` AS STRING) AS `{c}__s`" for c in spec.onehot)
    stages: list = []
    if spec.onehot:
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
        stages.append(StringIndexer(inputCols=[f"{c}__s" for c in spec.onehot],
                                    outputCols=[f"{c}__i" for c in spec.onehot],
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in spec.onehot],
                                    outputCols=[f"{c}__v" for c in spec.onehot], dropLast=True))
    stages.append(population_scaler(train, list(spec.scale)))
    inputs = ([f"{c}__v" for c in spec.onehot] + list(spec.flags)
              + [f"{c}__z" for c in spec.scale] + list(spec.ratios))
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"))
    return stages


def _n(train: DataFrame, spec: ModelSpec) -> float:
    if spec.weight:
        return float(train.agg(F.sum(spec.weight)).first()[0])
    return float(train.count())


# Convergence tolerance of the reference's logistic regression (its
# library default); Spark's own default of 1e-6 only adds iterations.
LOGISTIC_TOL = 1e-4


def logistic(train: DataFrame, spec: ModelSpec, C: float = DEPLOYED_C, penalty: str = "l2",
             l1_ratio: float = 0.0, max_iter: int = 1000, tol: float = LOGISTIC_TOL) -> LogisticRegression:
    alpha = {"l2": 0.0, "l1": 1.0, "elasticnet": l1_ratio}[penalty]
    lr = LogisticRegression(labelCol=spec.label, featuresCol="features", maxIter=max_iter, tol=tol,
                            regParam=1.0 / (C * _n(train, spec)), elasticNetParam=alpha,
                            standardization=False, family="binomial")
    if spec.weight:
        lr.setWeightCol(spec.weight)
    return lr


def forest(spec: ModelSpec, n_trees: int = 100, min_split: int = 2, seed: int = 42,
           max_depth: int = 30) -> RandomForestClassifier:
    """``min_split`` rows needed to split a node ~ at least ``min_split//2``
    rows per child (``minInstancesPerNode``). ``max_depth``: 30 is the deepest
    that Spark grows. ``operators.forest`` has neither limit; this one is for pipelines
    that are saved."""
    rf = RandomForestClassifier(labelCol=spec.label, featuresCol="features", numTrees=n_trees,
                                minInstancesPerNode=max(1, min_split // 2), maxDepth=max_depth,
                                seed=seed)
    if spec.weight:
        rf.setWeightCol(spec.weight)
    return rf


def fit(train: DataFrame, spec: ModelSpec, estimator) -> PipelineModel:
    return Pipeline(stages=feature_stages(train, spec) + [estimator]).fit(train)


def prob1(col: str = "probability") -> F.Column:
    return vector_to_array(F.col(col))[1]


def scored(model: Transformer, df: DataFrame, keep: Sequence[str], spec: ModelSpec) -> DataFrame:
    out = model.transform(df)
    return out.select(*keep, F.col(spec.label).alias("label"), prob1().alias("p1"),
                      F.col("prediction").cast("int").alias("prediction"))


def brier(df: DataFrame, label: str = "label", prob: str = "p1") -> float:
    return float(df.agg(F.avg(F.pow(F.col(label).cast("double") - F.col(prob), 2))).first()[0])


def soft_vote(models: Sequence[Transformer | F.Column], df: DataFrame, keep: Sequence[str], spec: ModelSpec,
              weights: Sequence[float] | None = None) -> DataFrame:
    """Weighted mean of the class-1 probabilities of several fitted pipelines, or of
    columns that give one; prediction = mean > 0.5 (ties go to class 0). The models
    are applied one after the other to the same rows (each keeps only its
    probability), so scoring is one pass with no join."""
    weights = list(weights or [1.0] * len(models))
    cur = df
    for i, m in enumerate(models):
        cur = (cur.withColumn(f"_p{i}", m) if isinstance(m, F.Column)
               else m.transform(cur).select(*cur.columns, prob1().alias(f"_p{i}")))
    p = sum(F.col(f"_p{i}") * w for i, w in enumerate(weights)) / sum(weights)
    return cur.select(*keep, F.col(spec.label).alias("label"), p.alias("p1"),
                      (p > 0.5).cast("int").alias("prediction"))


def fixed_logistic(weights: dict[str, float], intercept: float) -> F.Column:
    """Probability of a logistic model with given coefficients."""
    z = F.lit(intercept)
    for c, w in weights.items():
        z = z + F.col(c) * w
    return 1 / (1 + F.exp(-z))


# Search spaces: (name, low, high, kind) with kind in {"log", "uniform", "int"}.
# The ranges of the six studies.
SPACES = {
    "logistic_l2": [("C", 1e-5, 1e2, "log")],
    "logistic_l1": [("C", 1e-5, 1e2, "log")],
    "logistic_elasticnet": [("C", 1e-5, 1e2, "log"), ("l1_ratio", 0.0, 1.0, "uniform")],
    "forest": [("n_trees", 10, 500, "int"), ("min_split", 2, 20, "int")],
    "ensemble": [("C", 1e-4, 1.0, "log"), ("n_trees", 75, 500, "int"), ("min_split", 2, 10, "int")],
    "network": [("neurons", 16, 256, "int"), ("learning_rate", 1e-5, 1e-2, "uniform"),
                ("layers", 1, 5, "int")],
}


def draw(space, rng: random.Random) -> dict:
    out = {}
    for name, lo, hi, kind in space:
        if kind == "log":
            out[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
        elif kind == "int":
            out[name] = rng.randint(lo, hi)
        else:
            out[name] = rng.uniform(lo, hi)
    return out


def search(train: DataFrame, test: DataFrame, spec: ModelSpec, family: str, n_trials: int = 100,
           seed: int = 42, parallelism: int = 2, max_iter: int = 1000) -> DataFrame:
    """Evaluate ``n_trials`` seeded draws by Brier score on ``test``; one
    result row per trial, best first. ``ensemble`` is the soft vote of a forest and an
    L2 logistic regression, both with the spec's sample weights."""
    rng = random.Random(seed)
    trials = [draw(SPACES[family], rng) for _ in range(n_trials)]
    prep = Pipeline(stages=feature_stages(train, spec)).fit(train)
    tr, te = (written(prep.transform(d).select("features", spec.label, *([spec.weight] if spec.weight else [])), "rows")
              for d in (train, test))
    first = tr.select("features").first()
    n_features = len(first[0]) if first else 0

    inputs = [f"f{i}" for i in range(n_features)]

    def run(params: dict) -> float:
        if family == "network":
            net = fit_network(wide(tr, spec, inputs), spec.label, inputs, params["neurons"], params["layers"], params["learning_rate"],
                              min(max_iter, NETWORK_EPOCHS), weight=spec.weight)
            return brier(score_network(wide(te, spec, inputs), net), spec.label)
        trees = fit_forest(wide(tr, spec, inputs), spec.label, inputs, params["n_trees"], params["min_split"], weight=spec.weight)
        scored_rows = score_forest(wide(te, spec, inputs), trees)
        if family == "forest":
            return brier(scored_rows, spec.label)
        fitted, = fit_all(wide(tr, spec, inputs), spec.label, inputs, [inverse_strength(params["C"], _n(train, spec))], spec.weight,
                          min(max_iter, 50), 1e-6)
        return brier(soft_vote([F.col("p1"), probability(fitted, inputs)], scored_rows, [], spec))

    if family.startswith("logistic"):
        scores = logistic_study(wide(tr, spec, inputs), wide(te, spec, inputs), spec, family, trials, inputs, max_iter)
    else:
        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            scores = list(pool.map(run, trials))
    rows = [(i, family, json.dumps(p, sort_keys=True), b) for i, (p, b) in enumerate(zip(trials, scores))]
    return (train.sparkSession.createDataFrame(rows, "trial int, family string, params string, brier double")
            .orderBy("brier", "trial"))


NETWORK_EPOCHS = 10


def wide(df: DataFrame, spec: ModelSpec, inputs: Sequence[str]) -> DataFrame:
    """The entries of ``features`` as columns ``inputs``, with the label and the weight."""
    values = vector_to_array("features")
    return df.select(spec.label, *([spec.weight] if spec.weight else []), *[values[i].alias(c) for i, c in enumerate(inputs)])


def logistic_study(train: DataFrame, test: DataFrame, spec: ModelSpec, family: str, trials: Sequence[dict],
                   inputs: Sequence[str], max_iter: int = 1000) -> list[float]:
    """Brier score on ``test`` of every trial, all fitted together; both tables are ``wide``."""
    total = _n(train, spec)
    ratio = {"logistic_l2": lambda t: 0.0, "logistic_l1": lambda t: 1.0, "logistic_elasticnet": lambda t: t["l1_ratio"]}[family]
    fits = fit_all(train, spec.label, inputs, [inverse_strength(t["C"], total, ratio(t)) for t in trials], spec.weight,
                   min(max_iter, 50), 1e-6)
    return brier_scores(test, spec.label, inputs, fits)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------- specs

def contest_spec(df: DataFrame) -> ModelSpec:
    """Paired contest features (``game_features``): location and league one-hot, mean
    features standardised, win shares as is. Team ids are left out: there is one for
    every user, and an indexer would bring all of them to the driver."""
    return ModelSpec(label="win_A", onehot=["loc_A", "league"],
                     scale=regex_columns(df, r".*mean.*"),
                     ratios=regex_columns(df, r"win_pct_.*"))


# Input blocks of the sports model.
SPORTS_ONEHOT = ["GameLocation_A", "TeamConf_A", "TeamConf_B", "CoachName_A", "CoachName_B",
                 "TeamID_A", "TeamID_B", "Season", "NCAATourneySeed_A", "NCAATourneySeed_B",
                 "ActiveTourneyWins_School_A", "ActiveTourneyWins_School_B",
                 "ActiveTourneyWins_Coach_A", "ActiveTourneyWins_Coach_B", "ActiveAPRank_A",
                 "ActivePOMRank_A", "ActiveNETRank_A", "SeasonBestAPRank_A", "SeasonBestPOMRank_A",
                 "ActiveAPRank_B", "ActivePOMRank_B", "ActiveNETRank_B", "SeasonBestAPRank_B",
                 "SeasonBestPOMRank_B"]
SPORTS_FLAGS = ["RegSeasonFlag_A", "ConfTourneyFlag_A", "NCAATourneyFlag_A"]
SPORTS_RATIO_STEMS = ["RollingWinPct_Overall", "RollingWinPct_Last5", "RollingP5WinPct_Overall",
                      "RollingNP5WinPct_Overall", "FreeThrowPct_Overall", "FreeThrowPct_Last5",
                      "OppFreeThrowPct_Overall", "OppFreeThrowPct_Last5", "FieldGoalPct_Overall",
                      "FieldGoalPct_Last5", "OppFieldGoalPct_Overall", "OppFieldGoalPct_Last5",
                      "ThreePtPct_Overall", "ThreePtPct_Last5", "OppThreePtPct_Overall",
                      "OppThreePtPct_Last5"]


def sports_spec(df: DataFrame, weight: str | None = None) -> ModelSpec:
    return ModelSpec(label="WinFlag_A", onehot=SPORTS_ONEHOT, flags=SPORTS_FLAGS,
                     scale=regex_columns(df, r".*Avg.*"),
                     ratios=[f"{s}_{k}" for k in ("A", "B") for s in SPORTS_RATIO_STEMS],
                     weight=weight)


def sports_training_rows(pairs: DataFrame, latest_season: int) -> DataFrame:
    """Tournament games of earlier seasons plus every game of the latest
    season, with sample weight 2 on the latest season."""
    rows = pairs.where((F.col("NCAATourneyFlag_A") == 1) | (F.col("Season") == latest_season))
    return rows.withColumn("train_weight", F.when(F.col("Season") == latest_season, 2.0)
                           .otherwise(1.0))
