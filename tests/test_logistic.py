"""Logistic fits: optimality conditions, agreement with separate fits, odd rows."""

import math
import random

import numpy as np
import pytest

from duelframe.operators import logistic as L

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    r = random.Random(1)
    out = []
    for i in range(600):
        a, b, c = r.gauss(0, 1), r.gauss(0, 3), r.choice([0.0, 1.0])
        p = 1 / (1 + math.exp(-(0.4 + 1.2 * a - 0.3 * b)))
        out.append((int(r.random() < p), a, None if i % 50 == 0 else b, c, r.choice([1.0, 2.0])))
    return out


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 1.0)], "y int, a double, b double, c double, w double").repartition(4)


def slopes(rows, fit, weighted):
    x = np.array([[a, b or 0.0, c, 1.0] for _, a, b, c, _ in rows])
    w = np.array([r[4] if weighted else 1.0 for r in rows])
    y = np.array([r[0] for r in rows])
    mu = 1 / (1 + np.exp(-(x @ np.append(fit.coefficients, fit.constant))))
    return x.T @ (w * (mu - y)) / w.sum()


PENALTIES = [L.Penalty(s, r) for s in (1.0, 0.1, 0.01, 1e-4) for r in (0.0, 0.3, 1.0)]


@pytest.mark.parametrize("weight", [None, "w"])
def test_optimality(table, rows, weight):
    fits = L.fit_all(table, "y", INPUTS, PENALTIES, weight)
    for f in fits:
        assert f.converged
        g = slopes(rows, f, weight)
        s, r = f.penalty.strength, f.penalty.ratio
        assert abs(g[-1]) < 1e-8
        for j, b in enumerate(f.coefficients):
            if r > 0 and b == 0:
                assert abs(g[j]) <= s * r + 1e-8
            else:
                assert abs(g[j] + s * r * np.sign(b) + s * (1 - r) * b) < 1e-8
    assert any(f.coefficients[2] == 0 for f in fits if f.penalty.ratio == 1.0)


def test_together_as_apart(table, monkeypatch):
    together = L.fit_all(table, "y", INPUTS, PENALTIES)
    monkeypatch.setattr(L, "MAX_GRAM", 48)  # three fits to a scan
    for f, g in zip(together, L.fit_all(table, "y", INPUTS, PENALTIES)):
        assert np.allclose([*f.coefficients, f.constant], [*g.coefficients, g.constant], atol=1e-9)
    one, = L.fit_all(table, "y", INPUTS, PENALTIES[4:5])
    assert np.allclose(one.coefficients, together[4].coefficients, atol=1e-9)
    scores = L.brier_scores(table, "y", INPUTS, together)
    for f, s in zip(together[:3], scores):
        exp = table.where("y is not null").select(L.probability(f, INPUTS).alias("p"), "y").collect()
        assert math.isclose(s, sum((r.p - r.y) ** 2 for r in exp) / len(exp), rel_tol=1e-9)


def test_separable_constant_and_empty(spark, table):
    rows = spark.createDataFrame([(int(i > 5), float(i), 1.0) for i in range(12)], "y int, a double, b double")
    fit, = L.fit_all(rows, "y", ["a", "b"], [L.Penalty(1e-3)])
    assert fit.converged and fit.coefficients[0] > 0.5
    empty, = L.fit_all(table.limit(0), "y", INPUTS, [L.Penalty(1.0)])
    assert not empty.coefficients.any() and math.isnan(L.brier_scores(table.limit(0), "y", INPUTS, [empty])[0])


def test_agrees_with_spark_ml(table, rows):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    data = VectorAssembler(inputCols=INPUTS, outputCol="x").transform(table.dropna(subset=["y"]).fillna(0.0))
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=0.05, elasticNetParam=0.4, standardization=False, tol=1e-10,
                            maxIter=500).fit(data)
    own, = L.fit_all(table, "y", INPUTS, [L.Penalty(0.05, 0.4)])
    assert np.allclose(own.coefficients, lr.coefficients.toArray(), atol=1e-4) and abs(own.constant - lr.intercept) < 1e-4
