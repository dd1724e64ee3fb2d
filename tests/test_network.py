"""The network: gradient against differences, summed by tasks against one array, training."""

import random

import numpy as np
import pytest

from duelframe.operators import network as N


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    out = []
    for _ in range(800):
        a, b = r.uniform(-1, 1), r.uniform(-1, 1)
        out.append((int(a * b > 0), a, b, r.choice([1.0, 2.0])))  # no linear rule
    return out


def test_gradient_by_differences(rows):
    net = N.Network.begin(["a", "b"], 5, 3, 1)
    x, y, w = np.array([r[1:3] for r in rows[:50]]), np.array([float(r[0]) for r in rows[:50]]), np.array([r[3] for r in rows[:50]])
    g, _ = net.gradient(x, y, w)
    theta = net.flat()
    for i in random.Random(0).sample(range(theta.size), 25):
        at = []
        for h in (1e-6, -1e-6):
            moved = theta.copy()
            moved[i] += h
            net.set(moved)
            at.append(net.gradient(x, y, w)[1])
        assert abs((at[0] - at[1]) / 2e-6 - g[i]) < 1e-4


def test_summed_gradient_is_the_whole(spark, rows):
    net = N.Network.begin(["a", "b"], 7, 2, 2)
    df = spark.createDataFrame([(float(r[0]), r[3], r[1], r[2]) for r in rows], "y double, w double, a double, b double").repartition(5)
    g, loss, n = N.summed_gradient(df, net)
    exp, exp_loss = net.gradient(np.array([r[1:3] for r in rows]), np.array([float(r[0]) for r in rows]), np.array([r[3] for r in rows]))
    assert np.allclose(g, exp) and abs(loss - exp_loss) < 1e-8 and n == sum(r[3] for r in rows)


@pytest.mark.parametrize("layers", [1, 5])
def test_training(spark, rows, layers):
    df = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0), (1, None, None, 1.0)], "y int, a double, b double, w double").repartition(4)
    net = N.fit_network(df, "y", ["a", "b"], neurons=16, layers=layers, rate=0.02, epochs=8, batches=4, weight="w")
    assert len(net.losses) == 8 and net.losses[-1] < 0.8 * net.losses[0]
    got = N.score_network(df, net).collect()
    assert len(got) == len(rows) + 2 and all(0 <= r.p1 <= 1 for r in got)
    again = N.fit_network(df, "y", ["a", "b"], neurons=16, layers=layers, rate=0.02, epochs=2, batches=4, weight="w")
    assert np.allclose(again.losses, net.losses[:2])
    assert N.fit_network(df.limit(0), "y", ["a", "b"], epochs=1, batches=2).losses == []
