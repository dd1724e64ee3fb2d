"""Logistic regression on a cluster: sums of squares by task, steps on the driver.

Every iteration is one scan. A task turns its rows into a matrix X (inputs and a constant)
and adds up, for every fit that is still running, the gradient X'(w(mu - y)), the weighted
Gram matrix X' diag(w mu (1 - mu)) X and the loss. The tasks' sums are added by key on the
cluster, so the driver receives (inputs squared) numbers for each fit, never rows, and
solves for the next step. All fits of a study share the scan: a hundred strengths cost one
pass over the data an iteration, and a fit leaves the batch when it has converged.

Without an absolute-value penalty a step is Newton's. With one, the quadratic model at the
present coefficients is minimised by coordinate descent on the Gram matrix (covariance
updates), begun from the coefficients before; zeros are exact.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_STEPS, TOLERANCE = 50, 1e-10
MAX_GRAM = 4_000_000  # numbers of the Gram matrices that a task holds; more fits take more scans


@dataclass(frozen=True)
class Penalty:
    """``strength`` times (``ratio`` |b| + (1 - ratio) / 2 b^2), added to the weighted mean loss;
    the constant is free."""

    strength: float
    ratio: float = 0.0


def inverse_strength(c: float, total_weight: float, ratio: float = 0.0) -> Penalty:
    """The penalty of a fit that minimises ``c`` times the summed loss plus the penalty."""
    return Penalty(1.0 / (c * total_weight), ratio)


@dataclass
class Fit:
    """``coefficients`` in the order of the inputs, the ``constant``, and whether the last
    step was below the tolerance."""

    penalty: Penalty
    coefficients: np.ndarray
    constant: float
    converged: bool
    steps: int


def _design(df: DataFrame, label: str, inputs: Sequence[str], weight: str | None) -> DataFrame:
    """Rows as doubles, a null or NaN input as 0; rows without a label go."""
    cols = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(inputs)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), w.alias("w"), *cols)


def _sums(design: DataFrame, betas: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradients (fits, p), Gram matrices (fits, p, p), losses (fits) and the total weight."""
    fits, p = betas.shape
    shared = design.sparkSession.sparkContext.broadcast(betas)
    upper = np.triu_indices(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        gradient, gram, loss, total = np.zeros((fits, p)), np.zeros((fits, len(upper[0]))), np.zeros(fits), 0.0
        for batch in batches:
            y, w, *xs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            x = np.column_stack([*xs, np.ones(len(y))])
            eta = x @ b.T
            mu = 1.0 / (1.0 + np.exp(-eta))
            total += w.sum()
            loss += w @ (np.logaddexp(0.0, eta) - y[:, None] * eta)
            gradient += ((mu - y[:, None]) * w[:, None]).T @ x
            for i in range(fits):
                gram[i] += (x.T @ (x * (w * mu[:, i] * (1.0 - mu[:, i]))[:, None]))[upper]
        if total:
            values = np.concatenate([gradient.ravel(), gram.ravel(), loss, [total]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    added = design.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(fits * p + fits * len(upper[0]) + fits + 1)
    for i, v in added:
        flat[i] = v
    gradient, packed, loss, total = np.split(flat, np.cumsum([fits * p, fits * len(upper[0]), fits]))
    gram = np.zeros((fits, p, p))
    gram[:, upper[0], upper[1]] = packed.reshape(fits, -1)
    gram[:, upper[1], upper[0]] = packed.reshape(fits, -1)
    return gradient.reshape(fits, p), gram, loss, float(total[0])


def _descend(gram: np.ndarray, gradient: np.ndarray, beta: np.ndarray, l1: np.ndarray, l2: np.ndarray) -> np.ndarray:
    """Minimum of gradient'(b - beta) + (b - beta)' gram (b - beta) / 2 + l1'|b| + l2'b^2 / 2 by
    coordinates; what a changed coordinate does to the others' slopes is one row of ``gram``."""
    b, slope = beta.copy(), gradient.copy()
    for _ in range(10_000):
        largest = 0.0
        for j in range(len(b)):
            h = gram[j, j]
            if h + l2[j] == 0:
                continue
            aim = h * b[j] - slope[j]
            new = np.sign(aim) * max(abs(aim) - l1[j], 0.0) / (h + l2[j])
            if new != b[j]:
                slope += gram[j] * (new - b[j])
                largest = max(largest, abs(new - b[j]))
                b[j] = new
        if largest < TOLERANCE / 10:
            break
    return b


def fit_all(df: DataFrame, label: str, inputs: Sequence[str], penalties: Sequence[Penalty], weight: str | None = None,
            max_steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> list[Fit]:
    """One logistic fit for each penalty, all in the same scans of ``df``, which should be a
    written table. ``label``: 0 or 1, rows without one are left out; a null or NaN input is
    0; ``weight``: of a row, 1 if None. No rows give fits of zeros."""
    design = _design(df, label, inputs, weight)
    p = len(inputs) + 1
    beta = np.zeros((len(penalties), p))
    step, steps, converged = np.ones(len(penalties)), np.zeros(len(penalties), int), np.zeros(len(penalties), bool)
    before: dict[int, tuple[float, np.ndarray]] = {}  # objective and coefficients of the step before
    free = np.append(np.ones(p - 1), 0.0)
    running, together = list(range(len(penalties))), max(1, MAX_GRAM // (p * p))
    while running:
        some, rest = running[:together], running[together:]
        gradient, gram, loss, total = _sums(design, beta[some])
        if not total:
            break
        still = []
        for at, i in enumerate(some):
            pen = penalties[i]
            l1, l2 = pen.strength * pen.ratio * free, pen.strength * (1.0 - pen.ratio) * free
            objective = loss[at] / total + l1 @ abs(beta[i]) + l2 @ beta[i] ** 2 / 2
            if i in before and objective > before[i][0] + 1e-12 * abs(before[i][0]) and step[i] > 1e-6:
                step[i] /= 2  # the last step went too far: half of it
                beta[i] = (beta[i] + before[i][1]) / 2
                still.append(i)
                continue
            before[i] = (objective, beta[i].copy())
            g, h = gradient[at] / total, gram[at] / total
            if pen.ratio > 0:
                aim = _descend(h, g, beta[i], l1, l2)
            else:
                aim = beta[i] - np.linalg.lstsq(h + np.diag(l2), g + l2 * beta[i], rcond=None)[0]
            moved, step[i] = np.abs(aim - beta[i]).max(), 1.0
            beta[i] = aim
            steps[i] += 1
            converged[i] = moved < tolerance
            if not converged[i] and steps[i] < max_steps:
                still.append(i)
        running = still + rest if len(still) >= together else rest + still
    return [Fit(pen, b[:-1], float(b[-1]), bool(c), int(s)) for pen, b, c, s in zip(penalties, beta, converged, steps)]


def probability(fit: Fit, inputs: Sequence[str]) -> Column:
    """Of class 1; a null or NaN input is 0."""
    z = F.lit(fit.constant)
    for c, b in zip(inputs, fit.coefficients.tolist()):
        z = z + F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) * b
    return 1.0 / (1.0 + F.exp(-z))


def brier_scores(df: DataFrame, label: str, inputs: Sequence[str], fits: Sequence[Fit]) -> list[float]:
    """Mean squared error of every fit's probabilities, in one scan; NaN without rows."""
    design = _design(df, label, inputs, None)
    shared = df.sparkSession.sparkContext.broadcast(np.array([[*f.coefficients, f.constant] for f in fits]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        errors, rows = np.zeros(len(b)), 0
        for batch in batches:
            y, _, *xs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            mu = 1.0 / (1.0 + np.exp(-(np.column_stack([*xs, np.ones(len(y))]) @ b.T)))
            errors += ((mu - y[:, None]) ** 2).sum(axis=0)
            rows += len(y)
        if rows:
            values = np.append(errors, rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], names=["i", "v"])

    added = dict(map(tuple, design.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect()))
    rows = added.get(len(fits), 0.0)
    return [added[i] / rows if rows else float("nan") for i in range(len(fits))]
