"""A feed-forward network for two classes, trained by synchronous mini-batches.

The rows are dealt once into batches by a hash and written, a folder for each batch, so a
step reads its rows and no others. In a step every task runs its part of the batch forward
and back and adds up the gradients; the tasks' sums are added by position on the cluster,
and the driver, which holds the weights and Adam's two moments (arrays of a fixed size,
whatever the rows), makes the step. Epochs go through the batches in seeded orders.

Hidden layers are rectified, the output is a sigmoid, the loss the weighted mean
cross-entropy.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.operators.written import written

BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-7


@dataclass
class Network:
    """``weights[i]`` and ``biases[i]`` lead from layer i to layer i + 1."""

    inputs: Sequence[str]
    weights: list[np.ndarray]
    biases: list[np.ndarray]
    losses: list[float] = field(default_factory=list)  # mean of each epoch, before its steps

    @classmethod
    def begin(cls, inputs: Sequence[str], neurons: int, layers: int, seed: int) -> "Network":
        sizes = [len(inputs), *[neurons] * layers, 1]
        rng = np.random.default_rng(seed)
        return cls(list(inputs), [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes, sizes[1:])],
                   [np.zeros(b) for b in sizes[1:]])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (*self.weights, *self.biases)])

    def set(self, flat: np.ndarray) -> None:
        at = 0
        for group in (self.weights, self.biases):
            for i, x in enumerate(group):
                group[i] = flat[at:at + x.size].reshape(x.shape)
                at += x.size

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers; the last is before the sigmoid."""
        out = [x]
        for i, (w, b) in enumerate(zip(self.weights, self.biases)):
            z = out[-1] @ w + b
            out.append(np.maximum(z, 0) if i + 1 < len(self.weights) else z)
        return out

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        """Sum over the rows of the weighted loss's gradient, and of the loss."""
        out = self.forward(x)
        z = out[-1][:, 0]
        loss = float(w @ (np.logaddexp(0, z) - y * z))
        back = ((1 / (1 + np.exp(-z)) - y) * w)[:, None]
        weights, biases = [], []
        for i in range(len(self.weights) - 1, -1, -1):
            weights.append(out[i].T @ back)
            biases.append(back.sum(axis=0))
            if i:
                back = (back @ self.weights[i].T) * (out[i] > 0)
        return np.concatenate([g.ravel() for g in (*reversed(weights), *reversed(biases))]), loss


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, w, *xs = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return np.column_stack(xs), y, w


def summed_gradient(rows: DataFrame, network: Network) -> tuple[np.ndarray, float, float]:
    """Gradient, loss and weight summed over ``rows``: ``y``, ``w`` and the inputs, as doubles."""
    shared = rows.sparkSession.sparkContext.broadcast(network)
    size = network.flat().size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, total = shared.value, np.zeros(size + 2)
        for batch in batches:
            if batch.num_rows:
                x, y, w = _arrays(batch)
                g, loss = net.gradient(x, y, w)
                total += np.concatenate([g, [loss, w.sum()]])
        if total[-1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(total)], names=["i", "v"])

    out = np.zeros(size + 2)
    for i, v in rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        out[i] = v
    shared.unpersist()
    return out[:-2], out[-2], out[-1]


def fit_network(df: DataFrame, label: str, inputs: Sequence[str], neurons: int = 32, layers: int = 2, rate: float = 0.001,
                epochs: int = 10, batches: int = 20, weight: str | None = None, seed: int = 42) -> Network:
    """``batches``: steps to an epoch, each on about as many rows. A null or NaN input is 0;
    rows without a label are left out; no rows leave the network as it began."""
    if not 1 <= layers or not inputs:
        raise ValueError("a network has inputs and a hidden layer")
    cols = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(inputs)]
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), w.alias("w"), *cols)
    batch = F.pmod(F.xxhash64(F.lit(seed), *rows.columns), F.lit(batches)).cast("int")
    dealt = written(rows.withColumn("_batch", batch), "batches", "_batch")
    net = Network.begin(inputs, neurons, layers, seed)
    theta, rng = net.flat(), np.random.default_rng(seed)
    first, second, step = np.zeros(theta.size), np.zeros(theta.size), 0
    for _ in range(epochs):
        loss = total = 0.0
        for k in rng.permutation(batches).tolist():
            g, batch_loss, n = summed_gradient(dealt.where(F.col("_batch") == k).drop("_batch"), net)
            if not n:
                continue
            loss, total, step = loss + batch_loss, total + n, step + 1
            g = g / n
            first, second = BETA1 * first + (1 - BETA1) * g, BETA2 * second + (1 - BETA2) * g * g
            theta = theta - rate * (first / (1 - BETA1 ** step)) / (np.sqrt(second / (1 - BETA2 ** step)) + EPSILON)
            net.set(theta)
        if total:
            net.losses.append(loss / total)
    return net


def score_network(df: DataFrame, network: Network, out: str = "p1") -> DataFrame:
    """``df`` with the probability of class 1."""
    shared = df.sparkSession.sparkContext.broadcast(network)
    cols = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_x{i}") for i, c in enumerate(network.inputs)]
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    n = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[n:]])
            p = 1 / (1 + np.exp(-shared.value.forward(x)[-1][:, 0]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(p)], names=schema.names)

    return df.select(*df.columns, *cols).mapInArrow(run, schema)
