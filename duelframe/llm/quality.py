"""Supervised subword embeddings: hashed word and character n-gram vectors.

A document is the mean of learned vectors of its features: words, pairs of
neighbouring words, and character (byte) 3-grams and 5-grams, case and white space
included, each kind averaged on its own and the kinds averaged with equal shares.
A softmax layer on that mean gives the class. Vectors and layer are trained by
plain numpy stochastic gradient descent on a bounded sample of labelled rows.

The layer is linear, so a trained model collapses to one number for each hash
bucket; scoring gathers and averages those numbers over the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.llm.words import COEFFICIENTS, LOWER, PIECE, WHITE, mix, text_bytes, word_hashes

BITS = 18
GRAMS = (3, 5)
KINDS = 2 + len(GRAMS)
_SHIFT = np.uint64(64 - BITS)
_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_NONE = np.zeros(0, dtype=np.int64)


def _word_buckets(words: np.ndarray) -> np.ndarray:
    return (mix(words + COEFFICIENTS[10]) >> _SHIFT).astype(np.int32)


def _pair_buckets(words: np.ndarray) -> np.ndarray:
    # by difference, so that a word repeated at once is one feature whatever the word
    return (mix((words[1:] - words[:-1]) + COEFFICIENTS[11]) >> _SHIFT).astype(np.int32)


def _gram_buckets(raw: np.ndarray, n: int) -> np.ndarray:
    total = _BYTE[raw[:len(raw) - n + 1]] * COEFFICIENTS[20 + n]
    for j in range(1, n):
        total += _BYTE[raw[j:len(raw) - n + 1 + j]] * COEFFICIENTS[20 + n + j]
    return ((total ^ (total >> np.uint64(29))) * COEFFICIENTS[12] >> _SHIFT).astype(np.int32)


def _features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares, which sum to 1; none without text."""
    data, offsets = text_bytes(pa.array([text], pa.string()))
    words, _ = word_hashes(data, offsets, WHITE, LOWER)
    kinds = [_word_buckets(words), _pair_buckets(words) if len(words) > 1 else _NONE]
    kinds += [_gram_buckets(data, n) if len(data) >= n else _NONE for n in GRAMS]
    kinds = [k for k in kinds if len(k)]
    if not kinds:
        return _NONE, np.zeros(0, np.float32)
    index = np.concatenate(kinds)
    share = np.concatenate([np.full(len(k), 1.0 / (len(k) * len(kinds))) for k in kinds])
    found, where = np.unique(index, return_inverse=True)
    return found, np.bincount(where, weights=share).astype(np.float32)


@dataclass
class QualityModel:
    """``weights``: of every bucket its vector's difference of the two class scores; ``bias``."""

    weights: np.ndarray
    bias: float

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Log odds of class 1 of each text; ``bias`` for a text without features."""
        data, offsets = text_bytes(texts)
        m = len(offsets) - 1
        words, counts = word_hashes(data, offsets, WHITE, LOWER)
        ends = np.cumsum(counts)
        total, kinds = np.zeros(m), np.zeros(m)

        def add(sums: np.ndarray, number: np.ndarray) -> None:
            some = number > 0
            total[some] += sums[some] / number[some]
            kinds[some] += 1

        def sums_between(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
            run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
            return run[np.maximum(begin, end)] - run[begin]

        if len(words):
            add(sums_between(self.weights[_word_buckets(words)], ends - counts, ends), counts)
            pairs = self.weights[_pair_buckets(words)] if len(words) > 1 else np.zeros(0)
            begin = np.minimum(ends - counts, len(pairs))
            add(sums_between(pairs, begin, np.maximum(begin, ends - 1)), np.maximum(counts - 1, 0))
        length = np.diff(offsets)
        for n in GRAMS:
            sums = np.zeros(m)
            for a in range(0, len(data), PIECE):
                b = min(a + PIECE, len(data))
                raw = data[a:min(b + n - 1, len(data))]
                if len(raw) < n:
                    continue
                values = self.weights[_gram_buckets(raw, n)]
                lo, hi = np.searchsorted(offsets, a, "right") - 1, np.searchsorted(offsets, b, "left")
                # starts of this piece from which n bytes lie inside the text
                begin = np.clip(offsets[lo:hi] - a, 0, len(values))
                end = np.clip(offsets[lo + 1:hi + 1] - n + 1 - a, 0, min(len(values), b - a))
                sums[lo:hi] += sums_between(values, begin, np.maximum(begin, end))
            add(sums, np.maximum(length - n + 1, 0))
        return self.bias + np.divide(total, kinds, out=np.zeros(m), where=kinds > 0)


def train(texts: list[str | None], labels: list[int], prior: float, dim: int = 8, epochs: int = 12,
          rate: float = 0.6, seed: int = 7) -> QualityModel:
    """Fit by stochastic gradient descent, one document a step, the rate falling to zero.

    ``prior`` is the share of class 1 among all labelled rows; the sample may be
    balanced otherwise. With fewer than two classes the score is the prior.
    """
    odds = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (0.0 if prior != prior else 8.0 * (2 * prior - 1))
    y = np.asarray(labels, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return QualityModel(np.zeros(1 << BITS, np.float32), odds)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / dim, 1.0 / dim, (1 << BITS, dim)).astype(np.float32)
    layer, bias = np.zeros((dim, 2), np.float32), np.zeros(2, np.float32)
    rows = [_features(t) for t in texts]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            index, share = rows[i]
            now = np.float32(rate * (1 - done / steps))
            done += 1
            if not len(index):
                continue
            mean = share @ vectors[index]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            slope = p / p.sum()
            slope[y[i]] -= 1
            back = layer @ slope
            layer -= now * np.outer(mean, slope)
            bias -= now * slope
            # a bucket's share is small: scaled up so that vectors and layer learn alike
            vectors[index] -= (now * len(index) ** 0.5) * np.outer(share, back)
    sampled = float(np.log(y.mean() / (1 - y.mean())))
    return QualityModel((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32),
                        float(bias[1] - bias[0]) + odds - sampled)


def held_out(key: Column) -> Column:
    """Rows whose crc32 of the key as text leaves 1 when divided by 3; a null key is the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit_quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
                label: str = "quality", sample: int = 4000, sample_bytes: int = 32_768) -> QualityModel:
    """Train on at most ``sample`` labelled rows (half of either class as far as there are
    enough, chosen by the md5 of the key) of at most ``sample_bytes`` bytes each, so at
    most their product comes to the driver. Held-out rows, null keys, null labels and
    keys with contradicting labels are never learned from.
    """
    known = (labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col(key)))
             .groupBy(F.col(key).alias("_id")).agg(F.min(label).alias("_y"), F.max(label).alias("_y2"))
             .where("_y = _y2"))
    texts = (docs.where(F.octet_length(text) <= sample_bytes).select(F.col(key).alias("_id"), F.col(text).alias("_t")))
    n = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half, rows = sample // 2, []
    for y in (0, 1):
        chosen = known.where(F.col("_y") == y).orderBy(F.md5(F.col("_id").cast("string").cast("binary")), "_id").limit(half)
        rows += texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.max("_t").alias("_t")).select(
            "_id", F.lit(y).alias("_y"), "_t").collect()  # ``half`` ids at most
    rows.sort(key=lambda r: (r["_id"], r["_y"]))
    total = sum(n.values())
    return train([r["_t"] for r in rows], [r["_y"] for r in rows], n.get(1, 0) / total if total else float("nan"))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out`` (double, 0 to 1; higher: class 1 likelier).

    Scores depend on the text alone. Null and empty texts get the model's bias. A
    column of the name ``out`` in ``docs`` is replaced; an empty table gives no rows.
    """
    table = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))  # a fixed number of buckets
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType())])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = table.value
        model = QualityModel(weights, bias)
        for batch in batches:
            z = np.clip(model.margins(batch.column(names.index(text))), -500, 500)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-z)))],
                                             names=[*batch.schema.names, out])

    return docs.select(*names).mapInArrow(run, schema)
