"""Importance resampling of documents towards a target collection.

The texts of the documents and of the target are cut into words by an untrained regular
expression of the tokenizers library, which gives words with their offsets. Every run of
one to ``longest`` words is a feature; its bucket is the CRC-32 of its bytes modulo the
number of buckets. A bucket's gain is the logarithm of how much more often the target
holds it; a document's weight is the sum over its features, and Gumbel noise from a hash
of its key makes the highest scores a weighted draw without replacement.

Texts are cut once: the buckets of every document are written, the histogram and the
weights are read from there. Beyond one row a document, only the histogram (one number a
bucket) passes the driver.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, pre_tokenizers

from duelframe.llm.tables import running_totals, saved

WORD, GAP = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 15  # characters split at once, more to the end of a word
ROWS, FLUSH = 100, 1 << 20  # texts taken out of a batch at once; features to a batch


class FeatureBuckets:
    """Words and feature buckets of texts."""

    def __init__(self, longest: int, buckets: int):
        self.split = pre_tokenizers.Split(Regex(WORD), behavior="removed", invert=True)
        self.longest, self.buckets = longest, buckets

    def words(self, text: str) -> list[str]:
        lowered = text.encode().lower().decode()  # of bytes: A-Z alone
        found: list[str] = []
        at = 0
        while at < len(lowered):
            gap = GAP.search(lowered, at + PIECE)  # a piece ends between words
            end = gap.start() if gap else len(lowered)
            found += [w for w, _ in self.split.pre_tokenize_str(lowered[at:end])]
            at = end
        return found

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of every feature."""
        raw = [w.encode() for w in self.words(text)]
        if not raw:
            return 0, np.zeros(0, np.int32)
        line = memoryview(b" ".join(raw))
        ends = np.cumsum([len(w) + 1 for w in raw]) - 1
        begins = np.append(0, ends[:-1] + 1)
        crc, hashes = zlib.crc32, []
        for run in range(1, min(self.longest, len(raw)) + 1):
            hashes += [crc(line[a:b]) for a, b in zip(begins.tolist(), ends[run - 1:].tolist())]
        return len(raw), (np.array(hashes, np.int64) % self.buckets).astype(np.int32)


def feature_buckets(docs: DataFrame, key: str, text: str, longest: int, buckets: int) -> DataFrame:
    """``_key``, ``_words``, ``_buckets`` of every row; a null text has neither."""
    schema = T.StructType([T.StructField("_key", docs.schema[key].dataType), T.StructField("_words", T.LongType()),
                           T.StructField("_buckets", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = FeatureBuckets(longest, buckets)
        for batch in batches:
            at, counts, lists, size = 0, [], [], 0

            def flush(to: int) -> pa.RecordBatch:
                offsets = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int32)
                values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists)))
                return pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(counts, pa.int64()), values],
                                                  names=schema.names)

            for row in range(0, batch.num_rows, ROWS):
                for i, t in enumerate(batch.column(1).slice(row, ROWS).to_pylist(), row):
                    n, found = maker.of(t or "")
                    counts.append(n)
                    lists.append(found)
                    size += len(found)
                    if size >= FLUSH:
                        yield flush(i + 1)
                        at, counts, lists, size = i + 1, [], [], 0
            if lists:
                yield flush(batch.num_rows)

    return docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def histogram(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket: counted on the cluster, one row a bucket to the driver."""
    counts = np.zeros(buckets, np.int64)
    for b, n in features.select(F.explode("_buckets").alias("b")).groupBy("b").count().collect():
        counts[b] = n
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), the add-one estimates' ratio."""
    b, s_all, t_all = len(own), float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(own.tolist(), target.tolist())], np.int64)


def _weighted(features: DataFrame, gain: np.ndarray) -> DataFrame:
    shared = features.sparkSession.sparkContext.broadcast(gain)
    schema = T.StructType([features.schema["_key"], *[T.StructField(n, T.LongType())
                                                      for n in ("_words", "_n_features", "_weight")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            total = np.append(0, np.cumsum(shared.value[lists.values.to_numpy()[offsets[0]:offsets[-1]]]))
            at = offsets - offsets[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)),
                                              pa.array(np.diff(total[at]))], names=schema.names)

    return features.mapInArrow(run, schema)


def resample_to_target(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text",
                       target_text: str = "text", longest: int = 1, buckets: int = 10_000, min_words: int = 20,
                       percent: int = 10, seed: int = 2024) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Of the N documents with at least ``min_words`` words the floor(percent N / 100) of the
    highest scores are drawn and ranked from 1; all others have a null rank. Ties go to
    the smaller key, null keys last; rows that repeat a key and score are ranked one after
    another in any order. A null or blank text has no words and weight 0; the noise of a
    null key is that of the empty string. An empty table gives no rows; with an empty
    target all its counts are 0. Long texts are split whole, piece by piece. Other columns
    are left out, whatever their names. ``buckets`` bounds what the driver holds.
    """
    features, _ = saved(feature_buckets(docs, key, text, longest, buckets), "features")
    other = feature_buckets(target, target_text, target_text, longest, buckets)
    gain = gains(histogram(features, buckets), histogram(other, buckets))
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256),
                                1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored, _ = saved(_weighted(features, gain).select(
        "_key", "_words", "_n_features", "_weight", (F.col("_words") >= min_words).alias("_can"),
        (F.col("_weight") + F.floor(-1000.0 * F.log(-F.log(noise)))).alias("_score")), "scored")
    quota = scored.where("_can").count() * percent // 100
    placed = running_totals(scored.withColumn("_row", F.monotonically_increasing_id()),  # the read of written files
                            [(~F.col("_can")).cast("int"), -F.col("_score"), F.col("_key").isNull(), F.col("_key"), F.col("_row")],
                            {"_place": F.col("_can")}, ["_key", "_words", "_n_features", "_weight", "_score", "_can"])
    rank = F.when(F.col("_can") & (F.col("_place") <= quota), F.col("_place"))
    return placed.select(F.col("_key").alias(key), F.col("_words").alias("n_words"), F.col("_n_features").alias("n_features"),
                         F.col("_weight").alias("weight"), F.col("_score").alias("score"), rank.alias("rank"))
