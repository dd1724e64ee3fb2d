"""Each row of a table with the row after it in a global order, in one shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = 2_000  # rows handed on at once
BATCH_CHARS = 4_000_000


def _part(key: Column, bounds: list) -> Column:
    """Number of bounds (descending) above the key, by binary search; null comes last."""
    if not bounds:
        return F.lit(0)
    edges = F.array(*[F.lit(b) for b in bounds])
    found = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(key < F.get(edges, ((s["lo"] + s["hi"]) / 2).cast("int")),
                   F.struct((((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).cast("int").alias("hi")))),
        lambda s: s["lo"])
    return F.when(key.isNull(), F.lit(len(bounds))).otherwise(found)


def map_with_next(docs: DataFrame, key: str, text: str,
                  fn: Callable[[list, list[str], list[str]], pa.RecordBatch], schema: T.StructType) -> DataFrame:
    """``fn(keys, texts, next texts)`` over all rows; the next row is the one with the
    next lower integer key (null last, ties by the hash of the text), and after the last
    row comes the first.

    The rows are range-dealt by bounds computed beforehand, so that the first row of a
    part is known and can be sent to the part before as well; a task then streams its
    part in order and holds two rows. Null texts are empty.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    k = F.col(key).cast("long")
    shares = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx(k, shares, 10 * parts)).first()[0] if shares else []
    bounds = sorted(set(cuts or []), reverse=True)
    rows = docs.select(k.alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    rows = rows.withColumn("_p", _part(F.col("_k"), bounds))
    # a row for each part
    heads = sorted((r["_p"], r["_k"]) for r in docs.select(k.alias("_k")).withColumn("_p", _part(F.col("_k"), bounds))
                   .groupBy("_p").agg(F.max("_k").alias("_k")).collect())
    before = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    also = spark.createDataFrame(before, "_head long, _before int")
    sent = rows.join(F.broadcast(also), F.col("_k").eqNullSafe(F.col("_head")), "left")
    here = F.struct(F.col("_p").alias("part"), F.lit(False).alias("extra"))
    there = F.struct(F.col("_before").alias("part"), F.lit(True).alias("extra"))
    sent = sent.select("_k", "_t", F.explode(
        F.when(F.col("_before").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("_to"))
    dealt = (sent.select(F.col("_to.part").alias("_p"), F.col("_to.extra").alias("_x"), "_k", "_t")
             .repartitionById(len(bounds) + 1, F.col("_p"))
             .sortWithinPartitions("_x", F.col("_k").desc_nulls_last(), F.xxhash64("_t"), "_t").select("_x", "_k", "_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, texts, nexts, chars = None, [], [], [], 0
        for batch in batches:
            for extra, k, t in zip(*(c.to_pylist() for c in batch.columns)):
                if held is not None:
                    keys.append(held[0])
                    texts.append(held[1])
                    nexts.append(t)
                    chars += len(held[1])
                    if len(keys) >= BATCH or chars >= BATCH_CHARS:
                        yield fn(keys, texts, nexts)
                        keys, texts, nexts, chars = [], [], [], 0
                held = None if extra else (k, t)
                if extra:
                    break
            if held is None:
                break
        for _ in batches:  # more rows with the first key of the next part
            pass
        if keys:
            yield fn(keys, texts, nexts)

    return dealt.mapInArrow(run, schema)
