"""Tables cut out of a plan: written once to the cluster's shared folder.

An intermediate result that several later plans read is written as Parquet to
the folder of ``spark.checkpoint.dir`` and read again. The lineage ends there,
so a lost executor costs the tasks that were running, not the whole plan, and
every reader sees the same rows.
"""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.session import checkpoint_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; return the table read back and its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables of ``saved`` that no later plan reads."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def small_batches(spark: SparkSession, rows: int = 1_000, size: int = 8 << 20) -> None:
    """Let Spark hand rows to Python workers in batches of at most ``rows`` and about ``size``
    bytes, for stages that pass whole texts through them: a batch is held by the executor
    and by the worker, coming and going."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def release() -> None:
    """Give memory that a task has let go back to the system. Workers are used again, and what
    their allocators hold counts with the next stage's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def running_totals(df: DataFrame, order: list[Column], values: dict[str, Column],
                   carry: list[str]) -> DataFrame:
    """``carry`` and, under each name of ``values``, the running total of that long
    column over the whole table in ``order``, the row itself included.

    Range-sorted, not one window: rows are dealt by range of ``order``, every part
    is summed, the sums of earlier parts (one row a part) are added to a window
    inside each part. Rows that tie in all of ``order`` share a part; make the
    last column of ``order`` unique where many rows may tie.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    wide = df.select(*carry, *[c.cast("long").alias(f"_v_{n}") for n, c in values.items()],
                     *[c.alias(k) for c, k in zip(order, keys)])
    ranged, _ = saved(wide.repartitionByRange(*[F.col(k) for k in keys])
                      .withColumn("_p", F.spark_partition_id()), "ranged")
    sums = ranged.groupBy("_p").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    parts = Window.orderBy("_p")
    before = sums.select("_p", *[(F.sum(f"_s_{n}").over(parts) - F.col(f"_s_{n}")).alias(f"_b_{n}")
                                 for n in values])
    inside = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return (ranged.join(F.broadcast(before), "_p")  # a row for each part
            .select(*carry, *[(F.sum(f"_v_{n}").over(inside) + F.col(f"_b_{n}")).alias(n) for n in values]))


MAX_BROADCAST = 300_000  # rows of a few numbers each


def bounded(df: DataFrame, limit: int = MAX_BROADCAST) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is, so that
    the join shuffles. ``df`` should be a written table, as its rows are counted."""
    return F.broadcast(df) if df.count() <= limit else df


def text_hash(text: str) -> Column:
    """Tells rows that share a key by their texts; no hash of a text is null."""
    return F.xxhash64(F.col(text))


def pick(docs: DataFrame, chosen: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The columns of ``docs`` and ``__copies``, for the rows that ``chosen`` names by ``key``
    and ``_th``, the hash of the text. ``chosen`` has distinct names, ``_copies`` and
    ``_rows``, the number of rows of that name; of rows that repeat a name one is given.
    """
    chosen, _ = saved(chosen.select(F.col(key).alias("__key"), F.col("_th").alias("__th"),
                                    F.col("_copies").alias("__copies"), F.col("_rows").alias("__rows")), "chosen")
    named = docs.withColumn("__hash", text_hash(text))
    on = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__hash") == F.col("__th"))

    def joined(part: DataFrame) -> DataFrame:
        return named.join(part, on).select(*docs.columns, "__copies", "__th")

    once, often = chosen.where("__rows = 1"), chosen.where("__rows > 1")
    out = joined(bounded(once, 1_000_000))
    if not often.isEmpty():
        out = out.unionByName(joined(bounded(often)).dropDuplicates([key, "__th"]))
    return out.drop("__th")
