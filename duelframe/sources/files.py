"""File sources and sinks: CSV with explicit schemas, Parquet, partitioned
split by a key column and pruned read-back.

A split by key is one ``partitionBy`` write - a single pass over the input
instead of one filter scan per distinct value - and a read of one value
is pruned to its folder by the partition filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from duelframe.operators.keys import join_on_keys
from duelframe.operators.written import written


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Header CSV with a declared schema (no inference pass); both LF and
    CRLF line ends are accepted by Spark's reader. Header names are checked
    against the schema, so a file with its columns in another order fails
    instead of being read wrongly."""
    return (spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
            .option("ignoreTrailingWhiteSpace", True).csv(path))


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None,
                  mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder of temporary tables through Hadoop's file system of that path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


FILE_BYTES = 128 * 1024 * 1024  # of rows as they are, before encoding and compression


def file_plan(df: DataFrame, key: str, file_bytes: int = FILE_BYTES, spread: int | None = None) -> DataFrame:
    """(``key``, ``_first``, ``_files``): in which files each value's rows go. Sizes are summed
    for each value first: a value of ``file_bytes`` or more gets files of its own in
    proportion, smaller ones share files, packed in order of the value up to that size.
    ``spread``: the files of the largest value, which sets the size instead."""
    width = sum((F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8)
                 for f in df.schema.fields), F.lit(0))
    sizes = df.groupBy(key).agg(F.sum(width.cast("long")).alias("_size"))
    most = F.lit(file_bytes) if spread is None else F.ceil(F.max("_size").over(Window.partitionBy()) / spread)
    planned = sizes.withColumn("_most", F.greatest(most.cast("long"), F.lit(1))).withColumn("_own", F.col("_size") >= F.col("_most"))
    planned = planned.withColumn("_files", F.when(F.col("_own"), F.ceil(F.col("_size") / F.col("_most"))).otherwise(1).cast("int"))
    # a row for each folder: own files come first, then those of the small values
    order = Window.orderBy(F.col("_own").desc(), key).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(F.when(F.col("_own"), F.col("_files")).otherwise(0)).over(order), F.lit(0))
    small = F.coalesce(F.sum(F.when(~F.col("_own"), F.col("_size")).otherwise(0)).over(order), F.lit(0))
    first = own + F.when(F.col("_own"), 0).otherwise(F.floor(small / F.col("_most")))
    return planned.select(key, first.cast("int").alias("_first"), "_files")


def write_partitioned(df: DataFrame, key: str, path: str, key_copy: str | None = None,
                      fmt: str = "parquet", mode: str = "overwrite", spread: int | None = None,
                      file_bytes: int = FILE_BYTES) -> None:
    """One folder per value of ``key``. ``partitionBy`` removes the
    partition column from the files, so with ``key_copy`` a copy of the
    key is partitioned on and the original column stays in every file.

    Rows are dealt to tasks by ``file_plan``, a file of a folder to a task: a value's
    files follow its size, so one that holds most of the rows is written by many tasks
    and small ones share a task. Which of its files a row goes to is a hash of the row,
    so a retried task sees exactly the same rows."""
    part = key_copy or key
    plan = written(file_plan(df, key, file_bytes, spread), "files")
    tasks = plan.agg(F.max(F.col("_first") + F.col("_files"))).first()[0] or 1
    d = df.withColumn(part, F.col(key)) if key_copy else df
    row = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(1 << 20))
    dealt = (join_on_keys(d, plan, [key])
             .withColumn("_task", F.col("_first") + F.floor(row * F.col("_files") / (1 << 20)).cast("int")))
    w = (dealt.repartitionById(tasks, F.col("_task")).drop("_first", "_files", "_task")
         .write.mode(mode).partitionBy(part))
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.parquet(path)


def read_partition(spark: SparkSession, path: str, part_col: str, value,
                   fmt: str = "parquet", schema: StructType | None = None) -> DataFrame:
    """Read one partition of a split; the equality on the partition column
    prunes the scan to one folder. ``schema``: of the columns in the files, without which
    every column of a CSV split is a string."""
    if fmt == "csv":
        r = spark.read.option("header", True)
        if schema is not None:  # with the folders' column, which is no column of the files
            r = r.schema(StructType([*[f for f in schema.fields if f.name != part_col], StructField(part_col, StringType())]))
        df = r.csv(path)
    else:
        df = spark.read.parquet(path)
    return df.where(F.col(part_col) == F.lit(value))


def season_slice(df: DataFrame, season_col: str, season) -> DataFrame:
    """Rows of one season (for a season-partitioned table, a pruned read)."""
    return df.where(F.col(season_col) == F.lit(season))
