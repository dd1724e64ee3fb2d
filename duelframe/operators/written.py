"""Tables cut out of a plan: written once to the shared folder and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from duelframe.session import checkpoint_dir


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the folder of ``spark.checkpoint.dir``: whatever reads it
    again does not compute it again, and a lost executor costs the tasks that were running.
    ``partition_by``: a folder for each value of that column, read alone where it is asked for."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
