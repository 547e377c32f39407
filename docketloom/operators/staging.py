"""Tables written to the shared folder between rounds of an iteration, so that no plan grows and no task's loss repeats the rounds before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


PART_ROWS = 500_000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, under the warehouse, which all executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    root = root or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """``df`` as a side of joins that shuffle: the size of packed files says little of the rows in memory, so Spark would broadcast millions of them through the driver."""
    return df.hint("merge")


def dealt(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """``df`` in as many parts as a shuffle has, and more where these would hold over ``PART_ROWS`` rows, before work that is dear for each row or needs memory for it:
    a file of one row group is one task, however many cores there are, and the fixed parts of a shuffle grow with the input. ``rows``: their number, where it is known without a count."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, (df.count() if rows is None else rows) // PART_ROWS + 1), *keys)


def stage(df: DataFrame, name: str) -> DataFrame:
    return written(df, shared_dir(df.sparkSession, name))
