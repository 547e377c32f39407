"""Queries by name, with their DuckDB oracles where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WHOLE = "(SELECT * REPLACE (coalesce(text, '') AS text) FROM documents) AS documents"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a null text as an empty one; ``WHOLE`` is the same in SQL."""
    return table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
