"""Streams over the tables, run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import shared_dir
from ..streaming import ledger as L
from .registry import query, table


@query("""SELECT user_id, event_type, event_id, epoch_us(ts) AS "at" FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def ledger_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and kind, followed as a stream of the events' files with state, and read from what it appended."""
    root = shared_dir(spark, "ledger-stream")
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    events.write.option("compression", "zstd").parquet(f"{root}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    L.follow(stream, ["user_id", "event_type"], f"{root}/checkpoint", f"{root}/out", "at", changes=False).awaitTermination()
    return L.followed(spark, f"{root}/out", ["user_id", "event_type"]).select("user_id", "event_type", "event_id", "at")
