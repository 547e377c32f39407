"""Ledgers as event tables: the current state is the latest event of each key, in batch and as a stream.

The stream keeps one small state a key in Spark's state store and appends a row to its sink when that state changes: nothing is
held in the driver's memory or written anew. Every micro-batch goes to a folder of its own, which a repeated batch overwrites,
so a run that was killed goes on from its checkpoint and gives what a run without a stop gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def current(events: DataFrame, key: str, at: str = "ts") -> DataFrame:
    """The latest event of each key, with the history in order."""
    rest = [c for c in events.columns if c != key]
    history = F.array_sort(F.collect_list(F.struct(at, *[c for c in rest if c != at])))
    return events.groupBy(key).agg(history.alias("history")).select(key, F.element_at("history", -1).alias("latest"), "history")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key), key, "left_anti")


def of_last_version(rows: DataFrame, document: str = "document", version: str = "version") -> DataFrame:
    """Rows of each document's last version: a new build leaves what was known of the one before behind."""
    last = rows.groupBy(document).agg(F.max(version).alias("_last"))
    return rows.join(last, document).where(F.col(version).eqNullSafe(F.col("_last"))).drop("_last")


def _ordered(columns: list[str], keys: list[str], at: str) -> list[str]:
    return [at, *(c for c in columns if c not in keys and c != at)]


def latest_states(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """A row each time that the latest event of a key changes: the keys, the event and how many events the key has had. Of events of one time the greatest counts, nulls being least."""
    columns = _ordered(events.columns, keys, at)
    kinds = {f.name: f.dataType for f in events.schema.fields}
    body = [T.StructField(c, kinds[c]) for c in columns]
    out = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), *body, T.StructField("n_events", T.LongType())])
    # the state holds the event as text, which compares as the batch does on the columns' own types
    state = T.StructType([T.StructField("n", T.LongType()), T.StructField("event", T.BinaryType())])

    def rank(row: tuple) -> tuple:
        return tuple((0, 0) if x is None or x is pd.NaT or x != x else (1, x) for x in row)

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        import pickle

        n, best = group.get if group.exists else (0, None)
        best = pickle.loads(best) if best is not None else None
        before = best
        for pdf in batches:
            for row in pdf[columns].astype(object).itertuples(index=False, name=None):
                n += 1
                if best is None or rank(row) > rank(best):
                    best = row
        group.update((n, pickle.dumps(best)))
        if before is None or rank(best) != rank(before):
            yield pd.DataFrame([(*key, *best, n)], columns=out.names)

    return events.groupBy(*keys).applyInPandasWithState(step, out, state, "append", GroupStateTimeout.NoTimeout)


def newest(events: DataFrame, keys: list[str], at: str = "ts") -> DataFrame:
    """The latest event of each key, as by ``latest_states`` (but NaN is greatest, as in SQL), and how many events it has had, by Spark's own aggregate.
    A stream of it in mode ``update`` keeps one row of state a key and gives a row for each key that had an event, also where the latest stays; no Python runs for a key."""
    columns = _ordered(events.columns, keys, at)
    return events.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_latest"), F.count("*").alias("n_events")).select(*keys, *(F.col("_latest")[c].alias(c) for c in columns), "n_events")


def follow(events: DataFrame, key: str | list[str], checkpoint: str, sink: str, at: str = "ts", changes: bool = True) -> StreamingQuery:
    """Append the latest events from a stream to Parquet folders under ``sink``, only where they change or, without ``changes``, for every key that has an event, which takes
    no Python step a key; a restart goes on from the checkpoint, which is of one of the two."""
    keys = [key] if isinstance(key, str) else key

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    states, mode = (latest_states(events, keys, at), "append") if changes else (newest(events, keys, at), "update")
    return states.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, sink: str, key: str | list[str]) -> DataFrame:
    """The latest event of each key from what ``follow`` has appended: the row of the last batch."""
    keys = [key] if isinstance(key, str) else key
    rows = spark.read.parquet(sink)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("batch")).alias("latest"))
    return best.select(*keys, "latest.*")
