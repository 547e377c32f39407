"""Shared plumbing: staging tables on the cluster's shared folder, word hashing, Arrow helpers.

Edge cases shared by all operators of this subpackage: a null text counts as the
empty text, a null ``doc_id`` is kept as a value of its own, extra columns of the
input are ignored (operators select the columns they name), and empty tables give
empty results with the full schema.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
"""A side is broadcast only when a count has shown it to hold at most this many narrow rows."""


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``; where that is unset, under the warehouse, which all executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staged"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a table and return it read back, so that nothing downstream recomputes it."""
    writer = df.write.mode("overwrite").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder."""
    return write(df, shared_dir(df.sparkSession, name))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged table for broadcast when its counted rows are within the bound; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


BATCH_ROWS, BATCH_BYTES = 4096, 8 << 20


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """What runs inside hands Python batches of at most so many rows and bytes. Texts and sets are long: the usual batches hold tens of megabytes of them, on both sides and for every core."""
    bounds = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k) for k in bounds}
    try:
        for k, v in bounds.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def release() -> None:
    """Give the memory that is free in this process back to the machine: workers outlive tasks and stages, and what one stage took is kept for the next."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for mapInArrow, in a worker that has no free memory of other stages when it begins, and keeps none of its own."""

    def tidied(batches: Batches) -> Batches:
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


class Recent(dict):
    """A cache of two generations: what is used moves to the younger one, which in time replaces the older."""

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.older = bound, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def lacking(self, keys) -> list:
        """Those of ``keys`` in neither generation. Call before a batch; ages the cache when it is full."""
        if len(self) > self.bound:
            self.older = dict(self)
            self.clear()
        return self.absent(keys)

    def absent(self, keys) -> list:
        older = self.older
        return [k for k in keys if k not in self and k not in older]


_of_process: dict = {}


def of_process(make, *args):
    """One object for each worker process, which outlives a task: models and caches are loaded once."""
    key = (make, args)
    if key not in _of_process:
        _of_process[key] = make(*args)
    return _of_process[key]


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words already seen; emptied when it outgrows its bound."""

    def __init__(self, seed: int = 0, bound: int = 400_000):
        super().__init__()
        self.seed, self.bound = seed, bound

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def sliding(x: np.ndarray, width: int, f: np.ufunc) -> np.ndarray:
    """``f`` (minimum or maximum) over all runs of ``width`` values, by doubling."""
    size, acc = 1, x
    for b in bin(width)[3:]:
        acc, size = f(acc[: len(acc) - size], acc[size:]), size * 2
        if b == "1":
            acc, size = f(acc[: len(acc) - 1], x[size : size + len(acc) - 1]), size + 1
    return acc


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values, by doubling: O(n log k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc, size = h, 1
    for b in bin(k)[3:]:  # acc[i] covers `size` values from i on
        acc, size = acc[: len(acc) - size] * np.uint64(pow(int(ODD), size, 2**64)) + acc[size:], size * 2
        if b == "1":
            acc, size = acc[: len(acc) - 1] * ODD + h[size : size + len(acc) - 1], size + 1
    return mix(acc[:n])
