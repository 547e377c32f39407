"""Exact deduplication by a log-structured merge index of digests.

Ingest: each task keeps a memtable (digest -> identifier to keep, count) of bounded
size and flushes it as a sorted run, cut by the digests' first bits into ``ranges`` pieces, each with a
Bloom filter. Compaction: the pieces of a range merge two by two, the smallest first. One piece is probed against the
other's filter; only possible hits are searched there, equal digests keep the smallest (or largest) identifier,
and the merged piece, sorted again, gets a filter of its own. Digests are uniform, so ranges are even, and their number follows
from the count of rows, so that a range fits in a task. Lookup: digests are probed against
the filter of their range before the join. Verification:
the texts of hits are grouped by their bytes, with map-side combining, so two texts
that share a digest would be told apart.

Edge cases: null and empty texts are equal; null identifiers lose against any other;
repeated rows count; an empty table gives an empty index.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, small, stage, write

MEMTABLE, RANGE_ROWS = 100_000, 50_000
FILTER_BITS_PER_KEY, PROBES = 10, 4
RUN = "run string, range int, digests binary, has binary, ids binary, ns binary, filter binary"
MERGED = "range int, digest binary, keep_id long, n long, filter binary"


def _places(digests: np.ndarray, size: int) -> np.ndarray:
    return digests.view("<u8").reshape(len(digests), 4)[:, :PROBES] % np.uint64(size)


def bloom(digests: np.ndarray) -> bytes:
    bits = np.zeros(max(64, len(digests) * FILTER_BITS_PER_KEY), bool)
    bits[_places(digests, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes() + len(bits).to_bytes(8, "little")


def may_hold(filter_: bytes, digests: np.ndarray) -> np.ndarray:
    size = int.from_bytes(filter_[-8:], "little")
    bits = np.unpackbits(np.frombuffer(filter_[:-8], np.uint8), count=size).astype(bool)
    return bits[_places(digests, size)].all(axis=1)


@dataclass
class Piece:
    """Sorted digests (S32) with, for each, whether it has an identifier, the one to keep, and its count."""

    digests: np.ndarray
    has: np.ndarray
    ids: np.ndarray
    ns: np.ndarray
    filter: bytes

    @staticmethod
    def sorted(digests: np.ndarray, has: np.ndarray, ids: np.ndarray, ns: np.ndarray) -> Piece:
        order = np.argsort(digests, kind="stable")
        digests = np.ascontiguousarray(digests[order])
        return Piece(digests, has[order], ids[order], ns[order], bloom(digests))


def merge(a: Piece, b: Piece, keep: str) -> Piece:
    """Two pieces to one; ``a`` is probed against the filter of ``b``."""
    at = np.flatnonzero(may_hold(b.filter, a.digests))
    to = np.minimum(np.searchsorted(b.digests, a.digests[at]), len(b.digests) - 1)
    equal = b.digests[to] == a.digests[at]
    at, to = at[equal], to[equal]
    has, ids, ns = b.has.copy(), b.ids.copy(), b.ns.copy()
    better = a.has[at] & (~has[to] | (a.ids[at] > ids[to] if keep == "largest" else a.ids[at] < ids[to]))
    ids[to[better]] = a.ids[at[better]]
    has[to] |= a.has[at]
    ns[to] += a.ns[at]
    rest = np.ones(len(a.digests), bool)
    rest[at] = False
    return Piece.sorted(*(np.concatenate([x, y[rest]]) for x, y in ((b.digests, a.digests), (has, a.has), (ids, a.ids), (ns, a.ns))))


def _flush(keep: str, limit: int, ranges: int):
    better = max if keep == "largest" else min

    def emit(table: dict, name: str) -> pa.RecordBatch:
        every = Piece.sorted(np.array(list(table), "S32"), *(np.array(c, t) for c, t in zip(zip(*((i is not None, i or 0, n) for i, n in table.values()), strict=True), (bool, np.int64, np.int64), strict=True)))
        of = range_of(every.digests, ranges)
        rows = []
        for r in np.unique(of).tolist():
            x, y = np.searchsorted(of, [r, r + 1])
            d = every.digests[x:y]
            rows.append((name, r, d.tobytes(), every.has[x:y].tobytes(), every.ids[x:y].tobytes(), every.ns[x:y].tobytes(), bloom(d)))
        kinds = [pa.string(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in RUN.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, table, flushed = TaskContext.get().partitionId(), {}, 0
        for batch in batches:
            for doc_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                had = table.get(digest)
                if had is None:
                    table[digest] = (doc_id, 1)
                else:
                    ids = [x for x in (had[0], doc_id) if x is not None]
                    table[digest] = (better(ids) if ids else None, had[1] + 1)
                if len(table) >= limit:
                    yield emit(table, f"{task}-{flushed}")
                    table, flushed = {}, flushed + 1
        if table:
            yield emit(table, f"{task}-{flushed}")

    return run


def range_of(digests: np.ndarray, ranges: int) -> np.ndarray:
    """Ranges in the order of the digests, by their first four bytes."""
    first = np.ascontiguousarray(digests).view(">u4").reshape(len(digests), 8)[:, 0].astype(np.uint64)
    return (first * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _merge_range(keep: str):
    def run(table: pa.Table) -> pa.Table:
        heap = []
        for i, (d, has, ids, ns, f) in enumerate(zip(*(table.column(c).to_pylist() for c in ("digests", "has", "ids", "ns", "filter")), strict=True)):
            heap.append((len(d), i, Piece(np.frombuffer(d, "S32"), np.frombuffer(has, bool), np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), f)))
        heapq.heapify(heap)
        serial = len(heap)
        while len(heap) > 1:
            (_, _, a), (_, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            whole = merge(a, b, keep)
            heapq.heappush(heap, (32 * len(whole.digests), serial := serial + 1, whole))
        p, n, whole = heap[0][2], len(heap[0][2].digests), heap[0][2].digests.tobytes()
        cols = {
            "range": pa.array(np.full(n, table.column("range")[0].as_py()), pa.int32()),
            "digest": pa.array([whole[i : i + 32] for i in range(0, 32 * n, 32)], pa.binary()),
            "keep_id": pa.array(p.ids, pa.int64(), mask=~p.has),
            "n": pa.array(p.ns, pa.int64()),
            "filter": pa.array([p.filter, *[None] * (n - 1)], pa.binary()),
        }
        return pa.table(cols)

    return run


def with_digest(docs: DataFrame) -> DataFrame:
    """docs with ``text`` not null and its SHA-256 as ``digest``."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumn("digest", F.unhex(F.sha2("text", 256)))


def ranges_for(rows: int) -> int:
    return max(1, -(-rows // RANGE_ROWS))


def ingest(digests: DataFrame, path: str, keep: str = "largest", limit: int = MEMTABLE, ranges: int | None = None) -> DataFrame:
    """Append the sorted runs of ``digests`` (doc_id, digest) to level 0 of the index at ``path``. All runs of an index have the same ``ranges``."""
    ranges = ranges or ranges_for(digests.count())
    runs = digests.select("doc_id", "digest").mapInArrow(_flush(keep, limit, ranges), RUN)
    runs.write.mode("append").option("compression", "zstd").parquet(f"{path}/level0")
    return digests.sparkSession.read.schema(RUN).parquet(f"{path}/level0")


def compact(runs: DataFrame, path: str, keep: str = "largest") -> DataFrame:
    """Merge runs into one level of sorted, disjoint digests; the first digest of a range carries the range's filter."""
    merged = runs.groupBy("range").applyInArrow(_merge_range(keep), MERGED)
    return write(merged, f"{path}/level1")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = []
        for f, l in zip(batch.column("filter").to_pylist(), batch.column("l").to_pylist(), strict=True):
            hits += [l[i] for i in np.flatnonzero(may_hold(f, np.array(l, "S32"))).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(hits, pa.binary())], ["digest"])


def lookup(index: DataFrame, digests: DataFrame, ranges: int) -> DataFrame:
    """Rows of ``digests`` (doc_id, digest) found in a compacted index of so many ranges, with its keep_id: the smallest or largest, as it was built.

    Distinct digests meet their range's filter in lists of at most a thousand or so; only those it may hold join the index.
    """
    first = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    new = digests.select("digest").distinct().withColumn("range", F.floor(first * ranges / F.lit(1 << 32)).cast("int"))
    lists = new.groupBy("range", F.pmod(F.xxhash64("digest"), F.lit(max(1, RANGE_ROWS // 1000))).alias("part")).agg(F.collect_list("digest").alias("l"))
    filters = index.where(F.col("filter").isNotNull()).select("range", "filter")
    hits = lists.join(filters, "range").select("filter", "l").mapInArrow(_probe, "digest binary")
    found = index.select("digest", "keep_id").join(hits, "digest")
    return digests.select("doc_id", "digest").join(found, "digest").select("doc_id", "digest", "keep_id")


def deduplicate(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    path = shared_dir(spark, "digest-index")
    digested = with_digest(docs)
    index = compact(ingest(digested, path, keep), path, keep)
    hits = stage(index.where("n > 1").select("digest"), "hits")
    best = F.max if keep == "largest" else F.min
    # byte verification: equal digests must come with equal bytes
    groups = digested.join(small(hits), "digest", "left_semi").groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    checked = stage(groups.groupBy("digest").agg(F.count("*").alias("texts"), best("keep_id").alias("keep_id"), F.sum("n").alias("n")), "verified")
    rows = digested.select("doc_id", "digest")
    verified = index.select("digest", "n", "keep_id").join(checked.select("digest", "texts"), "digest", "left")
    found = rows.join(verified, "digest")
    if checked.where("texts > 1").isEmpty():
        out = found
    else:  # a digest collision: these few digests are told apart by their texts
        odd = checked.where("texts > 1").select("digest")
        told = digested.join(odd, "digest", "left_semi")
        exact = told.groupBy("digest", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
        out = found.where("texts is null or texts = 1").select("doc_id", "digest", "n", "keep_id").unionByName(told.join(exact, ["digest", "text"]).select("doc_id", "digest", "n", "keep_id"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
