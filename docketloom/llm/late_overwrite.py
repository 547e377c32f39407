"""Late rows rewrite the days they touch: a layout of sorted, evenly cut files that takes in late arrivals.

A layout keeps the latest-arrived row of each key and cuts every day, sorted by time and key,
into Parquet files of a fixed number of rows (``day=D/file_no=K/``). Everything is decided
on narrow rows (key, time, arrival and a pointer to the source row): duplicates go, ranks and
files follow, and the result is a plan from pointers to places in files. Only then are
whole rows read, joined to the plan by pointer and written, each once. Late rows meet the keys of the
files that stand; days where a kept late row stands, or where its key stood, are written anew
and replace the old files; other files aren't opened but for their keys.

Ranks come from a range partitioning: rows are numbered inside their partition, and counts of
(partition, day) give what lies before, so no day passes through one task. A file, demanded
whole, is written by one task in a stream from an external sort. Days and files, bounded by the layout, are
the only lists that meet; a join broadcasts one only behind a count.

A run that is cut off between the two last steps, new files and the removal of numbers that a day no longer reaches, leaves some of these;
taking the same rows in again mends it, as every day where a key stands twice counts as touched.

Edge cases: a null time belongs to day -1 and sorts first, as does a null key; null keys are one key; a null arrival is earlier than
any other; of rows that arrived together the later time, then the later source row stays. Repeated rows are rows with one key. Empty inputs leave an empty
folder. Extra columns travel along; should one be called like a partition column, the partition's name gets an underscore. A clash of
two source files' hashes would change the number of rows, which is compared with the plan's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, stage


@dataclass(frozen=True)
class Layout:
    """Where the files lie, the columns that decide, and how many rows a file holds."""

    root: str
    rows_per_file: int
    schema: T.StructType
    key: str = "sale_id"
    at: str = "sold_at"
    arrived: str = "arrived_at"

    def _free(self, name: str) -> str:
        while name in {c.lower() for c in self.schema.names}:
            name += "_"
        return name

    @property
    def day(self) -> str:
        return self._free("day")

    @property
    def file_no(self) -> str:
        return self._free("file_no")

    def read(self, spark: SparkSession) -> DataFrame:
        """The files as they stand, with their day and number."""
        parts = [T.StructField(self.day, T.LongType()), T.StructField(self.file_no, T.LongType())]
        return spark.read.schema(T.StructType([*self.schema.fields, *parts])).parquet(self.root)


def day_of(at: Column) -> Column:
    """Whole days since 1970; null: -1."""
    return F.coalesce(F.unix_date(F.to_date(at)).cast("long"), F.lit(-1).cast("long"))


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone (the session's, then)."""
    whole = F.unix_date(F.to_date(at)).cast("long") * 86_400 + F.hour(at) * 3_600 + F.minute(at) * 60
    return whole * 1_000_000 + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("long")


POINTER = ["_file", "_row"]


def _pointers() -> list[Column]:
    return [F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]


def _narrow(rows: DataFrame, layout: Layout, late: bool) -> DataFrame:
    """Key, time, arrival and pointer of the rows of stored files; no other column is read."""
    return rows.select(F.col(layout.key).alias("_key"), F.col(layout.at).alias("_at"), F.col(layout.arrived).alias("_arrived"), F.lit(late).alias("_late"), *_pointers())


def _latest(narrow: DataFrame) -> DataFrame:
    """One row a key, its latest, with the days where the key stood before: one, or two if a run was cut off (null: nowhere)."""
    top = F.max(F.struct("_arrived", "_at", "_late", *POINTER))
    stood = F.when(~F.col("_late"), day_of(F.col("_at")))
    best = narrow.groupBy("_key").agg(top.alias("t"), F.min(stood).alias("_from"), F.max(stood).alias("_to"))
    return best.select("_key", "t._at", "t._late", "t._file", "t._row", "_from", "_to", day_of(F.col("t._at")).alias("_day"))


def _plan(kept: DataFrame, rows_per_file: int) -> DataFrame:
    """Pointers with the day, the file and the place in it."""
    ordered = kept.select("_day", "_at", "_key", *POINTER).repartitionByRange("_day", "_at", "_key").sortWithinPartitions("_day", "_at", "_key")
    ordered = stage(ordered.select("_day", *POINTER, F.monotonically_increasing_id().alias("_seq")), "late-ranks").withColumn("_part", F.shiftright("_seq", 33))
    counts = ordered.groupBy("_day", "_part").agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_day").orderBy("_part")) - F.col("_n")
    begins = stage(counts.select("_day", "_part", (F.col("_first") - before).alias("_zero")), "late-begins")
    rank = F.col("_seq") - F.col("_zero")
    placed = ordered.join(small(begins), ["_day", "_part"]).withColumn("_rank", rank)
    return placed.select(*POINTER, "_day", F.expr(f"_rank div {rows_per_file}").alias("_no"), F.col("_rank").alias("_place"))


def _write(rows: DataFrame, plan: DataFrame, layout: Layout) -> None:
    """Whole rows to their files, one join by pointer; what stands in the same places is replaced when the job commits."""
    whole = F.struct(*(F.col(f"`{c}`") for c in layout.schema.names)).alias("_row_")
    placed = rows.select(whole, *_pointers()).join(plan, POINTER)
    ordered = placed.repartition("_day", "_no").sortWithinPartitions("_day", "_no", "_place")
    out = ordered.select("_row_.*", F.col("_day").alias(layout.day), F.col("_no").alias(layout.file_no))
    writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", 0)
    writer.partitionBy(layout.day, layout.file_no).parquet(layout.root)


def files_of(layout: Layout, spark: SparkSession) -> DataFrame:
    """day, file_no, path and n_rows of the files that stand."""
    rows = layout.read(spark).select(F.col(layout.day).alias("day"), F.col(layout.file_no).alias("file_no"), F.col("_metadata.file_path").alias("path"))
    return rows.groupBy("day", "file_no", "path").agg(F.count("*").alias("n_rows"))


def _verify(files: DataFrame, plan: DataFrame, days: DataFrame | None) -> None:
    """The files of the written days hold as many rows as were planned, and no two share a number."""
    if days is not None:
        files = files.join(small(days), F.col("day") == F.col("_day"), "left_semi")
    got = files.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n"), (F.count("*") - F.count_distinct("day", "file_no")).alias("extra")).first()
    if (got["n"], got["extra"]) != (plan.count(), 0):
        raise RuntimeError(f"{got['n']} rows written, {got['extra']} files too many; source pointers clash or files are lost")


def lay_out(rows: DataFrame, layout: Layout) -> None:
    """Write the layout of ``rows``, a stored table, into an empty folder."""
    plan = stage(_plan(_latest(_narrow(rows, layout, late=False)), layout.rows_per_file), "late-plan")
    _write(rows, plan, layout)
    _verify(files_of(layout, rows.sparkSession), plan, None)


def take_in(late: DataFrame, layout: Layout) -> None:
    """Make the layout in the folder that of its own and the ``late`` rows, a stored table."""
    spark = late.sparkSession
    standing = layout.read(spark)
    kept = stage(_latest(_narrow(standing, layout, late=False).union(_narrow(late, layout, late=True))), "late-kept")
    touched = kept.where("_late").select(F.explode(F.array("_day", "_from", "_to")).alias("_day")).where("_day is not null").distinct()
    touched = stage(touched, "late-days")
    plan = stage(_plan(kept.join(small(touched), "_day", "left_semi"), layout.rows_per_file), "late-plan")
    old = standing.join(small(touched), F.col(layout.day) == F.col("_day"), "left_semi")
    before = files_of(layout, spark).join(small(touched), F.col("day") == F.col("_day"), "left_semi").select("day", "file_no").distinct()
    stale = before.join(plan.select(F.col("_day").alias("day"), F.col("_no").alias("file_no")).distinct(), ["day", "file_no"], "left_anti")
    stale = stage(stale, "late-stale")
    sources = [x.select(*layout.schema.names, "_metadata") for x in (old, late)]
    _write(sources[0].unionByName(sources[1]), plan, layout)
    _remove(spark, layout, stale)
    spark.catalog.refreshByPath(layout.root)
    _verify(files_of(layout, spark), plan, touched)


def _remove(spark: SparkSession, layout: Layout, stale: DataFrame) -> None:
    """Delete the folders of file numbers that a day no longer reaches: fewer than the layout has files."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for r in stale.toLocalIterator():
        day = jvm.org.apache.hadoop.fs.Path(f"{layout.root}/{layout.day}={r.day}")
        fs = day.getFileSystem(conf)
        fs.delete(jvm.org.apache.hadoop.fs.Path(day, f"{layout.file_no}={r.file_no}"), True)
        if fs.exists(day) and not fs.listStatus(day):
            fs.delete(day, True)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined keys of each file, whose rows come in order, in batches that may end anywhere."""
    now, sha, out = None, None, []
    for batch in batches:
        days, numbers, keys = (c.to_pylist() for c in batch.columns)
        at = 0
        while at < len(keys):
            file, end = (days[at], numbers[at]), at
            while end < len(keys) and (days[end], numbers[end]) == file:
                end += 1
            joined = ",".join(["" if k is None else k for k in keys[at:end]]).encode()
            if file == now:
                sha.update(b"," + joined)
            else:
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha = file, hashlib.sha256(joined)
            at = end
    if now:
        out.append((*now, sha.hexdigest()))
    cols = zip(*out, strict=True) if out else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["day", "file_no", "ids_sha256"])


def report(layout: Layout, spark: SparkSession, amount: str, started: DataFrame | None = None) -> DataFrame:
    """A row for each file that stands, from what is in it. ``started``: ``files_of`` an earlier state; a path not in it was written since."""
    rows = layout.read(spark).withColumnsRenamed({layout.day: "_day", layout.file_no: "_no"})
    cents = F.coalesce(F.floor(F.col(f"`{amount}`") * 100 + 0.5), F.lit(0))
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    crc = F.crc32(F.concat_ws(":", text(F.col(layout.key)), text(micros(F.col(layout.at))), text(micros(F.col(layout.arrived)))))
    sums = rows.groupBy(F.col("_day").alias("day"), F.col("_no").alias("file_no"), F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.sum(crc).alias("rows_crc"))
    keys = rows.select("_day", "_no", F.col("_metadata.row_index").alias("_i"), F.col(layout.key).cast("string").alias("_key"))
    keys = keys.repartition("_day", "_no").sortWithinPartitions("_day", "_no", "_i").select("_day", "_no", "_key")
    digests = keys.mapInArrow(_digests, "day long, file_no long, ids_sha256 string")
    out = sums.join(digests, ["day", "file_no"]).withColumn("columns", F.lit(",".join(layout.schema.names)))
    if started is not None:
        out = out.join(started.select("path", F.lit(False).alias("rewritten")), "path", "left").withColumn("rewritten", F.coalesce("rewritten", F.lit(True)))
    return out
