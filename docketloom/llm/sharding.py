"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters rows uniformly into buckets by a seeded hash; the number of buckets
follows from the counted bytes, so that a bucket fits in memory however large the table
is. Pass two shuffles each bucket (Spark's ``shuffle`` is a Fisher-Yates shuffle) and
writes it. Buckets in a row give a random order of the whole table; equal stretches of
it are the shards, so row counts differ by one at most (law ``rows``).

A row's place comes from its content alone (doc_id, text and, as JSON, the other columns), so a seed gives
the same shards however the table is cut into files. Rows that are equal in all of it are numbered, so they spread over all buckets
like any others. Inside a bucket rows are sorted by that place before they are shuffled, and how buckets are dealt to
tasks follows from their number, not from the session: ``shuffle`` draws alike when a task runs again. Edge cases: a
null text has size 8 and the CRC of the empty text; null and repeated doc_ids are kept; columns of any type travel along (maps too);
with fewer rows than shards some shards stay empty; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, small, stage, write

BUCKET_BYTES = 4 << 20
GROUP = 4096
MOST_TASKS = 20_000


def placed_by_content(docs: DataFrame, seed: int) -> DataFrame:
    """The rows of ``docs`` as ``record``, with a seeded hash of each as ``place``: equal rows count up, from the start of each task on."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    content = [F.to_json(F.struct(*(F.col(f"`{c}`") for c in others)))] if others else []
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("record"), F.xxhash64(F.lit(seed), "doc_id", "text", *content).alias("h"))
    twice = stage(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "equal-rows")
    if twice.isEmpty():
        return rows.select("record", F.col("h").alias("place"))
    equal = rows.withColumn("part", F.spark_partition_id()).join(small(twice), "h", "left_semi")
    before = equal.groupBy("h", "part").agg(F.count("*").alias("n"))
    before = stage(before.select("h", "part", (F.sum("n").over(Window.partitionBy("h").orderBy("part")) - F.col("n")).alias("before")), "equal-counts")
    own = F.row_number().over(Window.partitionBy("h", "part").orderBy("h"))
    counted = equal.withColumn("own", own).join(small(before), ["h", "part"]).select("record", F.xxhash64("h", F.col("own") + F.col("before")).alias("place"))
    return rows.join(small(twice), "h", "left_anti").select("record", F.col("h").alias("place")).union(counted)


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write ``docs`` in shards and return the table read back: its columns (as ``record``), size, text_crc32, shard, slot."""
    path = path or shared_dir(docs.sparkSession, "shards")
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 8
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    buckets = max(1, -(-total["b"] // bucket_bytes))
    rows = total["n"]
    bucket = F.pmod("place", F.lit(buckets))
    spread = placed_by_content(docs, seed).select(bucket.alias("bucket"), F.struct("place", "record").alias("r")).repartition(min(buckets, MOST_TASKS), "bucket")
    gathered = spread.groupBy("bucket").agg(F.collect_list("r").alias("rs")).sortWithinPartitions("bucket")
    order = F.sort_array(F.transform("rs", lambda r, i: F.struct(r["place"].alias("place"), i.alias("i"))))
    gathered = gathered.select("bucket", F.transform(order, lambda x: F.get("rs", x["i"])["record"]).alias("records"))
    mixed = write(gathered.select("bucket", F.posexplode(F.shuffle("records", F.lit(seed))).alias("pos", "record")), f"{path}/mixed")
    # where each bucket begins: sums inside groups of buckets, then over the groups
    counts = mixed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", F.floor(F.col("bucket") / GROUP))
    outer = counts.groupBy("g").agg(F.sum("n").alias("n"))
    outer = outer.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"))
    inner = Window.partitionBy("g").orderBy("bucket")
    begins = counts.withColumn("own", F.sum("n").over(inner) - F.col("n")).join(outer, "g")
    begins = stage(begins.select("bucket", (F.col("own") + F.col("before")).alias("begin")), "begins")
    placed = mixed.join(small(begins), "bucket").withColumn("at", F.col("begin") + F.col("pos"))
    shard = F.expr(f"(at * {shards}) div {max(1, rows)}")
    first = F.expr(f"(shard * {rows} + {shards - 1}) div {shards}")
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("at") - first)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    out = placed.select("record", (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
    return write(out, f"{path}/sharded", ["shard"])
