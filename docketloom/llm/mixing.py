"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source with n rows and target weight w gets the mean repetition rate w * total / n.
Each row's count is the inverse of the Poisson distribution function at a number that a
seeded hash of its doc_id gives; rows repeat by their counts and one shuffle by a hash of
(doc_id, copy) mixes them all. Counts are independent of the partitioning and of other rows.

A hot source is not gathered anywhere: counts per source combine on the map side and rows
move by their own hash. Edge cases: a null source is a source of its own; rows with equal
doc_ids get equal counts; null texts pass through; sources absent from given weights get
weight 0; columns ``copy`` and ``mix_key`` of the input are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stage

LARGEST_MEAN = 200
"""A larger mean is split into equal parts with a number each, as exp(-mean) must not vanish."""


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    key = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def cdf(mean: Column) -> Column:
    """Poisson distribution function at 0, 1, ... as far as it matters in double precision."""
    most = F.ceil(mean + 10 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["c"])


def target_means(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """source, n, mean. Weights default to n ** temperature; the mixture has ``epochs`` times the input's rows on average."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(temperature))
    else:
        weight = F.coalesce(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv))[F.col("source")], F.lit(0.0)) if weights else F.lit(0.0)
    n = stage(n.withColumn("w", weight), "source-counts")
    total = n.agg(F.sum("w").alias("w"), F.sum("n").alias("n")).first()
    scale = epochs * total["n"] / total["w"] if total["w"] else 0.0
    return n.select("source", "n", (F.lit(scale) * F.col("w") / F.col("n")).alias("mean"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, epochs: float = 1.0, seed: int = 29) -> DataFrame:
    """``docs`` repeated by Poisson counts, with ``copy`` from 1 and ``mix_key``; rows lie in the order of mix_key within random partitions."""
    means = target_means(docs, weights, temperature, epochs)
    parts = F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN).cast("int"))
    means = stage(means.withColumn("parts", parts).withColumn("cdf", cdf(F.col("mean") / F.col("parts"))), "means")
    rows = docs.drop("copy", "mix_key")
    rows = rows.select(F.struct(*rows.columns).alias("row"))  # one name, so none of its columns can clash
    joined = rows.join(small(means), F.col("row.source").eqNullSafe(F.col("source")))
    doc_id = F.col("row.doc_id")

    def one(j: Column) -> Column:
        u = uniform(seed, doc_id, j)
        return F.aggregate("cdf", F.lit(0), lambda k, c: k + F.when(c <= u, 1).otherwise(0))

    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("parts")), one), F.lit(0), lambda a, x: a + x)
    repeated = joined.select("row", count.alias("count")).where("count > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    key = F.md5(F.concat_ws(":", F.lit(f"{seed}/order"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.col("copy").cast("string")))
    mixed = repeated.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key")
    return mixed.select("row.*", "copy", "mix_key")
