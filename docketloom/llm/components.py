"""Connected components of links by alternating large-star and small-star rounds.

Every round is two aggregations with map-side combining and two joins over the links, which
shrink to stars; links are never gathered. A round's links are a written table, so lineage
stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(both: DataFrame, larger_only: bool) -> DataFrame:
    """Link each node's chosen neighbours to the least node around it. ``both``: u, v in both directions."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u")
    kept = joined.where("v > u") if larger_only else joined
    return kept.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label: for every node of ``links`` (a, b) the least node of its component."""
    links = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_star(both, True), "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        moved = down.join(least, "u")
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = stage(small.where("u <> v").distinct(), "small-star")
        now = links.agg(F.count("*").alias("n"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("h")).first()
        if now == state:
            break
        state = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()
