"""Ledgers of findings, lookups, inventories, samples and counts for reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Severities, the gravest first.
SEVERITIES = ["critical", "major", "minor", "review"]


def severity_rank(severity: Column) -> Column:
    """1 for the gravest; those that are not known come last."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.lower(F.coalesce(severity, F.lit(""))))
    return F.when(at > 0, at).otherwise(len(SEVERITIES) + 1)


def listed(findings: DataFrame, status: list[str] | None = None, severity: list[str] | None = None) -> DataFrame:
    """Findings of the given dispositions and severities; None leaves a column alone."""
    out = findings
    if status is not None:
        out = out.where(F.col("disposition").isin(status))
    return out if severity is None else out.where(F.col("severity").isin(severity))


def gate(findings: DataFrame) -> DataFrame:
    """One row: open findings, critical ones among them, the code that a run ends with (2 while one is open), and whether a report may be rendered."""
    open_ = F.coalesce(F.col("disposition") == "pending", F.lit(False))
    critical = F.count_if(open_ & (F.col("severity") == "critical"))
    return findings.agg(F.count_if(open_).alias("n_open"), critical.alias("n_critical"), F.when(critical > 0, 2).otherwise(0).alias("code"), (F.count_if(open_) == 0).alias("may_render"))


def terms(asked: DataFrame, known: DataFrame) -> DataFrame:
    """asked, term, kind: terms (term) of the name that is asked for (asked, want) whatever its case, else all that contain it. What is asked for is few: it is broadcast within a counted bound, else the names alone are compared."""
    want = asked.withColumn("_key", F.lower("want"))
    named = known.select("term", F.lower("term").alias("_term"))
    exact = want.join(named, F.col("_key") == F.col("_term")).select("asked", "term", F.lit("exact").alias("kind"))
    missing = want.join(named, F.col("_key") == F.col("_term"), "left_anti")
    keys = missing.select("_key").distinct().where("_key <> ''")
    within = F.broadcast(keys) if keys.limit(10_001).count() <= 10_000 else keys
    holding = named.join(within, F.contains("_term", "_key")).select("term", "_key")
    return exact.unionByName(missing.join(holding, "_key").select("asked", "term", F.lit("contains").alias("kind")))


def treatment_states(scans: DataFrame, least: int = 1) -> DataFrame:
    """authority, status, classification from scans (authority, scanned, negative): a negative one settles it, fewer than ``least`` are no check, all scanned without one is clean, else it is listed."""
    grouped = scans.groupBy("authority").agg(F.bool_or("negative").alias("bad"), F.bool_and("scanned").alias("all_done"), F.count("*").alias("n"))
    status = F.when(F.col("bad"), "done").when(F.col("n") < least, "not_checked").when(F.col("all_done"), "done").otherwise("listed")
    cls = F.when(F.col("bad"), "negative").when(F.col("n") < least, "not_checked").when(F.col("all_done"), "none")
    return grouped.select("authority", status.alias("status"), cls.alias("classification"))


def inventory(files: DataFrame) -> DataFrame:
    """Rows with ``content`` (binary) replaced by its size and SHA-256."""
    return files.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content").cast("long")}).drop("content")


def counts(rows: DataFrame, by: str) -> DataFrame:
    """by, n, percent of all rows with one decimal. The total is one number, joined to the groups."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_total"))
    return n.join(F.broadcast(total)).select(by, "n", F.round(100.0 * F.col("n") / F.col("_total"), 1).cast("double").alias("percent"))


def quote_outcomes(quotes: DataFrame, by: str) -> DataFrame:
    """Of each citation's quotations (result, confirmed): all verbatim, any confirmed fabrication, how many."""
    gone = (F.col("result") == "FABRICATED") & F.coalesce(F.col("confirmed"), F.lit(False))
    return quotes.groupBy(by).agg(F.bool_and(F.col("result") == "VERBATIM").alias("all_verbatim"), F.bool_or(gone).alias("any_fabricated"), F.count("*").alias("n"))


def sample(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows at random: the least by a seeded hash of the row, which Spark finds without sorting all."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *rows.columns), *rows.columns).limit(n)


def gather(profile: dict, over: dict) -> dict:
    """A profile with the values of another laid over it, key by key at every depth."""
    return {**profile, **{k: gather(profile[k], v) if isinstance(v, dict) and isinstance(profile.get(k), dict) else v for k, v in over.items()}}
