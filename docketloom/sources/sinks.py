"""Sinks: page-marked text, manifest upserts, rename plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def paged_text(pages: DataFrame) -> DataFrame:
    """doc, text: pages (doc, page, text) in order under page marks; pages without text are named as gaps. One document is one group."""
    block = F.concat(F.lit("<!-- Page "), "page", F.lit(" -->\n"), F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) < 20, F.lit("[no text on this page]")).otherwise(F.col("text")))
    rows = F.array_sort(F.collect_list(F.struct("page", block.alias("block"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["block"]), "\n\n").alias("text"))


def upsert(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` replace those of ``current`` with their key."""
    return current.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def rename_plan(plan: DataFrame) -> DataFrame:
    """plan (old, new) with ok and error: bad characters, too long, or two files to one name."""
    n = F.count("*").over(Window.partitionBy("new"))
    error = F.when(F.col("new").rlike(r'[<>:"/\\|?*]'), "illegal character").when(F.length("new") > 240, "too long").when(n > 1, "conflict")
    return plan.select("old", "new", error.isNull().alias("ok"), error.alias("error"))
