"""Filing data, pattern sections and treatment verbs as expressions over texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

# Treatment verbs.
STRONG = [
    ("overruled", r"\boverrul(?:ed|es|ing)\b"),
    ("abrogated", r"\babrogat(?:ed|es|ion|ing)\b"),
    ("disapproved", r"\bdisapprov(?:ed|es|ing|al)\b"),
    ("superseded by statute", r"\bsuperseded\s+(?:in\s+part\s+)?by\s+statute\b"),
    ("no longer good law", r"\bno\s+longer\s+(?:good|controlling)\s+law\b"),
    ("receded from", r"\breced(?:ed|es|ing)\s+from\b"),
    ("expressly rejected", r"\bexpressly\s+reject(?:ed|s|ing)\b"),
]
CAUTION = [
    ("distinguished", r"\bdistinguish(?:ed|es|ing|able)\b"),
    ("declined to follow", r"\bdeclin(?:ed|es|ing)\s+to\s+follow\b"),
    ("questioned", r"\bquestioned\b"),
    ("criticized", r"\bcritici[sz](?:ed|es|ing)\b"),
    ("limited to its facts", r"\blimited\s+to\s+(?:its|their)\s+facts\b"),
    ("called into doubt", r"\b(?:called|cast)\s+(?:into\s+)?doubt\b"),
]

# Titles of filings by their headings, in order of preference.
TITLES = [("Affidavit of Service", r"(?i)affidavit\s+of\s+service"), ("Memorandum of Law", r"(?i)memorandum\s+of\s+law"), ("Notice of Motion", r"(?i)notice\s+of\s+motion"), ("Order", r"(?i)\border\b"), ("Complaint", r"(?i)\bcomplaint\b"), ("Answer", r"(?i)\banswer\b")]


def filing(name: Column, text: Column) -> Column:
    """(date, docket, title, missing): stamps in the text come before the file's name."""
    stamp = F.regexp_extract(text, r"(?i)filed:?\s+(\d{1,2}/\d{1,2}/\d{4})", 1)
    date = F.coalesce(F.try_to_date(stamp, "M/d/yyyy"), F.try_to_date(F.regexp_extract(name, r"\d{4}\.\d{2}\.\d{2}", 0), "yyyy.MM.dd"), F.try_to_date(F.regexp_extract(name, r"\d{4}-\d{2}-\d{2}", 0), "yyyy-MM-dd"))
    docket = F.coalesce(*(F.nullif(x, F.lit("")) for x in (F.regexp_extract(text, r"(?i)(?:nyscef\s+doc\.?|doc(?:ument)?\.?)\s+no\.?\s*(\d+)", 1), F.regexp_extract(name, r"^\[?(\d{1,4})\]?[_ -]", 1), F.regexp_extract(name, r"\[(\d+)\]", 1))))
    title = F.coalesce(*(F.when(F.substring(text, 1, 3000).rlike(p), F.lit(t)) for t, p in TITLES), F.nullif(N.title_case(F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z]+$", ""), r"[\d._\[\]-]+", " ")), F.lit("")))
    missing = F.filter(F.array(F.when(date.isNull(), F.lit("date")), F.when(docket.isNull(), F.lit("docket")), F.when(title.isNull(), F.lit("title"))), lambda x: x.isNotNull())
    return F.struct(date.alias("date"), docket.cast("int").alias("docket"), title.alias("title"), missing.alias("missing"))


def sections(pages: DataFrame, pattern: str = r"^PJC\s+(\d+\.\d+)", least: int = 200) -> DataFrame:
    """doc, section, start_page, n_chars, short: of each section's headings the one with the longest body, up to the next heading."""
    lines = pages.select("doc", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    lines = lines.withColumn("section", F.nullif(F.regexp_extract("t", pattern, 1), F.lit("")))
    w = Window.partitionBy("doc").orderBy("page", "line")
    run = lines.withColumn("run", F.count("section").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("run > 0")
    bodies = run.groupBy("doc", "run").agg(F.first("section", ignorenulls=True).alias("section"), F.min("page").alias("start_page"), F.sum(F.length("t") + 1).alias("n_chars"))
    best = Window.partitionBy("doc", "section").orderBy(F.desc("n_chars"), "run")
    return bodies.withColumn("rn", F.row_number().over(best)).where("rn = 1").select("doc", "section", "start_page", "n_chars", (F.col("n_chars") < least).alias("short"))

