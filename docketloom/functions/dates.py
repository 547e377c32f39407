"""Dates in text. The clock is a parameter, so results repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]
DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

DAY_NAME = "(?:(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\\.?,?\\s+)?"
MONTH_NAME = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\\.?"
LONG = f"(?i)\\b{DAY_NAME}{MONTH_NAME}\\s+(\\d{{1,2}})(?:st|nd|rd|th)?(?:,?\\s+(\\d{{4}}))?"
NUMERIC = "(?i)\\b(\\d{1,2})[/-](\\d{1,2})(?:[/-](\\d{4}|\\d{2}))?(?:\\s*\\(\\s*(Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*\\s*\\))?"
DOTTED = "\\b(\\d{4})\\.(\\d{1,2})\\.(\\d{1,2})\\b"


def month_number(c: Column) -> Column:
    """1 to 12 from the first three letters."""
    return F.array_position(F.array(*(F.lit(m[:3].lower()) for m in MONTHS)), F.lower(F.substring(c, 1, 3))).cast("int")


def day_number(c: Column) -> Column:
    """0 (Monday) to 6 from the first three letters; null for anything else."""
    at = F.array_position(F.array(*(F.lit(d[:3].lower()) for d in DAYS)), F.lower(F.substring(c, 1, 3))).cast("int")
    return F.when(at > 0, at - 1)


def full_year(c: Column, clock_year: int) -> Column:
    y = F.nullif(c, F.lit("")).cast("int")
    return F.when(y.isNull(), F.lit(clock_year)).when(y < 100, y + 2000).otherwise(y)


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null where the calendar has none."""
    return F.try_to_date(F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), month.cast("string"), day.cast("string")), "yyyy-M-d")


def mentions(c: Column, clock_year: int) -> Column:
    """Array of (raw, year, month, day, claimed, assumed) by three patterns; what an earlier pattern took is blanked for the later."""

    def rows(text: Column, pattern: str, groups: dict[str, int]) -> Column:
        def one(m: Column) -> Column:
            g = {k: F.regexp_extract(m, pattern, i) for k, i in groups.items()}
            month = month_number(g["name"]) if "name" in g else g["month"].cast("int")
            return F.struct(
                m.alias("raw"), full_year(g["year"], clock_year).alias("year"), month.alias("month"), g["day"].cast("int").alias("day"),
                (day_number(g["dow"]) if "dow" in g else F.lit(None).cast("int")).alias("claimed"), (g["year"] == "").alias("assumed"),
            )

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), one)

    second = F.regexp_replace(c, LONG, " ~ ")
    third = F.regexp_replace(second, NUMERIC, " ~ ")
    return F.concat(
        rows(c, LONG, {"dow": 1, "name": 2, "day": 3, "year": 4}),
        rows(second, NUMERIC, {"month": 1, "day": 2, "year": 3, "dow": 4}),
        rows(third, DOTTED, {"year": 1, "month": 2, "day": 3}),
    )


def filing_name(date: Column, docket: Column, title: Column) -> Column:
    return F.concat(F.date_format(date, "yyyy.MM.dd"), F.lit(" ["), docket.cast("string"), F.lit("] "), title, F.lit(".pdf"))
