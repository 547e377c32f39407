"""Case names, cites and what can be read from them, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normalize import collapse

VERSUS = [" v. ", " v ", " vs. ", " vs "]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def parties(name: Column) -> Column:
    """(first, second) of a case name; the second is empty without a versus, and loses a cite or a parenthetical at its end."""
    low = F.lower(name)
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), ",+$", ""))
    out = F
    for sep in VERSUS:
        at = F.locate(sep, low)
        second = bare(F.substring(name, at + len(sep), F.length(name)))
        second = F.trim(F.regexp_replace(F.regexp_replace(second, r",\s+\d+\s+\S+\s+\d+.*$", ""), r"\s*\([^)]*\)\s*$", ""))
        out = out.when(at > 0, F.struct(bare(F.substring(name, F.lit(1), at - 1)).alias("first"), second.alias("second")))
    return out.otherwise(F.struct(F.trim(name).alias("first"), F.lit("").alias("second")))


def search_name(name: Column, listed: Column) -> Column:
    """Both parties of the listed name, else of the name itself, without emphasis and versus."""
    source = F.trim(F.replace(F.coalesce(F.nullif(listed, F.lit("")), name, F.lit("")), F.lit("*"), F.lit("")))
    return F.element_at(F.transform(F.array(parties(source)), lambda p: F.when(p["second"] != "", F.concat_ws(" ", p["first"], p["second"])).otherwise(p["first"])), 1)


def distinctive(name: Column, stops: list[str]) -> Column:
    """The first word of three letters or more of each party that is no stop word; empty without a versus."""
    drop = F.array(*map(F.lit, stops))

    def first(c: Column) -> Column:
        return F.try_element_at(F.filter(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), F.lit(0)), lambda w: ~F.array_contains(drop, w)), F.lit(1))

    return F.element_at(F.transform(F.array(parties(name)), lambda p: F.when(p["second"] != "", F.concat_ws(" ", first(p["first"]), first(p["second"]))).otherwise("")), 1)


def without_date(cite: Column) -> Column:
    """A cite without the parenthetical that holds its year; others, like (U), stay."""
    return F.trim(F.regexp_replace(cite, r"\s*\([^()]*\d{4}[^()]*\)", ""))


def cite_text(volume: Column, reporter: Column, page: Column, listed: Column) -> Column:
    whole = volume.isNotNull() & reporter.isNotNull() & page.isNotNull()
    return F.when(whole, F.concat_ws(" ", volume, reporter, page)).otherwise(without_date(F.coalesce(listed, F.lit(""))))


def cited_year(cite: Column) -> Column:
    """The last year of 1800 to 2099 in a cite."""
    return F.try_element_at(F.regexp_extract_all(cite, F.lit(r"\b(?:1[89]|20)\d{2}\b"), F.lit(0)), F.lit(-1)).cast("int")


def decision_date(cite: Column) -> Column:
    """A full date like 'Mar. 6, 2026'."""
    part = lambda g: F.regexp_extract(cite, r"([A-Za-z]{3,9})\.?\s+(\d{1,2}),\s+((?:19|20)\d{2})", g)
    month = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(F.substring(part(1), 1, 3)))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", part(3), month, part(2)), "yyyy-M-d"))


def pincite(given: Column, cite: Column) -> Column:
    """The first number of a given pincite, else the second page number of the cite outside parentheses."""
    second = F.regexp_extract(F.regexp_replace(cite, r"\([^)]*\)", " "), r"\b\d+\s*,\s*(\d+)\b", 1)
    return F.coalesce(F.nullif(F.regexp_extract(given, r"\d+", 0), F.lit("")), F.nullif(second, F.lit("")))


def balanced(text: Column) -> Column:
    """Display text with the quotation mark that its end or beginning lacks."""
    count = lambda c, mark: F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))

    def curly(s: Column) -> Column:
        opened, closed = count(s, "“"), count(s, "”")
        return F.when(closed > opened, F.concat(F.lit("“"), s)).when(opened > closed, F.concat(s, F.lit("”"))).otherwise(s)

    def straight(s: Column) -> Column:
        last = F.length(s) - F.locate('"', F.reverse(s))  # 0-based
        return F.when(count(s, '"') % 2 == 1, F.when(last > F.length(s) / 2, F.concat(F.lit('"'), s)).otherwise(F.concat(s, F.lit('"')))).otherwise(s)

    let = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)
    return let(let(F.trim(F.coalesce(text, F.lit(""))), curly), straight)


# Furniture that an extracted sentence may begin with.
LEADS = [r"^(see|see also|cf\.|accord|but see|see, e\.g\.,)\s+", r"^\[?\*?\d{1,4}\]?\s+", r"^[IVX]+\.\s+"]


def without_lead(sentence: Column) -> Column:
    """A sentence without signals, page marks and heading numbers before it."""
    return collapse(reduce(lambda s, p: F.regexp_replace(s, f"(?i){p}", ""), LEADS, F.trim(sentence)))


def compact_cite(cite: Column) -> Column:
    return F.regexp_replace(F.lower(cite), r"[\s.,]", "")
