"""Quotations that may be a statute's: which code and section they could come from, whether its text has them, and whole sentences that lost a mark.

References of a document are found once, with their places; citations meet those within ``REACH`` characters by bins, not by a product.
A citation's own proposition counts before its surroundings; of places equally far the one before it comes first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import by_row

REACH = 600
# How a section of a code is cited, the letters of codes by the first letters of their names, quotations that count, and where texts of sections stand.
NAMED = r"Civ\.?\s*Prac\.?\s*&\s*Rem\.?|Bus\.?\s*&\s*Com(?:m)?\.?|Gov(?:'t|t)?\.?|Prop\.?|Fam\.?|Lab\.?|Occ\.?|Penal|Tax|Ins\.?|Elec\.?|Est(?:ates)?\.?|Health\s*&\s*Safety|Loc\.?\s*Gov(?:'t|t)?\.?"
SECTION = rf"(?i)Tex(?:as|\.)?\s+({NAMED})\s*Code(?:\s*Ann\.?)?\s*(?:§{{1,2}}|Sec(?:tion|s)?\.?)\s*(\d+[A-Za-z]?\.\d+)"
LETTERS = {"civ": "CP", "bus": "BC", "gov": "GV", "pro": "PR", "fam": "FA", "lab": "LA", "occ": "OC", "pen": "PE", "tax": "TX", "ins": "IN", "ele": "EL", "est": "ES", "hea": "HS", "loc": "LG"}
QUOTED = r"[“\"]([^”\"]{25,400})[”\"]"
PAGES = ["https://statutes.capitol.texas.gov/Docs/{code}/htm/{code}.{chapter}.htm", "https://law.justia.com/codes/texas/"]
ELLIPSIS = r"\.\s?\.\s?\.|…"


def code_letters(name: str) -> str | None:
    return LETTERS.get(re.sub("[^a-z]", "", name.lower())[:3])


def references(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, code, section of every section that ``docs`` (doc_id, text) cite."""
    found = re.compile(SECTION)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(d, m.start(), m.end(), code_letters(m[1]), m[2]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for m in found.finditer(t)]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "start", "end", "code", "section"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, end long, code string, section string")


def quotations(proposition: Column) -> Column:
    """The quotations of 25 to 400 characters in a proposition."""
    return F.coalesce(F.regexp_extract_all(proposition, F.lit(QUOTED), F.lit(1)), F.array().cast("array<string>"))


def targets(cites: DataFrame, docs: DataFrame, reach: int = REACH) -> DataFrame:
    """cite_id, rank, code, section, distance, urls, quotes: sections, each once, that a citation's quotations may come from, the nearest first.

    cites: cite_id, doc_id, start, proposition, cite_text. Those without a quotation, or with no section in their proposition, cite or within ``reach``, have no row.
    """
    quoting = cites.withColumn("quotes", quotations(F.col("proposition"))).where(F.size("quotes") > 0)
    own = quoting.select(F.col("cite_id").alias("doc_id"), F.concat_ws(" ", "proposition", "cite_text").alias("text"))
    near = references(own).select(F.col("doc_id").alias("cite_id"), "code", "section", F.lit(-1).cast("long").alias("distance"), F.lit(False).alias("after"), "start")
    bins = F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("start") + reach) / reach)))
    asked = quoting.where("start is not null").select("cite_id", "doc_id", F.col("start").alias("at"), bins.alias("bin"))
    placed = references(docs).withColumn("bin", F.floor(F.col("start") / reach))
    around = asked.join(placed, ["doc_id", "bin"]).where(f"start >= at - {reach} and end <= at + {reach}")
    around = around.select("cite_id", "code", "section", F.abs(F.col("start") - F.col("at")).alias("distance"), (F.col("start") > F.col("at")).alias("after"), "start")
    each = near.unionByName(around).where("code is not null").groupBy("cite_id", "code", "section").agg(F.min(F.struct("distance", "after", "start")).alias("place"))
    rows = each.groupBy("cite_id").agg(F.array_sort(F.collect_list(F.struct("place", "code", "section"))).alias("r")).select("cite_id", F.posexplode("r").alias("rank", "r"))
    chapter = F.substring_index("r.section", ".", 1)
    urls = F.array(*(F.replace(F.replace(F.lit(p), F.lit("{code}"), F.col("r.code")), F.lit("{chapter}"), chapter) for p in PAGES))
    return rows.select("cite_id", "rank", "r.code", "r.section", F.greatest(F.col("r.place.distance"), F.lit(0)).alias("distance"), urls.alias("urls")).join(quoting.select("cite_id", "quotes"), "cite_id")


def plain(text: Column) -> Column:
    """Lower case, straight marks, brackets around letters gone, ellipses and white space as one space."""
    out = F.regexp_replace(F.regexp_replace(text, "[“”]", "\""), r"\[([\p{L}\p{N}_]+)\]", "$1")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(out, ELLIPSIS, " "), r"\s+", " ")))


def check(quotes: Column, statute: Column, cite_text: Column, least: int = 15) -> Column:
    """(matched, total, later): how many quotations the section's text has (all their fragments of 15 characters or more, else the whole), and years of its amendments after the cited decision."""
    body = plain(F.coalesce(statute, F.lit("")))

    def has(q: Column) -> Column:
        parts = F.filter(F.transform(F.split(q, ELLIPSIS, -1), plain), lambda p: F.length(p) >= least)
        return F.when(F.size(parts) > 0, F.forall(parts, lambda p: F.contains(body, p))).otherwise(F.contains(body, plain(q)))

    year = F.try_element_at(F.regexp_extract_all(F.coalesce(cite_text, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), F.lit(-1)).cast("int")
    acts = F.transform(F.regexp_extract_all(F.coalesce(statute, F.lit("")), F.lit(r"Acts\s+((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    later = F.filter(F.array_sort(F.array_distinct(acts)), lambda y: F.coalesce(y > year, F.lit(False)))
    return F.struct(F.size(F.filter(quotes, has)).alias("matched"), F.size(quotes).alias("total"), later.alias("later"))


MARKS, CAPITAL = "\"“”", re.compile(r"\[[A-Z]\]")
FOLD = str.maketrans("“”‘’–—", "\"\"''--")


def recovered_quotation(proposition: str, opinion: str, least: int = 25) -> str | None:
    """A whole sentence that is a quotation though a mark of it was lost: one survives, or it begins with a capital in brackets, and all of it stands in the opinion, ellipses leaving something out, in order."""
    text = proposition.strip()
    if not (any(q in text for q in MARKS) or CAPITAL.match(text)):
        return None
    bare = "".join(c for c in text if c not in MARKS).strip()
    fold = lambda t: re.sub(r"\s+", " ", re.sub(r"\[(\w+)\]", r"\1", t.translate(FOLD))).replace('"', "").strip().lower()
    if len(bare) < least:
        return None
    whole, at = fold(opinion), 0
    for part in filter(None, (fold(p) for p in re.split(ELLIPSIS, bare))):
        found = whole.find(part, at)
        if found < 0:
            return None
        at = found + len(part)
    return bare if at else None


def recovered(proposition: Column, opinion: Column) -> Column:
    return by_row(recovered_quotation, "string", proposition, opinion)
