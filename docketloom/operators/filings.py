"""Filing date, docket number and title of court filings, from their text and their file's name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.normalize import collapse

# Stamps that give a filing date, in order: pattern, formats, source.
STAMPS = [
    (r"RECEIVED NYSCEF[:\s]*(\d{2}/\d{2}/\d{4})", ["MM/dd/yyyy"], "nyscef_received"),
    (r"Filed\s+(\d{2}/\d{2}/\d{4})", ["MM/dd/yyyy"], "ecf_filed_4yr"),
    (r"Filed\s+(\d{2}/\d{2}/\d{2})\b", ["MM/dd/yy"], "ecf_filed_2yr"),
    (r"Document Filed:\s*(\d{2}/\d{2}/\d{4})", ["MM/dd/yyyy"], "pacer_doc_filed"),
    (r"FILED\s*[:\s]*(\d{1,2}/\d{1,2}/\d{4})", ["M/d/yyyy"], "efiletexas_filed"),
    (r"Filed:\s*(\d{1,2}/\d{1,2}/\d{4})", ["M/d/yyyy"], "efiletexas_filed2"),
    (r"FILED\s+(\w+ \d{1,2},?\s*\d{4})", ["MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy"], "efiletexas_filed_text"),
    (r"(?:FILED|Filing Date)[:\s]*(\d{1,2}/\d{1,2}/\d{4})", ["M/d/yyyy"], "generic_filed"),
]
# Names of files that hold a docket number (group 1 where nothing else is said) or a title.
NYSCEF = r"(?i)^(?:\[(\d+)\]\s*)?(\d+)_(\d{4})_[A-Z0-9_]+_v_[A-Z0-9_]+__([A-Z_]+?)_(\d+)\.pdf$"
ECF = r"(?i)^ECF\s+0*(\d+)\s+(.+)\.pdf$"
PACER = r"^(\d+)(?:-(\d+))?\.pdf$"
PACER_GOV = r"^gov\.uscourts\.\w+\.\d+\.(\d+)\.(\d+)\.pdf$"
# Headings that are titles, most telling first.
HEADINGS = [
    r"((?:DEFENDANT'?S?|PLAINTIFF'?S?)\s+MOTION\s+.+?)(?:\n|$)",
    r"(MOTION\s+(?:TO|FOR)\s+.+?)(?:\n|$)",
    r"((?:MEMORANDUM|BRIEF)\s+(?:IN\s+)?(?:SUPPORT|OPPOSITION|REPLY).+?)(?:\n|$)",
    r"((?:FIRST\s+|SECOND\s+|THIRD\s+)?AMENDED\s+(?:COMPLAINT|PETITION|ANSWER).+?)(?:\n|$)",
    r"\b(VERIFIED\s+(?:COMPLAINT|PETITION))\b",
    r"\b(COMPLAINT)\b",
    r"\b(ANSWER(?:\s+AND\s+COUNTERCLAIM)?)\b",
    r"(ORDER\s+.+?)(?:\n|$)",
    r"\b(JUDGMENT)\b",
    r"((?:DECLARATION|AFFIDAVIT)\s+OF\s+.+?)(?:\n|$)",
    r"\b(SUMMONS)\b",
    r"\b(SUBPOENA\s*(?:DUCES\s+TECUM)?)\b",
    r"(NOTICE\s+OF\s+.+?)(?:\n|$)",
    r"(REQUEST FOR JUDICIAL INTERVENTION)",
    r"(COMMERCIAL DIVISION ADDENDUM)",
    r"(EXHIBIT\s+[A-Z0-9]+)",
]
SUFFIXES = ["llc", "lp", "llp", "inc", "ltd", "corp", "plc", "na", "pllc", "pc", "co"]


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def filing_date(text: Column) -> Column:
    """(date, source) of the first stamp in their order that is a date; null without any."""
    tried = [F.coalesce(*(F.try_to_date(F.trim(found(text, p)), f) for f in formats)) for p, formats, _ in STAMPS]
    out = reduce(lambda acc, i: acc.when(tried[i].isNotNull(), F.struct(tried[i].alias("date"), F.lit(STAMPS[i][2]).alias("source"))), range(len(STAMPS)), F)
    return out.otherwise(F.lit(None))


def docket_number(name: Column, text: Column) -> Column:
    """The number that the text gives, else that of the file's name."""
    inside = [found(text, r"Document\s+(\d+)\s+Filed"), found(text, r"(?i)Doc(?:ument)?\.?\s*No\.?\s*(\d+)")]
    outside = [found(name, r"^\[(\d+)\]"), found(name, NYSCEF, 5), found(name, ECF), found(name, PACER), found(name, PACER_GOV)]
    return F.coalesce(*inside, *outside).cast("int")


def titled(c: Column) -> Column:
    """Words in all lower or all upper case get a capital; corporate suffixes are in capitals; mixed words stay."""
    keep = F.array(*map(F.lit, SUFFIXES))

    def word(w: Column) -> Column:
        bare = F.regexp_replace(w, "[.,]+$", "")
        tail = F.substring(w, F.length(bare) + 1, F.length(w))
        plain = w.rlike(r"\p{L}") & ((w == F.lower(w)) | (w == F.upper(w)))
        return F.when(F.array_contains(keep, F.lower(bare)), F.concat(F.upper(bare), tail)).when(plain, F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))).otherwise(w)

    return F.array_join(F.transform(F.split(collapse(c), " "), word), " ")


def entity(c: Column) -> Column:
    """A party's name fit for a file's name."""
    s = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\bf/k/a\b", "fka"), r"(?i)\bn/k/a\b", "nka")
    return titled(F.regexp_replace(s, r'[<>:"/\\|?*]', ""))


# Papers of service and the party that they name.
SERVICE, SERVED_ON = r"(?i)affirmation of service|affidavit of service", r"(?is)Party served:\s*(.+?)(?:\s*b\.\s*Person served|$)"


def filing_title(name: Column, text: Column) -> Column:
    """(title, source, confidence): papers of service, then the first heading that fits in the first 3,000 characters, then the file's name."""
    head = F.substring(text, 1, 3000)
    made = lambda t, source, confidence: F.struct(t.alias("title"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    party = entity(found(text, SERVED_ON))
    out = F.when(text.rlike(SERVICE) & (F.length(party) > 2), made(F.concat(F.lit("Affirmation of Service - "), party), "pdf_content", "high")).when(text.rlike(SERVICE), made(F.lit("Affirmation of Service"), "pdf_content", "medium"))
    for pattern in HEADINGS:
        out = out.when(head.rlike("(?i)" + pattern), made(titled(F.regexp_replace(collapse(found(head, "(?i)" + pattern)), r"\.+$", "")), "pdf_content", "medium"))
    out = out.when(name.rlike(ECF), made(titled(found(name, ECF, 2)), "filename", "medium"))
    return out.when(name.rlike(NYSCEF), made(titled(F.replace(found(name, NYSCEF, 4), F.lit("_"), F.lit(" "))), "filename", "low"))
