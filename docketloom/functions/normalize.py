"""String normalization as Column expressions: no UDFs, so they stay inside code generation and reach the scan's projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no identity in a case name, and in a party name.
CASE_STOPS = ["v", "vs", "the", "of", "and", "in", "a", "an", "for", "co", "inc", "llc", "llp", "ltd", "corp", "n", "sa", "re", "matter"]

SPACE = r"\s+"


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def fold(c: Column) -> Column:
    """Smart quotes, dashes and no-break spaces to ASCII; the length stays. Character classes are quicker here than translate()."""
    s = F.regexp_replace(F.regexp_replace(c, "[“”„]", '"'), "[‘’‚`´]", "'")
    return F.regexp_replace(F.regexp_replace(s, "[—–−‒]", "-"), "\u00a0", " ")


def duplicate_fold(c: Column) -> Column:
    """Key for finding doubled text: folded, without emphasis marks, one space, lower case."""
    return F.lower(collapse(F.regexp_replace(fold(c), "[*_]", "")))


def needle(c: Column) -> Column:
    """A quotation to look for: single bracketed letters keep their letter, other brackets and ellipses go."""
    s = F.regexp_replace(F.translate(c, "“”‘’", "\"\"''"), "[–—―]", " ")
    s = F.regexp_replace(s, r"\[([A-Za-z])\]", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"\[[^\]]*\]", ""), r"…|\.{3,}", " ")
    return F.lower(collapse(s))


def haystack(c: Column) -> Column:
    """A text to search: without star pages and bracketed page marks, dashes and space as one space, lower case."""
    s = F.regexp_replace(c, r"\*\s*\d{1,5}|\[\s*\d{1,5}\s*\]", "")
    s = F.regexp_replace(F.translate(s, "“”‘’", "\"\"''"), r"[–—―\s]+", " ")
    return F.lower(F.trim(s))


def ocr_fold(c: Column) -> Column:
    """The usual misreadings: rn for m inside words, O and l for digits next to digits."""
    s = F.regexp_replace(c, r"(?<=\w)rn", "m")
    return F.regexp_replace(F.regexp_replace(s, r"(?<=\d)O|O(?=\d)", "0"), r"(?<=\d)l|l(?=\d)", "1")


def alphanumeric(c: Column, filler: str = " ") -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", filler)


def statute_fold(c: Column) -> Column:
    """Quotes unified, bracketed words unwrapped, ellipses to spaces."""
    s = F.regexp_replace(F.translate(c, "“”", '""'), r"\[([^\]]*)\]", "$1")
    return F.lower(collapse(F.regexp_replace(s, r"…|\.{3,}", " ")))


def tokens(c: Column, pattern: str = "[a-z0-9]+") -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(pattern), F.lit(0))


def name_tokens(c: Column, stops: list[str] = CASE_STOPS) -> Column:
    """Distinct tokens of two characters or more that aren't stop words."""
    drop = F.array(*map(F.lit, stops))
    return F.array_distinct(F.filter(tokens(c), lambda t: (F.length(t) > 1) & ~F.array_contains(drop, t)))


def case_name_key(c: Column) -> Column:
    """A case name up to its first comma, in lower case, without punctuation and stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(F.substring_index(c, ",", 1)), r"[^\w\s]", " ")), SPACE)
    drop = F.array(*map(F.lit, CASE_STOPS))
    return F.array_join(F.filter(words, lambda t: (t != "") & ~F.array_contains(drop, t)), " ")


def expand(c: Column, words: dict[str, str]) -> Column:
    """Whole words replaced by a dictionary."""
    return reduce(lambda acc, kv: F.regexp_replace(acc, rf"\b{kv[0]}\b", kv[1]), words.items(), c)


def cite_key(c: Column) -> Column:
    return F.lower(collapse(F.regexp_replace(c, "[.,]", "")))


def reporter_family(c: Column) -> Column:
    """The reporter of 'volume Reporter page' in letters and digits, without its series."""
    inner = F.regexp_extract(c, r"\b\d+\s+(.+?)\s+\d+", 1)
    return F.regexp_replace(F.regexp_replace(F.lower(inner), "[^a-z0-9]", ""), "(2d|3d|4th|5th|6th|7th)$", "")


def running_line(c: Column) -> Column:
    """Key of a running header: emphasis gone, digits as #."""
    return F.regexp_replace(F.lower(collapse(F.regexp_replace(fold(c), "[*_]", ""))), r"\d+", "#")


def page_number_free(c: Column) -> Column:
    """Key of a header zone whatever its page number."""
    s = F.regexp_replace(c, r"(?i)\bpage\s+\d+(\s+of\s+\d+)?", "")
    return F.lower(collapse(F.regexp_replace(F.regexp_replace(s, r"^\s*\d+\s*|\s*\d+\s*$", ""), r"[-–—]\s*\d+\s*[-–—]", "")))


def title_case(c: Column, keep: list[str] = ("LLC", "LLP", "LP", "PC", "NA", "USA", "II", "III")) -> Column:
    kept = F.array(*map(F.lit, keep))
    return F.array_join(F.transform(F.split(collapse(c), " "), lambda w: F.when(F.array_contains(kept, F.upper(w)), F.upper(w)).otherwise(F.initcap(w))), " ")


def filename_safe(c: Column) -> Column:
    s = reduce(lambda acc, ab: F.regexp_replace(acc, rf"(?i)\b{ab[0]}\b", ab[1]), [("f/k/a", "fka"), ("a/k/a", "aka"), ("d/b/a", "dba")], c)
    return collapse(F.regexp_replace(s, r'[<>:"/\\|?*]', ""))


def strip_html(c: Column) -> Column:
    """Text of an HTML page: tags to spaces, entities read, one space."""
    s = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return collapse(s)


def first_text(*columns: Column) -> Column:
    """The first column with text in it."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def tidy(c: Column, limit: int = 300) -> Column:
    """A passage cut at a space in its second half, with an ellipsis when cut."""
    head = F.substring(F.trim(c), 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", head) > 0) & (space > limit // 2), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(F.trim(c)) <= limit, F.trim(c)).otherwise(F.concat(F.rtrim(F.regexp_replace(cut, "[ ,;]+$", "")), F.lit("…")))
