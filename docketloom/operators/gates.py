"""Gates, triggers and classes of texts, names and pages, as boolean or text columns. Null texts fail every gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases that end a decision, and those of a receipt of service.
DECIDED = (
    r"(?i)(it is (hereby |therefore |so )*ordered|so ordered|we (therefore |accordingly |thus )?(affirm|reverse|remand|vacate|dismiss|deny|grant|render|modify|conclude|hold)\b"
    r"|(judgment|order|petition|motion|conviction|appeal) (is |are )?(affirmed|reversed|vacated|remanded|dismissed|denied|granted|modified|rendered)"
    r"|affirmed in part|reversed and remanded|delivered the opinion of the court|per curiam)"
)
SERVED = r"(?i)(certificate of service|i (hereby )?certify that|true and correct copy|was (served|e-?served|filed and served) (on|upon|via|by)|electronically (filed|served) (with|via|through))"
DISPOSED = r"(?i)(affirm|revers|remand|render|vacate|per curiam|delivered the opinion)"
SHEET = r"(?i)(represented by|LEAD ATTORNEY|ATTORNEY TO BE NOTICED|TERMINATED:|Date Filed\s*#\s*Docket Text|PACER Service Center|Docket (Text|Report)|Query\s+Reports)"
SEARCH_PAGE = r"(?i)(Case Events|Appellate Briefs|Calendars|Trial Court Information|Party Information|Set for Submission|SearchMedia\.aspx)"
OPINION_WORDS = ["plaintiff", "defendant", "court", "ordered", "opinion", "motion", "j.s.c", "appeal", "decided"]
# What a reference that is no case is called, by the first words that its name holds.
REFERENCES = [
    (["r. civ. p.", "r. app. p.", "r. evid.", "rule"], "procedural rule"),
    (["§", "code", "u.s.c.", "stat."], "statute"),
    (["order"], "court order"),
    (["agreement", "contract", "notice", "deposition", "msa", "exhibit", "affidavit", "affirmation", "declaration", "stipulation", "amendment", "indenture", "deed", "lease"], "document reference"),
]
INSTRUMENTS = ["order", "agreement", "exhibit", "affidavit", "affirmation", "declaration", "stipulation", "consent", "complaint", "memorandum", "notice of", "amendment", "indenture", "deed", "lease", "deposition"]
CASE_NAME = r"(?i)(\bv\.?\s|\bvs\.?\s|\bin re\b|\bmatter of\b|\bex parte\b|\bestate of\b)"
SITES = [("justia.com", "justia"), ("findlaw.com", "findlaw"), ("casemine.com", "casemine"), ("nycourts.gov", "nycourts_reporter"), ("txcourts.gov", "txcourts"), ("courtlistener.com", "courtlistener")]
SIGNALS = ["see", "cf", "accord", "supra", "infra", "compare", "contra", "also", "generally"]


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))


def complete_opinion(text: Column, least: int = 1200, most: int = 150_000, tail: int = 6000) -> Column:
    """Whether a copy runs to the end of one opinion: its length, a decision near its end, and no mere receipt of service there."""
    end = F.substring(text, F.greatest(F.length(text) - tail + 1, F.lit(1)), F.lit(tail))
    return sure(F.length(text).between(least, most) & end.rlike(DECIDED) & (~end.rlike(SERVED) | end.rlike(DISPOSED)))


def begun(pattern: str, firsts: str) -> str:
    """A case-blind alternation that is only tried where one of the letters stands that its ways begin with; it finds the same."""
    return f"(?i)(?=[{firsts}]){pattern.removeprefix('(?i)')}"


def docket_sheet(text: Column, head: int = 8000, least: int = 3) -> Column:
    return sure(F.regexp_count(F.substring(text, 1, head), F.lit(begun(SHEET, "rlatdpq"))) >= least)


def case_search_page(text: Column, head: int = 20_000, least: int = 2) -> Column:
    return sure(F.regexp_count(F.substring(text, 1, head), F.lit(begun(SEARCH_PAGE, "catps"))) >= least)


def archive_acceptable(text: Column, published: Column, carries_address: Column) -> Column:
    """A docket archive's text stands for a published cite only if it reads like the opinion and carries the cited address; for others any text does."""
    reads = carries_address & (F.length(text) >= 2500) & text.rlike(begun(DECIDED, "iswjopcamrd")) & ~docket_sheet(text)  # cheap tests first
    return sure((F.length(text) > 0) & (~published | sure(reads)))


def like_opinion(text: Column) -> Column:
    low = F.lower(text)
    return sure((F.length(text) >= 600) & (sum(F.contains(low, F.lit(w)).cast("int") for w in OPINION_WORDS) >= 2))


def words_beside(word: str, drop: list[str], end: str, least: int) -> str:
    """A pattern for texts with so many words, those to drop aside; it stops at the last of them and takes no array of all words."""
    one = f"(?!(?:{'|'.join(drop)}){end}){word}"
    return "(?s)" + ".*?".join([one] * least)


def bare_proposition(text: Column, least: int = 4) -> Column:
    """Fewer content words than ``least``, signals aside."""
    word = words_beside("(?<![a-z])[a-z]{3,}+", SIGNALS, "(?![a-z])", least)
    return ~F.lower(F.coalesce(text, F.lit(""))).rlike(word)


# Lower-case words that a string of citations has anyway.
CITE_WORDS = "v vs see also cf accord compare contra but eg e g ie i in re of the ex parte matter id supra infra at no nos and et al op mem slip u s f d".split()


def citation_sentence(masked: Column) -> Column:
    """Of a sentence whose citations are masked with underscores: fewer than two lower-case words outside (up to four levels of) parentheses."""
    whole = F.coalesce(masked, F.lit(""))
    visible = F.when(F.contains(whole, F.lit("(")), reduce(lambda s, _: F.regexp_replace(s, r"\([^()]*\)", " "), range(4), whole)).otherwise(whole)
    plain = F.when(F.contains(visible, F.lit("_")), F.replace(visible, F.lit("_"), F.lit(" "))).otherwise(visible)
    return ~plain.rlike(words_beside(r"\b[a-z]{2,}+\b", CITE_WORDS, r"\b", 2))


GLUE = (
    r"^((([A-Z][A-Za-z'’.]*|and|of|the|for|in|to|on|&)\s+){3,10}"
    r"(The|A|An|In|Under|Given|Because|Where|When|While|Here|This|These|Those|Courts?|Plaintiffs?|Defendants?|It|As|At|On|To|For)\b)"
)


def heading_glue(text: Column) -> Column:
    """A heading in title case that runs into the sentence after it, without a mark between them."""
    head = F.regexp_extract(F.substring(text, 1, 120), GLUE, 1)
    return sure((head != "") & ~head.rlike("[.!?:;,—]"))


def proposition_review(rows: DataFrame, name: str = "name", proposition: str = "proposition") -> DataFrame:
    """``rows`` with ``reasons`` to look at a proposition again; those without any are left out. A sentence is shared when names differ in more than case and spaces."""
    text = F.trim(F.coalesce(F.col(proposition), F.lit("")))
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s{2,}|[^\S ]", " "))
    # a long text is known by its digest, of 64 characters, so that sentences don't travel
    key = lambda c: F.when(F.length(c) < 64, c).otherwise(F.sha2(c, 256))
    owners = rows.select(key(plain(text)).alias("_key"), plain(F.coalesce(F.col(name), F.lit(""))).alias("_name")).where("_key <> ''")
    shared = owners.groupBy("_key").agg((F.min("_name") != F.max("_name")).alias("_shared")).where("_shared")
    given, none = text != "", F.array().cast("array<string>")
    told = lambda *reasons: F.concat(*(F.when(sure(c), F.array(F.lit(r))).otherwise(none) for c, r in reasons))
    first = told((~given, "not extracted"), (given & (F.length(text) < 50), "very short"), (F.length(text) > 480, "runaway"), (F.substring(text, 1, 1).rlike("^[a-z]"), "starts mid-sentence"))
    seen = rows.select("*", key(plain(text)).alias("_key"), first.alias("_first"), told((heading_glue(text), "heading glued on")).alias("_last"))
    joined = seen.join(shared, "_key", "left")
    out = joined.withColumn("reasons", F.concat("_first", told(((F.col("_key") != "") & F.col("_shared").isNotNull(), "shared with another authority")), "_last"))
    return out.where(F.size("reasons") > 0).drop("_key", "_shared", "_first", "_last")


def non_case_class(name: Column, kind: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    out = F
    for words, label in REFERENCES:
        out = out.when(has_any(low, words), label)
    return out.otherwise(F.coalesce(F.nullif(F.lower(kind), F.lit("")), F.lit("reference")))


def instrument(name: Column) -> Column:
    """A name with a document's word and without the shape of a case name."""
    return sure((name != "") & ~name.rlike(CASE_NAME) & has_any(F.lower(name), INSTRUMENTS))


def site(url: Column) -> Column:
    low = F.lower(F.coalesce(url, F.lit("")))
    return reduce(lambda acc, s: acc.when(F.contains(low, F.lit(s[0])), s[1]), SITES, F).otherwise("web")


def qa_note(score: Column, against: Column, supports: Column) -> Column:
    s, a, y = F.coalesce(score, F.lit(0.0)), F.coalesce(against, F.lit(1.0)), sure(supports)
    return F.when(y & (s > 0.8) & (a < 0.5), "supports").when(a >= 0.7, "does not support").when((a >= 0.5) | (s < 0.3), "weak").when(y, "supports").otherwise("unclear")


def may_interpret(read: Column, full_text: Column, quotations: Column) -> Column:
    """Interpretive content needs a case that was read in full and whose quotations are all confirmed."""
    return sure(read) & sure(full_text) & F.forall(F.coalesce(quotations, F.array().cast("array<boolean>")), lambda c: sure(c))


def already_named(name: Column) -> Column:
    return sure(name.rlike(r"^\d{4}\.\d{2}\.\d{2} \[\d+\] .+\.pdf$"))


COURT_WORDS = r"\b(DISTRICT\s+COURT|JUDICIAL\s+DISTRICT|COUNTY|CAUSE\s+NO|CASE\s+NO|PLAINTIFF|DEFENDANT)\b"


def caption_block(text: Column) -> Column:
    """A filing's caption: three section signs, or court words in capitals along with one or a versus."""
    marks = F.regexp_count(text, F.lit("§"))
    return sure((marks >= 3) | (text.rlike(COURT_WORDS) & ((marks >= 1) | text.rlike(r"(?i)\bvs?\.\s"))))


def capitals(text: Column) -> Column:
    return sure((F.length(F.trim(text)) > 3) & text.rlike(r"\p{Lu}") & (text == F.upper(text)))


def heading_level(rows: DataFrame, by: str, at: str, least: int = 4) -> DataFrame:
    """Lines (text, size, body_size, bold_share, off_centre) with ``level`` 0 to 3. ``off_centre``: distance from the page's middle as a share of its width.

    Capitals beside other capitals are a paragraph unless they are much larger; letter heads and section signs are no headings.
    """
    w = Window.partitionBy(by).orderBy(at)
    text, ratio = F.coalesce("text", F.lit("")), F.col("size") / F.col("body_size")
    beside = rows.withColumn("_beside", capitals(F.lag("text").over(w)) | capitals(F.lead("text").over(w)))
    much, larger, brief, caps = ratio > 1.4, ratio > 1.15, F.length(text) < 80, capitals(text)
    level = (
        F.when((F.length(text) < least) | F.trim(text).isin("§", "§§"), 0)
        .when(caps & ~much & F.col("_beside"), 0)
        .when(correspondence_header(text), 0)
        .when(much & brief, 1)
        .when(larger & brief & caps & ((F.col("off_centre") < 0.15) | (F.col("bold_share") >= 0.8)), 2)
        .otherwise(0)
    )
    return beside.withColumn("level", level).drop("_beside")


# How lines of a letter's head begin.
LETTER_HEAD = r"(?i)^\s*(From|To|Cc|Bcc|Subject|Sent|Date|Importance|Inline-Images|Re|Fwd)\b\s*:?"


def correspondence_header(text: Column) -> Column:
    return sure(text.rlike(LETTER_HEAD))


def output_format(kind: Column, wanted: Column) -> Column:
    return F.when(wanted.isin("md", "txt"), wanted).when(kind.isin("deposition", "two-column"), "txt").otherwise("md")
