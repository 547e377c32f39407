"""Checks of Word packages: every package becomes rows, every check is a row of rules, and one aggregation judges them all.

Rows: path, part, place, elem, attr, value. Elements of styles, numbering, footers and the section have a row for their presence (attr '') and
for each attribute. A paragraph of the document is one row (elem 'p') whose value reads ``style=..;align=..;flags|text``; flags: bold, underline,
tab, num (a list item), line=N, cell=table.row.column. Its place is where it stands: head (before the first table), table, body, end (from the signature on) or certificate.

A rule needs rows (``least`` of them) or bans any whose part, place, element, attribute and value match; where ``when`` is given it only holds for packages
with such a paragraph. Packages that can't be read have one row, and one failure.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, part string, place string, elem string, attr string, value string"
PARTS = re.compile(r"word/(styles|numbering|footer\d*)\.xml")
SIGNED, CERTIFIED = re.compile(r"respectfully submitted", re.IGNORECASE), re.compile(r"^\s*CERTIFICATE OF ")


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attrs(e: ElementTree.Element) -> dict[str, str]:
    return {_name(k): v for k, v in e.attrib.items()}


def element_rows(part: str, e: ElementTree.Element, above: str = "") -> Iterator[tuple[str, str, str, str, str]]:
    attrs = _attrs(e)
    key = attrs.get("styleId") or attrs.get("ilvl") if _name(e.tag) in ("style", "lvl") else None
    path = f"{above}/{_name(e.tag)}" + (f"[{key}]" if key is not None else "")
    yield part, "", path, "", (e.text or "").strip()
    for k, v in attrs.items():
        yield part, "", path, k, v
    for child in e:
        yield from element_rows(part, child, path)


def paragraph_line(p: ElementTree.Element, cell: str) -> tuple[str, str]:
    """The description of a paragraph, and its text."""
    found = {_name(x.tag): _attrs(x) for x in p.iter() if _name(x.tag) in ("pStyle", "jc", "spacing", "b", "u", "numPr")}
    on = lambda k: k in found and found[k].get("val", "1") not in ("0", "false", "none")
    tab = any(_name(x.tag) == "tab" for r in p if _name(r.tag) == "r" for x in r)
    text = "".join(x.text or "" if _name(x.tag) == "t" else "\t" for x in p.iter() if _name(x.tag) in ("t", "tab") and not (_name(x.tag) == "tab" and "val" in _attrs(x)))
    flags = [f"style={found.get('pStyle', {}).get('val', '')}", f"align={found.get('jc', {}).get('val', '')}", *(f for f, there in (("bold", on("b")), ("underline", on("u")), ("tab", tab), ("num", "numPr" in found)) if there)]
    if "line" in found.get("spacing", {}):
        flags.append(f"line={found['spacing']['line']}")
    return ";".join([*flags, f"cell={cell}"] if cell else flags), text


def document_rows(body: ElementTree.Element) -> Iterator[tuple[str, str, str, str, str]]:
    place, tables = "head", 0
    for e in body:
        kind = _name(e.tag)
        if kind == "tbl":
            yield "document", "table", "/tbl", "columns", str(sum(1 for x in e.iter() if _name(x.tag) == "gridCol"))
            rows = [x for x in e if _name(x.tag) == "tr"]
            for r, row in enumerate(rows):
                for c, cell in enumerate(x for x in row if _name(x.tag) == "tc"):
                    for p in (x for x in cell.iter() if _name(x.tag) == "p"):
                        line, text = paragraph_line(p, f"{tables}.{r}.{c}")
                        yield "document", "table", "p", "", f"{line}|{text}"
            tables += 1
            place = "body" if place == "head" else place
        elif kind == "p":
            line, text = paragraph_line(e, "")
            place = "certificate" if CERTIFIED.search(text) else "end" if SIGNED.search(text) and place != "certificate" else place
            yield "document", place, "p", "", f"{line}|{text}"
            for s in (x for x in e.iter() if _name(x.tag) == "sectPr"):
                yield from element_rows("document", s)
        elif kind == "sectPr":
            yield from element_rows("document", e)


def package_rows(content: bytes) -> list[tuple[str, str, str, str, str]]:
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        for name in z.namelist():
            if m := PARTS.fullmatch(name):
                out += element_rows(m[1].rstrip("0123456789"), ElementTree.fromstring(z.read(name)))
        body = next(x for x in ElementTree.fromstring(z.read("word/document.xml")).iter() if _name(x.tag) == "body")
    return [*out, *document_rows(body)]


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all packages (*.docx) of a folder."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows = package_rows(content)
                except (zipfile.BadZipFile, KeyError, StopIteration, ElementTree.ParseError) as e:
                    rows = [("error", "", "", "", type(e).__name__)]
                yield pd.DataFrame([(p, *r) for r in rows], columns=[x.split()[0] for x in ROWS.split(", ")])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content").mapInPandas(run, ROWS)


@dataclass(frozen=True)
class Rule:
    check: str
    level: str
    part: str
    elem: str = "p"
    value: str = ""
    attr: str = ""
    place: str = ""
    ban: bool = False
    least: int = 1
    when: str | None = None

    def hits(self) -> Column:
        parts = [F.col("part") == self.part, F.col("elem").rlike(self.elem + "$"), F.col("attr") == self.attr, F.col("value").rlike(self.value)]
        if self.place:
            parts.append(F.col("place").rlike(f"^(?:{self.place})$"))
        return reduce(lambda a, b: a & b, parts)


# What is checked, by court. A heading's number is Word's own, not typed.
TYPED = r"^style=Heading\d.*?\|\s*(?:[IVXLC]+|[A-Z]|\d{1,2})[.)]\s"


def core(size: int = 24, line: int = 480, font: str = "Century Schoolbook", names: list[str] | None = None) -> list[Rule]:
    """The checks that all courts share."""
    heading = r"/styles/style\[Heading1\]"
    rules = [
        Rule("heading_styles", "FAIL", "styles", heading),
        Rule("heading_styles", "FAIL", "styles", heading + "/pPr/keepNext"),
        Rule("heading_styles", "FAIL", "styles", heading + "/pPr/keepLines"),
        Rule("heading_styles", "FAIL", "styles", heading + "/pPr/contextualSpacing", "^(?!0$|false$)", "val", ban=True),
        Rule("document_font", "FAIL", "styles", "/docDefaults/rPrDefault/rPr/rFonts", re.escape(font), "ascii"),
        Rule("document_font", "FAIL", "styles", "/docDefaults/rPrDefault/rPr/sz", f"^{size}$", "val"),
        Rule("heading_numbering", "FAIL", "document", value=TYPED, ban=True),
        Rule("numbering_config", "FAIL", "numbering", "/abstractNum/lvl\\[0\\]/pStyle", "^Heading1$", "val"),
        Rule("empty_paragraphs", "FAIL", "document", value=r"\|\s*$", place="head|body", ban=True),
        Rule("body_spacing", "FAIL", "document", value=rf"^(?!style=(?:Heading|DocumentTitle))[^|]*line=(?!{line}\b)\d+[^|]*\|.*\S", place="body", ban=True),
        Rule("double_spaces", "FAIL", "document", value=r"\|.*\.  ", ban=True),
        Rule("footer", "FAIL", "footer", "/sz", "^20$", "val"),
        Rule("footer", "WARN", "footer", "/smallCaps"),
        Rule("footer", "WARN", "footer", "/b"),
        Rule("footer", "FAIL", "footer", "/jc", "^(?!left$|start$)", "val", ban=True),
        Rule("caption_table", "FAIL", "document", "/tbl", r"^(?:[3-9]|\d\d+)$", "columns"),
        Rule("page_size", "FAIL", "document", "/sectPr/pgSz", "^12240$", "w"),
        Rule("page_size", "FAIL", "document", "/sectPr/pgSz", "^15840$", "h"),
        *(Rule("page_size", "FAIL", "document", "/sectPr/pgMar", "^1440$", side) for side in ("top", "bottom", "left", "right")),
        Rule("list_paragraphs", "FAIL", "document", value=r"^style=ListParagraph;(?!.*\bnum\b[^|]*\|)", ban=True),
        Rule("signature_block", "FAIL", "document", value=r"(?i)\|.*respectfully submitted", place="end"),
        Rule("signature_block", "FAIL", "document", value=r"\|.*/s/", place="end"),
        Rule("certificate_signatures", "FAIL", "document", value=r"underline[^|]*tab[^|]*\|.*/s/", place="certificate", when=r"\|\s*CERTIFICATE OF "),
        Rule("underscore_lines", "FAIL", "document", value=r"\|.*_{3,}", place="end|certificate", ban=True),
        Rule("certificate_content", "FAIL", "document", value=r"(?i)\|.*\bserved?\b", place="certificate", when=r"\|\s*CERTIFICATE OF SERVICE"),
        Rule("certificate_content", "FAIL", "document", value=r"(?i)\|.*\bconferr?ed?\b", place="certificate", when=r"\|\s*CERTIFICATE OF CONFERENCE"),
    ]
    if names:
        known = "|".join(map(re.escape, names))
        rules.append(Rule("known_names", "WARN", "document", value=rf"\|.*/s/\s*(?!\s*(?:{known})\b)\S", ban=True))
    return rules


PREAMBLE = Rule("judge_preamble", "WARN", "document", value=r"(?i)\|.*to the honorable judge", ban=True)
SIGN_COLUMN = Rule("caption_sign", "FAIL", "document", value=r"align=center[^|]*cell=0\.0\.1\|\s*§", place="table")


def federal() -> list[Rule]:
    return [
        *core(),
        Rule("court_header", "FAIL", "document", value=r"align=center;[^|]*bold[^|]*\|\s*(?:IN THE )?UNITED STATES DISTRICT COURT", place="head"),
        Rule("court_header", "FAIL", "document", value=r"align=center[^|]*\|.*DISTRICT OF ", place="head"),
        SIGN_COLUMN,
        Rule("caption_parties", "FAIL", "document", value=r"cell=0\.\d+\.0\|.*\bv\.", place="table"),
        Rule("caption_number", "FAIL", "document", value=r"(?i)cell=0\.\d+\.2\|.*(?:civil action|case) no\.", place="table"),
        PREAMBLE,
    ]


def texas() -> list[Rule]:
    return [
        *core(),
        Rule("cause_number", "FAIL", "document", value=r"align=center[^|]*\|\s*CAUSE NO\.", place="head"),
        SIGN_COLUMN,
        Rule("caption_parties", "FAIL", "document", value=r"cell=0\.\d+\.0\|.*\bv\.", place="table"),
        Rule("caption_court", "FAIL", "document", value=r"cell=0\.\d+\.2\|\s*IN THE (?:DISTRICT|COUNTY) COURT", place="table"),
        Rule("caption_county", "FAIL", "document", value=r"cell=0\.\d+\.2\|.*COUNTY, TEXAS", place="table"),
        PREAMBLE,
    ]


def business() -> list[Rule]:
    return [*core(size=28), Rule("cause_number", "FAIL", "document", value=r"align=center[^|]*\|\s*CAUSE NO\.\s*\d\d-BC", place="head"), Rule("caption_court", "FAIL", "document", value=r"cell=0\.\d+\.2\|.*BUSINESS COURT", place="table"), SIGN_COLUMN]


def new_york() -> list[Rule]:
    shared = [r for r in core() if r.check not in ("heading_styles", "numbering_config")]
    return [*shared, Rule("court_header", "FAIL", "document", value=r"\|\s*SUPREME COURT OF THE STATE OF NEW YORK", place="head"), Rule("court_header", "FAIL", "document", value=r"\|\s*COUNTY OF ", place="head"), Rule("caption_number", "FAIL", "document", value=r"(?i)cell=0\.\d+\.\d\|.*index no\.", place="table")]


COURTS = {"core": core, "federal": federal, "texas": texas, "business": business, "new_york": new_york}


def checked(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """path, check, status, n_broken: PASS, or the gravest level of a check's broken rules, for every package. One aggregation over the rows."""
    counts = [F.count_if(r.hits()).alias(f"n{i}") for i, r in enumerate(rules)]
    given = [F.count_if((F.col("elem") == "p") & F.col("value").rlike(r.when) if r.when else F.lit(True)).alias(f"w{i}") for i, r in enumerate(rules)]
    per = rows.groupBy("path").agg(*counts, *given, F.max(F.when(F.col("part") == "error", F.col("value"))).alias("error"))
    results = []
    for check in dict.fromkeys(r.check for r in rules):
        broken = [(r.level, (F.col(f"w{i}") > 0) & ((F.col(f"n{i}") > 0) if r.ban else (F.col(f"n{i}") < r.least))) for i, r in enumerate(rules) if r.check == check]
        any_of = lambda level, broken=broken: reduce(lambda a, b: a | b, [c for x, c in broken if x == level], F.lit(False))
        status = F.when(any_of("FAIL"), "FAIL").when(any_of("WARN"), "WARN").otherwise("PASS")
        results.append(F.struct(F.lit(check).alias("check"), status.alias("status"), sum(c.cast("int") for _, c in broken).alias("n_broken")))
    readable = F.when(F.col("error").isNotNull(), F.array(F.struct(F.concat(F.lit("package "), "error").alias("check"), F.lit("FAIL").alias("status"), F.lit(1).alias("n_broken")))).otherwise(F.array(*results))
    return per.select("path", F.explode(readable).alias("c")).select("path", "c.check", "c.status", "c.n_broken")


def report(checks: DataFrame) -> DataFrame:
    """path, passed, warned, failed, ok: totals of ``checked``; a package is ok without a failure."""
    n = lambda s: F.count_if(F.col("status") == s)
    return checks.groupBy("path").agg(n("PASS").alias("passed"), n("WARN").alias("warned"), n("FAIL").alias("failed"), (n("FAIL") == 0).alias("ok"))
