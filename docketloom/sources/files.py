"""Sources: text files, Word packages, sidecars, page HTML, snapshots of a paged service."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import normalize as N

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def read_texts(spark: SparkSession, path: str, pattern: str = "*.{txt,md}") -> DataFrame:
    """path, text: one row a file."""
    return spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _paragraph(p: ElementTree.Element, notes: dict[str, str]) -> str:
    """Text of a paragraph with footnotes at their marks; deleted text is left out."""
    out = []

    def walk(e: ElementTree.Element) -> None:
        if e.tag == f"{W}del":
            return
        if e.tag == f"{W}t":
            out.append(e.text or "")
        elif e.tag in (f"{W}tab", f"{W}br"):
            out.append("\t" if e.tag == f"{W}tab" else "\n")
        elif e.tag == f"{W}footnoteReference" and (note := notes.get(e.get(f"{W}id", ""), "").strip()):
            out.append(" " + note + ("" if note.endswith(".") else ".") + " ")
        for child in e:
            walk(child)

    walk(p)
    return "".join(out)


def word_paragraphs(content: bytes) -> list[tuple[str, str, str]]:
    """(style, alignment, text) of the paragraphs of a Word package."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
        notes = {}
        if "word/footnotes.xml" in z.namelist():
            for f in ElementTree.fromstring(z.read("word/footnotes.xml")).iter(f"{W}footnote"):
                notes[f.get(f"{W}id", "")] = "".join(_paragraph(p, {}) for p in f.iter(f"{W}p"))
    value = lambda p, tag: next((x.get(f"{W}val", "") for x in p.iter(f"{W}{tag}")), "")
    return [(value(p, "pStyle"), value(p, "jc"), _paragraph(p, notes)) for p in body.iter(f"{W}p")]


def read_word(spark: SparkSession, path: str) -> DataFrame:
    """path, i, style, align, text, error: one row a paragraph; a package that can't be read gives one row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += [(p, i, s, a, t, None) for i, (s, a, t) in enumerate(word_paragraphs(content))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows.append((p, -1, None, None, None, type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "i", "style", "align", "text", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, i int, style string, align string, text string, error string")


def word_checks(paragraphs: DataFrame) -> DataFrame:
    """path, check, status, message: checks of paragraph rows."""
    text = F.coalesce("text", F.lit(""))
    flags = paragraphs.where("error is null").groupBy("path").agg(
        F.count_if(F.trim(text) == "").alias("empty"),
        F.count_if(text.rlike(r"[^.] {2,}\S")).alias("double"),
        F.count_if(text.rlike("_{10,}")).alias("underscore"),
        F.count_if(F.lower("style").startswith("heading")).alias("headings"),
        F.count_if(text.rlike("(?i)respectfully submitted")).alias("signature"),
    )
    rule = lambda name, bad, level: F.struct(F.lit(name).alias("check"), F.when(bad, level).otherwise("PASS").alias("status"))
    checks = F.array(
        rule("empty_paragraphs", F.col("empty") > 0, "FAIL"),
        rule("double_spaces", F.col("double") > 0, "WARN"),
        rule("underscore_lines", F.col("underscore") > 0, "FAIL"),
        rule("heading_styles", F.col("headings") == 0, "WARN"),
        rule("signature_block", F.col("signature") == 0, "WARN"),
    )
    return flags.select("path", F.explode(checks).alias("c")).select("path", "c.check", "c.status")


def prefer_sidecar(files: DataFrame, sidecars: DataFrame, least: int = 20) -> DataFrame:
    """files (path, text) with the text of an equally named sidecar (of several the first by path) where that has ``least`` characters."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    side = sidecars.where(F.length(F.trim("text")) >= least).groupBy(stem.alias("stem")).agg(F.min_by("text", "path").alias("side"))
    return files.withColumn("stem", stem).join(side, "stem", "left").select("path", F.coalesce("side", "text").alias("text"), F.col("side").isNotNull().alias("from_sidecar"))


def opinion_text(*fields: str) -> Column:
    """The first field with text, the plain one as it is and the others without tags."""
    first, *rest = fields
    return N.first_text(F.col(first), *(N.strip_html(F.col(f)) for f in rest))


class Page(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class PagedReader(DataSourceReader):
    """Reads pages of a service through a function (page number -> rows or None past the end); a partition is a run of pages.

    What is left out shows: where more pages follow the last one allowed, or a page fails, a row without an id says so in ``note``. The pages before a failure stay.
    """

    def __init__(self, options: dict):
        self.module, _, self.name = options["fetch"].rpartition(":")
        self.pages, self.run = int(options.get("maxpages", "50")), int(options.get("pagesperpartition", "10"))

    def partitions(self) -> list[InputPartition]:
        return [Page(i, min(i + self.run, self.pages)) for i in range(0, self.pages, self.run)]

    def read(self, partition: Page) -> Iterator[tuple]:
        import importlib

        fetch = getattr(importlib.import_module(self.module), self.name)
        last = partition.end == self.pages
        for page in range(partition.start, partition.end + last):
            try:
                rows = fetch(page)
            except Exception as e:  # noqa: BLE001 - the function is foreign code
                yield page, -1, None, None, f"failed: {type(e).__name__}"
                return
            if rows is None:
                return
            if page == self.pages:
                yield page, -1, None, None, "truncated"
                return
            for i, (id_, payload) in enumerate(rows):
                yield page, i, id_, payload, None


class PagedSource(DataSource):
    """format("paged"): page, i, id, payload, note. Options: fetch ("module:function"), maxpages, pagesperpartition."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, i int, id string, payload string, note string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options)
