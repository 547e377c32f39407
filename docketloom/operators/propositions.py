"""What a citation is cited for: candidate sentences around it, freed of citations, the first that says something.

One pass over a text gives its sentences (over the text with citations masked, so their periods end none), footnotes, parentheses and
citations as sorted intervals; each citation looks up the few around it. These candidates, in order of
preference, are an array of its row, and the choice among them is made with column expressions:
no shuffle, and nothing is searched again from the start of a text, so work is linear in its length.

Ways, in order. In a footnote: the parenthetical of this citation, the sentence around it, the footnote's first sentence, none of which
leaves the footnote. Elsewhere: for an id. with a quotation the sentence before; a parenthetical of this citation; for any other id.
the sentence before; the sentence around it, unless it only cites; the sentence before; then up to three more back in the
same paragraph. Without any that says something, the first sentence of these is given and ``needs_attention`` is set. Null and empty texts have no rows.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import citations as C
from .gates import bare_proposition, citation_sentence
from .lines import footnotes
from .segment import clamped, sentence_at, sentence_spans

MOST, REACH, BACK = 700, 600, 4
MOST_WAYS = BACK + 3  # candidates of a citation: two of its own or one, the sentence around it, the one before, those further back

# What goes from a sentence to leave its proposition, in this order.
CITE_WORDS = "see also|see, e\\.g\\.|see generally|see|but see|but cf\\.|cf\\.|accord|compare|contra|e\\.g\\.|i\\.e\\.|quoting|citing"
PARTY = r"[A-Z][\w.'’&-]*(?:\s+(?:(?:of|the|and|&)\s+)?[A-Z][\w.'’&-]*){0,4}"
CASE_NAME = rf"(?:(?:In re|Matter of|Ex parte)\s+{PARTY}|{PARTY}\s+v\.\s+{PARTY})"
LEAD = rf"(?:\b(?i:{CITE_WORDS})[,\s]+)*"
ADDRESS = r"\d{1,4}\s+(?:[A-Z][A-Za-z.']*\s?(?:\d?(?:st|nd|rd|th|d)\s?)?){1,4}\s*(?:at\s+\*?)?\d{1,10}(?:[-–]\d{1,5})?(?:,\s*(?:at\s+)?\*?\d{1,5}(?:[-–]\d{1,5})?)*"
DROPS = [
    ("explanation in parentheses", r"\((?:internal|quoting|citing|holding|applying|affirming|reversing|emphasis|collecting|dismissing|noting|finding|rejecting|per curiam|explaining|concluding|recognizing|alteration|quotation|omitted)[^()]*\)"),
    ("case with its address", LEAD + CASE_NAME + r",\s+" + ADDRESS),
    ("address", LEAD + r"\b" + ADDRESS),
    ("court and year", r"\([^()]*\b(?:1[6-9]|20)\d{2}\b[^()]*\)"),
    ("later history", r",?\s*\b(?:overrul(?:ed|ing)|abrogat(?:ed|ing)|aff['’]?d|rev['’]?d|cert\.?\s+denied|vacated|superseded)\b[^.;]*"),
    ("docket number", r"\bNo\.?\s*\d{1,2}:\d{2}-[A-Za-z]{1,3}-\d{2,6}(?:-[A-Z])?"),
    ("statute", r"(?:\d+\s+)?(?:[A-Z][A-Za-z.]*\s+){1,6}§+\s*\d[\d.]*(?:\([a-z0-9]+\))*|§+\s*\d[\d.]*(?:\([a-z0-9]+\))*"),
    ("rule", r"(?:[A-Z][A-Za-z.]*\s+){1,5}P\.\s*\d[\d.]*(?:\([a-z0-9]+\))*"),
    ("record", r"¶+\s*[\d,\s&–-]+|\bDkt\.?\s*\d+|\bECF\s+No\.?\s*\d+|\bEx\.\s*[A-Z0-9]+|\bat\s+\*?\d+(?:[-–]\d+)?"),
    ("supra", r"[A-Z][\w.'’&-]*,\s+supra"),
    ("case", LEAD + CASE_NAME),
    ("signal alone", rf"(?:^|(?<=[.;,(]))\s*(?i:{CITE_WORDS}|id\.)(?=[\s,]*(?:[.;)]|$))"),
    ("empty parentheses", r"\(\s*\)"),
]


def tidy(text: Column) -> Column:
    """Without marks of emphasis and the spaces, commas and periods that removals leave; the mark that ends the sentence stays."""
    out = F.regexp_replace(F.regexp_replace(text, r"\*{1,3}|(?<![A-Za-z0-9])_{1,2}|_{1,2}(?![A-Za-z0-9])", ""), r"\s+", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"\s+([,;:])", "$1"), r"([,;:])(?:\s*[,;:])+", "$1")
    out = F.regexp_replace(out, r"^[\s,;:.]+|[\s,;:]+$", "")
    return F.regexp_replace(F.regexp_replace(out, r"[\s,;:]+\.$", ""), r"\s+([.!?])$", "$1")


def decited(text: Column) -> Column:
    """A sentence without citations, their parentheticals and signals."""
    return tidy(reduce(lambda t, drop: F.regexp_replace(t, drop[1], " "), DROPS, text))


def parentheses(text: str) -> dict[int, int]:
    """Where each outer parenthesis opens and the place after its end, in one sweep; one that never closes ends with its line."""
    out, opened = {}, []
    for m in re.finditer(r"[()\n]", text):
        if m[0] == "(":
            opened.append(m.start())
        elif m[0] == ")" and opened:
            at = opened.pop()
            out[at] = m.end()
        elif m[0] == "\n" and text[m.end() : m.end() + 1].isspace():
            opened.clear()
    return out


YEAR = re.compile(r"\b(?:1[6-9]|20)\d{2}\b")
GAP, NUMBER = re.compile(r"[\s,]*"), re.compile(r"\d*\s*")
SAID = re.compile(r"(?i)(?:quoting|citing|holding|noting|explaining|finding|concluding|recognizing)\b[^\"“a-z]*(?:that\s+)?")


class Layout:
    """Sorted intervals of one text."""

    def __init__(self, text: str):
        self.text, self.masked = text, C.masked(text)
        self.sentences = sentence_spans(self.masked)
        self.begins = [a for a, _ in self.sentences]
        self.breaks = [m.end() for m in re.finditer(r"\n\s*\n", text)]
        self.notes = footnotes(text)
        self.note_starts = [s for _, s, _ in self.notes]
        self.parens = parentheses(text)

    def note_at(self, at: int) -> tuple[int, int] | None:
        k = bisect.bisect_right(self.note_starts, at) - 1
        return self.notes[k][1:] if k >= 0 and at < self.notes[k][2] else None

    def sentence(self, k: int, at: int, low: int = 0, high: int | None = None) -> tuple[int, int] | None:
        """The k-th sentence, cut to a stretch and to a length around an offset."""
        if not 0 <= k < len(self.sentences):
            return None
        start, end = self.sentences[k]
        start, end = max(start, low), end if high is None else min(end, high)
        return clamped((start, end), min(max(at, start), end), MOST) if start < end else None

    def paragraph(self, at: int) -> int:
        k = bisect.bisect_right(self.breaks, at) - 1
        return self.breaks[k] if k >= 0 else 0

    def parenthetical(self, end: int, high: int) -> tuple[int, int] | None:
        """The parentheses right after a citation, court and year passed over, without their quoting or holding."""
        at = GAP.match(self.text, end).end()
        while at in self.parens and at - end <= REACH:
            close = self.parens[at]
            inner = self.text[at + 1 : min(close - 1, at + REACH)]
            if close <= high and not (YEAR.search(inner) and len(inner) < 60 and '"' not in inner and "“" not in inner and not SAID.match(inner)):
                said = SAID.match(inner)
                return (at + 1 + (said.end() if said else 0), min(close - 1, at + REACH))
            at = GAP.match(self.text, close).end()
        return None

    def ways(self, it: dict) -> list[tuple[str, int, int]]:
        """(kind, start, end) of the candidates for a citation, the preferred first."""
        start, end, k = it["start"], it["end"], sentence_at(self.begins, it["start"])
        note = self.note_at(start)
        if note:
            low, high = NUMBER.match(self.text, note[0]).end(), note[1]
            first = sentence_at(self.begins, low)
            found = [("citing_parenthetical", self.parenthetical(end, high)), ("footnote", self.sentence(k, start, low, high)), ("footnote", self.sentence(k - 1, start, low, high) if k - 1 >= first else None), ("footnote", self.sentence(first, low, low, high))]
        else:
            is_id, before = it["kind"] == "id", self.sentence(k - 1, start)
            quoted = is_id and bool(before) and any(q in self.text[before[0] : end] for q in "\"“")
            found = [("id_quote", before)] if quoted else [("parenthetical", self.parenthetical(end, len(self.text)))]
            if is_id and not quoted:
                found.append(("id_prop", before))
            paragraph = self.paragraph(start)
            around = [] if quoted else [self.sentence(k, start), before]
            back = (self.sentence(k - i, start) for i in range(2, BACK + 1))
            around += [s for s in back if s and s[0] >= paragraph]
            found += [("host", s) for s in around]
        return [(kind, *s) for kind, s in found if s]


CANDIDATES = "array<struct<kind:string,text:string,masked:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, key, ways of every citation of ``docs`` (doc_id, text)."""
    struct = pa.struct([("kind", pa.string()), ("text", pa.string()), ("masked", pa.string())])
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(struct)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = C.detect(t) if t else []
                if not found:
                    continue
                lay, rows = Layout(t), []
                for it in found:
                    ways = [{"kind": k, "text": t[a:b], "masked": lay.masked[a:b]} for k, a, b in lay.ways(it)]
                    rows.append((d, it["start"], it["end"], it["key"], ways))
                for at in range(0, len(rows), 2000):
                    cols = zip(*rows[at : at + 2000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "start", "end", "key", "ways"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, start int, end int, key string, ways {CANDIDATES}")


def propositions(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, key, kind, proposition, needs_attention of every citation of ``docs`` (doc_id, text)."""
    rows = candidates(docs).select("doc_id", "start", "end", "key", *(F.get("ways", F.lit(i)).alias(f"w{i}") for i in range(MOST_WAYS)))
    # a candidate is freed of citations only where none before it says something
    for i in range(MOST_WAYS):
        way, open_ = F.col(f"w{i}"), F.lit(True) if i == 0 else ~F.col(f"says{i - 1}")
        rows = rows.withColumn(f"t{i}", F.when(open_ & way.isNotNull(), decited(way["text"])))
        says = F.col(f"t{i}").isNotNull() & ~((way["kind"] == "host") & citation_sentence(way["masked"])) & ~bare_proposition(F.col(f"t{i}"))
        rows = rows.withColumn(f"says{i}", says if i == 0 else F.col(f"says{i - 1}") | says)
    at = lambda i: F.struct(F.col(f"w{i}.kind").alias("kind"), F.col(f"t{i}").alias("text"))
    chosen = F.coalesce(*(F.when(F.col(f"says{i}"), at(i)) for i in range(MOST_WAYS)), *(F.when(~F.contains(F.col(f"w{i}.kind"), F.lit("parenthetical")), at(i)) for i in range(MOST_WAYS)), at(0))
    rows = rows.withColumn("chosen", chosen)
    return rows.select("doc_id", "start", "end", "key", F.col("chosen.kind").alias("kind"), F.col("chosen.text").alias("proposition"), (~F.col(f"says{MOST_WAYS - 1}")).alias("needs_attention"))
