"""Propositions of citations; linear work in long texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from docketloom.operators import citations, propositions, segment

RULE = "The doctrine bars every stale claim of a party"
CASES = [
    (f"{RULE}. See Smith v. Jones, 12 F.3d 34, 36 (2d Cir. 2001). More prose.", "host", f"{RULE}."),
    (f"{RULE}, Smith v. Jones, 12 F.3d 34 (2001), and that is all.", "host", f"{RULE}, and that is all."),
    (f"It fails. Smith v. Jones, 12 F.3d 34 (2001) (noting that {RULE}).", "parenthetical", RULE),
    (f"Fine. Smith v. Jones, 12 F.3d 34 (2001) (per curiam). {RULE}.", "host", ""),
    (f"{RULE}.\n\nOther matter. Yes. See Smith v. Jones, 12 F.3d 34 (2001).", "host", ""),
    (f"Text.\n\n7 See Smith v. Jones, 12 F.3d 34 (2001). {RULE}.\n\nText.", "footnote", ""),
    (f"Text.\n\n7 {RULE}. Well. See Smith v. Jones, 12 F.3d 34 (2001).\n\nText.", "footnote", f"{RULE}."),
    (f"{RULE}. See, e.g., Smith v. Jones, 12 F.3d 34 (2001), aff'd, 5 U.S. 6 (1990); 11 U.S.C. § 547(b).", "host", f"{RULE}."),
]


@pytest.mark.parametrize(("text", "kind", "proposition"), CASES)
def test_ways(spark, text, kind, proposition):
    rows = propositions.propositions(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("start").collect()
    assert (rows[0].kind, rows[0].proposition, rows[0].needs_attention) == (kind, proposition, not proposition)


def test_order_of_texts_and_nulls(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, CASES[0][0]), (3, CASES[0][0]), (3, CASES[0][0])], "doc_id long, text string")
    rows = propositions.propositions(docs).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "None"] and len({r.proposition for r in rows}) == 1


@pytest.mark.parametrize("sentence", ["Parties plead facts with care (see below) and proof", "A judge weighs “the whole record” before any trial", "Notice under the statute, when due, tolls nothing at all"])
def test_citations_leave_no_trace(spark, sentence):
    """Whatever is put in front of a sentence's end or beginning goes again."""
    cites = ["Smith v. Jones, 12 F.3d 34 (2001)", "Acme Corp. v. Doe & Co., 5 U.S. 6, 8-9 (Tex. App. 1990)", "In re Estate of Roe, 37 N.Y.3d 371, 380 (2021)", "2020 WL 12345, at *3 (S.D.N.Y. 2020)", "12 F.3d at 35"]
    rows = [(f"{sentence}, {c}.", f"See {c}. {sentence}.", f"{sentence}. {c}") for c in cites]
    df = spark.createDataFrame(rows, "a string, b string, c string").select(*(propositions.decited(F.col(x)).alias(x) for x in "abc"))
    for r in df.collect():
        assert (r.a.rstrip("."), r.b.lstrip(". ").rstrip("."), r.c.rstrip(".")) == (sentence,) * 3


def test_long_texts_take_linear_time():
    text = f"{RULE}. See Smith v. Jones, 12 F.3d 34, 36 (2d Cir. 2001) (noting \"that much\"). Id. at 37. " * 25_000
    began = time.time()
    lay = propositions.Layout(text)
    ways = [lay.ways(it) for it in citations.detect(text)]
    assert len(text) > 2_000_000 and len(ways) >= 25_000 and time.time() - began < 60


def test_long_texts_have_sentences_and_treatments_in_linear_time():
    began = time.time()
    assert len(segment.sentence_spans("The end came. Mr. A. Smith, Inc. v. Doe left. " * 90_000)) == 180_000
    assert citations.scan("Smith was overruled here. It was criticized. " * 95_000, ["Smith"], "12 F.3d 4") == [("caution", "criticized", 2), ("strong", "overruled", 5)]
    assert time.time() - began < 60


def test_scan_by_definition():
    """Against all pairs of a verb and a mention."""
    r = random.Random(7)
    words = ["Smith", "12 F.3d 4", "12 F.3d at 6", "99 Cal. 7", "overruled", "distinguished", "motion", "not", "the court", "v. Roe", ".", "x" * 50]
    for _ in range(300):
        text = " ".join(r.choice(words) for _ in range(r.randrange(30)))
        forms = citations.own_forms("12 F.3d 4")
        spans = [*citations.named(text, ["Smith"]), *(m.span() for f in forms for m in f.finditer(text))]
        blank = text
        for f in forms:
            blank = f.sub(lambda m: " " * len(m[0]), blank)
        foreign = [m.span() for m in citations.CITED.finditer(blank)]
        want = {}
        for cls, verb, at, end in citations.verb_spots(text):
            pairs = [(0 if a <= at <= b else min(abs(at - b), abs(a - end)), a, b) for a, b in spans]
            d, a, b = min(pairs, default=(999, 0, 0))
            if d <= citations.REACH and not any(x >= min(a, at) and y <= max(b, end) for x, y in foreign):
                want[verb] = min(want.get(verb, (cls, verb, d)), (cls, verb, d))
        assert sorted(citations.scan(text, ["Smith"], "12 F.3d 4")) == sorted(want.values())
