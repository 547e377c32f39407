"""Citation detection, treatment scans and the tables that took the place of generated rules."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from docketloom.functions import style
from docketloom.operators import citations, resolve, severity

TEXT = (
    "The rule stands. Baker v. State, 100 F.3d 10, 12 (2d Cir. 1999). It said \"the duty of care extends\". Id. at 15. That is so. Id. at 16. The court agreed. Baker, 100 F.3d at 17. "
    "Look at Baker, supra, at 18. Look at Baker, supra. So held Miller v. Corp, 5 U.S. 6 (1990) (quoting Cooper v. Corp, 7 F. Supp. 2d 8). He wrote \"these words are quite long\". Id. at 9. "
    "He swore \"I saw it all with my eyes\". Ex. 5. Id. at 3."
)


def test_forms_antecedents_and_nesting():
    got = [(i["kind"], i["key"], i["pin"], i["nested"], i["index"], i["count"]) for i in citations.detect(TEXT)]
    assert got == [
        ("full", "100 f3d 10", "12", None, 1, 4), ("id", "100 f3d 10", "15", None, 2, 4), ("short", "100 f3d 10", "17", None, 3, 4), ("supra", "100 f3d 10", "18", None, 4, 4),
        ("full", "5 us 6", None, None, 1, 2), ("full", "7 fsupp2d 8", None, "quoting", 1, 1), ("id", "5 us 6", "9", None, 2, 2),
    ]
    parent = next(i for i in citations.detect(TEXT) if i["nested"])["parent"]
    assert TEXT[parent:].startswith("Miller v. Corp")


def test_an_id_before_any_citation_is_kept_with_the_name_in_prose():
    found = citations.detect("In Baker v. State the court wrote \"no duty was owed here\". Id. at 4.")
    assert [(i["kind"], i["name"]) for i in found] == [("id", "Baker v. State")]


def test_long_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, TEXT * 3000), (2, ""), (3, None)], "doc_id long, text string")
    rows = citations.citations(docs).groupBy("doc_id").count().collect()
    assert {r.doc_id for r in rows} == {1} and rows[0]["count"] >= 7 * 3000


def test_masks_keep_length_and_lines():
    text = "See 5 U.S.\n6 and Tax Code § 12 under Fed. R. Civ. P. 4 here"
    assert citations.masked(text) == "See ______\n_ and _____________ under _________________ here" and len(citations.masked(TEXT)) == len(TEXT)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We overruled Smith.", [("strong", "overruled", 1)]), ("We have not overruled Smith.", []), ("The objection was overruled in Smith.", []), ("Smith v. Doe was abrogated.", []),
        ("They have not questioned Smith.", [("caution", "questioned", 1)]), ("Questioned by 7 U.S. 9 and Smith.", []), ("Questioned" + " x" * 124 + " Smith", [("caution", "questioned", 249)]), ("Questioned" + " x" * 125 + " Smith", []),
        ("It questioned 12 F.3d at 19.", [("caution", "questioned", 1)]), ("It questioned 12 F. 3d 15, and again questioned Smith", [("caution", "questioned", 1)]), ("", []),
    ],
)
def test_treatments(text, want):
    assert citations.scan(text, ["Smith"], "12 F.3d 15") == want


def test_reporters_in_one_pass_as_in_order(spark):
    """The single pass gives what the rules give one after the other."""
    rng = random.Random(8)
    words = ["N. Y.", "N.Y.S.2d", "F. Supp. 3d", "F. 2d", "F. 4th", "F.App'x", "Fed. Appx.", "So. 2d", "S.W. 3d", "Cal. 4th", "U. S. C.", "U.S.", "A.D.3d", "A. 2d", "Misc. 2d", "L. Ed.", "12", "at", "App. Term", "B. R."]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))) for _ in range(400)]

    def in_order(text):
        for written, to in style.REPORTERS:
            pattern = style._pattern(written).replace(r"\d", r"(\d)")
            text = re.sub(pattern, lambda m, to=to: to.replace("#", m[1]) if "#" in to else to, text)
        return text

    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string").select("i", style.restyle_reporters(F.col("t")).alias("t")).collect()
    assert {r.i: r.t for r in got} == {i: in_order(t) for i, t in enumerate(texts)}


def test_spans_hold_their_points(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), i, rng.randrange(4000)) for i in range(120)]
    spans = [(rng.randrange(3), i, (s := rng.randrange(4000)), s + rng.choice([0, 1, 40, 1500])) for i in range(60)]
    got = resolve.in_spans(spark.createDataFrame(points, "doc long, p long, at long"), spark.createDataFrame(spans, "doc long, s long, start long, end long"), "doc").collect()
    want = {(p, s) for (d, p, at), (e, s, a, b) in itertools.product(points, spans) if d == e and a <= at < b}
    assert sorted((r.p, r.s) for r in got) == sorted(want)


def test_null_flags_never_fire(spark):
    """A card whose flags are all null is unresolved, and nothing else is read from them."""
    kinds = "opinion_resolved boolean, lookup_status int, no_results boolean, outside_coverage boolean, finding string, override boolean, name_cite_ok boolean, docket_source boolean, reporter_style boolean, pincite_given boolean, pincite_found boolean, unpaginated boolean, quote_marks boolean, proposition string, adverse boolean, quote_matched boolean, supports boolean, score double, inextractability double, opinion_chars int, application string, treatment string, nested boolean, url string, quotes array<struct<result:string,confirmed:boolean,licensed:boolean,alterations_only:boolean,clean:boolean,brackets:int,ellipses:int>>"
    n = len(kinds.split(", "))
    flat = spark.createDataFrame([tuple([None] * n), (True, *[None] * (n - 1))], kinds).select("nested", "opinion_resolved", "url", *severity.card())
    rows = [(r.identity.status, r.quote.status, r.support.status, r.treatment.status) for r in flat.collect()]
    assert rows == [("not_found", "no_quote", "unable", "not_checked"), ("confirmed", "no_quote", "no_proposition", "not_checked")]
