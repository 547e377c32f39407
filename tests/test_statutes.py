"""Sections that quotations may come from, and sentences that lost a mark."""

import pytest
from pyspark.sql import functions as F

from docketloom.operators import statutes as S

QUOTE = "“the quick passage of a statute that counts”"


def test_targets(spark):
    text = "Tex. Fam. Code § 1.01 " + "x" * 100 + " C " + "y" * 100 + " Tex. Gov't Code §§ 2.02; TEX. LOC. GOV'T CODE ANN. Section 3A.03 " + "z" * 700 + " Tex. Tax Code § 9.9"
    at = text.index(" C ")
    cites = [(1, 1, at, f"It says {QUOTE}", ""), (2, 1, at, "It says nothing", ""), (3, 1, None, f"{QUOTE} Tex. Penal Code § 4.04", None), (4, 2, 5, QUOTE, None), (5, 1, at, f"{QUOTE} Tex. Gov't Code § 2.02", None), (6, None, 3, QUOTE, None)]
    df = spark.createDataFrame(cites, "cite_id long, doc_id long, start long, proposition string, cite_text string")
    docs = spark.createDataFrame([(1, text), (2, None), (None, text)], "doc_id long, text string")
    got = {}
    for r in S.targets(df, docs).orderBy("cite_id", "rank").collect():
        got.setdefault(r.cite_id, []).append((r.code, r.section, r.distance == 0))
    assert got == {1: [("GV", "2.02", False), ("FA", "1.01", False), ("LG", "3A.03", False)], 3: [("PE", "4.04", True)], 5: [("GV", "2.02", True), ("FA", "1.01", False), ("LG", "3A.03", False)]}
    assert S.targets(df.where("cite_id = 3"), docs).first().urls == ["https://statutes.capitol.texas.gov/Docs/PE/htm/PE.4.htm", "https://law.justia.com/codes/texas/"]


def test_check(spark):
    body = "A person [h]ad to give “written notice” within ten days   of the injury. Acts 2019, ch. 1."
    rows = [(["a person had to give \"written notice\" within"], body, "(2015)"), (["A person had to give . . . ten days of the injury", "not in the text of the statute"], body, "x"), ([], body, None), (["anything at all of length"], None, "(2015)")]
    df = spark.createDataFrame(rows, "q array<string>, s string, c string")
    assert [(r.c.matched, r.c.total, r.c.later) for r in df.select(S.check(F.col("q"), F.col("s"), F.col("c")).alias("c")).collect()] == [(1, 1, [2019]), (1, 2, []), (0, 0, []), (0, 1, [])]


OPINION = "We hold that the notice must be given within ten days of the injury, and not later, in “all cases” that arise."


@pytest.mark.parametrize(
    ("proposition", "want"),
    [
        ('the notice must be given within ten days of the injury."', "the notice must be given within ten days of the injury."),
        ("[T]he notice must be given within ten days of the injury", "[T]he notice must be given within ten days of the injury"),
        ("The notice must be given within ten days of the injury", None),
        ('the notice must be given . . . and not later”', "the notice must be given . . . and not later"),
        ('and not later . . . the notice must be given”', None),
        ('the notice should be given within ten days”', None),
        ('within ten days”', None),
        ("", None),
    ],
)
def test_recovery(proposition, want):
    opinion = OPINION if not (want or "").endswith("injury.") else OPINION.replace("injury,", "injury.")
    assert S.recovered_quotation(proposition, opinion) == want


def test_recovery_of_nulls(spark):
    df = spark.createDataFrame([("x”", None), (None, "y"), ("[T]he notice must be given within ten days", OPINION)], "p string, o string")
    assert [r.r for r in df.select(S.recovered(F.col("p"), F.col("o")).alias("r")).collect()] == [None, None, "[T]he notice must be given within ten days"]
