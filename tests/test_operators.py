"""Golden pairs, boundaries and properties of operators."""

import re
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketloom.functions import dates, normalize, style
from docketloom.operators import dedup, grade, graph, match, quotes, resolve, segment

# Examples of the restyling rules.
GOLDEN = [
    ("People v. Wilkins, 37 N.Y.3d 371 (2021)", "People v Wilkins, 37 NY3d 371 [2021]"),
    ("Matter of Cornell Univ. v. Beer, 16 A.D.3d 890 (3d Dept 2005)", "Matter of Cornell Univ. v Beer, 16 AD3d 890 [3d Dept 2005]"),
    ("Matter of DeOca, 75 Misc. 3d 449 (Sur Ct, Erie County 2022)", "Matter of DeOca, 75 Misc 3d 449 [Sur Ct, Erie County 2022]"),
    ("People v. Ramos, 90 N.Y.2d 490, 495 (1997)", "People v Ramos, 90 NY2d 490, 495 [1997]"),
    ("Matter of Sayeh R., 91 N.Y.2d 306, 316-17 (1997)", "Matter of Sayeh R., 91 NY2d 306, 316-317 [1997]"),
    ("Chrysafis v. Marks, 15 F.4th 208 (2d Cir 2021)", "Chrysafis v Marks, 15 F4th 208 [2d Cir 2021]"),
    ("Metcalf v. Fitzgerald, 333 Conn. 1, 214 A.3d 361 (2019)", "Metcalf v Fitzgerald, 333 Conn 1, 214 A3d 361 [2019]"),
    ("Ohralick v. Ohio State Bar Assn., 436 U.S. 447 (1978)", "Ohralick v Ohio State Bar Assn., 436 US 447 [1978]"),
    ("Mavrovich v. Vanderpool, 427 F. Supp. 2d 1084 (D Kan 2006)", "Mavrovich v Vanderpool, 427 F Supp 2d 1084 [D Kan 2006]"),
]


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


def test_restyling(spark):
    rows = spark.createDataFrame(GOLDEN, "a string, want string").select(style.restyle(F.col("a")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_style_issues(spark):
    got = one(spark, style.issues(F.col("a")), a="See, Smith v. Jones, 37 N.Y.3d 371, 316-17 (2021); 5 NY3d 1, 6 NYS2d 2 supra")
    assert {x.issue for x in got} == {"periods_in_ny_reporter", "versus_period", "date_in_parens", "comma_after_signal", "improper_ny_parallel", "supra_shortform", "truncated_page_range"}
    assert one(spark, style.issues(F.col("a")), a="see Smith v Jones, 37 NY3d 371 [2021]") == []


@pytest.mark.parametrize("text,want", [
    ("Tuesday, March 17, 2026", [(2026, 3, 17, 1)]),
    ("on 3/17/26 (Tuesday)", [(2026, 3, 17, 1)]),
    ("2026.03.17 filed", [(2026, 3, 17, None)]),
    ("February 29, 2023", [(2023, 2, 29, None)]),
    ("nothing here", []),
])
def test_date_mentions(spark, text, want):
    got = one(spark, dates.mentions(F.col("a"), 2026), a=text)
    assert [(m.year, m.month, m.day, m.claimed) for m in got] == want


def test_real_dates(spark):
    rows = spark.createDataFrame([(2024, 2, 29), (2023, 2, 29), (2023, 13, 1)], "y int, m int, d int").select(dates.real_date(F.col("y"), F.col("m"), F.col("d")).isNotNull().alias("ok")).collect()
    assert [r.ok for r in rows] == [True, False, False]


@pytest.mark.parametrize("text", ["“Smart” — quotes", "plain", "a*b_c  d", ""])
def test_folds_are_idempotent(spark, text):
    once = one(spark, normalize.duplicate_fold(F.col("a")), a=text)
    assert one(spark, normalize.duplicate_fold(F.col("a")), a=once) == once
    assert len(one(spark, normalize.fold(F.col("a")), a=text)) == len(text)


def test_names(spark):
    assert one(spark, normalize.case_name_key(F.col("a")), a="Beal Sav. Bank v. Sommer, 8 N.Y.3d 318") == "beal sav bank sommer"
    assert one(spark, normalize.reporter_family(F.col("a")), a="917 F. Supp. 2d 1275") == "fsupp"
    assert one(spark, normalize.ocr_fold(F.col("a")), a="modern 1O l9") == "modem 10 19"
    assert one(spark, normalize.needle(F.col("a")), a="“[T]he part[y] … [word] said”") == '"the party said"'
    assert one(spark, normalize.haystack(F.col("a")), a="The *688 party—[12] said") == "the party said"


@pytest.mark.parametrize("gap,ok", [(80, True), (81, False)])
def test_bracket_gap(spark, gap, ok):
    hay = "the first segment" + "x" * gap + "the second segment"
    segs = quotes.segments(F.col("q"))
    assert (one(spark, quotes.in_order(segs, F.col("h")), q="The first segment[and]the second segment", h=hay) is not None) == ok
    assert one(spark, quotes.in_order(segs, F.col("h")), q="The first segment...the second segment", h=hay) is not None


def test_grades(spark):
    rows = spark.createDataFrame([(0.86, 0.98, False), (0.85, 1.0, False), (0.86, 0.97, False), (0.72, 0.0, True), (0.71, 0.0, True), (0.6, 0.0, False), (0.59, 1.0, True)], "r double, w double, l boolean")
    got = [r.g for r in rows.select(quotes.grade(F.col("r"), F.col("w"), F.col("l")).alias("g")).collect()]
    assert got == ["VERBATIM", "CLOSE", "CLOSE", "VERBATIM", "CLOSE", "CLOSE", "FABRICATED"]


@settings(max_examples=50, deadline=None)
@given(st.text("abc ", min_size=8, max_size=40), st.text("abcd ", max_size=120))
def test_exact_windows_score_one(needle, around):
    assert quotes.best_window(needle, needle)[0] == 1.0
    ratio, at = quotes.best_window(needle, around)
    assert 0 <= ratio <= 1 and (not around or ratio >= SequenceMatcher(None, needle, around[: len(needle)], autojunk=False).ratio() - 1e-9 or ratio > 0.98)


@settings(max_examples=100, deadline=None)
@given(st.text("aA .1\n", max_size=80))
def test_masks_and_sentences(text):
    masked = segment.mask_citations(text + "37 F.3d 371")
    assert len(masked) == len(text) + 11 and masked.count("\n") == text.count("\n")
    spans = segment.sentence_spans(text)
    assert all(a < b for a, b in spans) and all(spans[i][1] <= spans[i + 1][0] for i in range(len(spans) - 1))
    assert re.sub(r"\s", "", "".join(text[a:b] for a, b in spans)) == re.sub(r"\s", "", text)


def test_abbreviations_end_no_sentence():
    text = "Smith v. Jones was cited. See id. at 5. It held."
    assert [text[a:b] for a, b in segment.sentence_spans(text)] == ["Smith v. Jones was cited.", "See id. at 5.", "It held."]


def test_chunks_and_batches(spark):
    assert one(spark, segment.chunks(F.col("a"), 10), a="aaaa\n\nbbbb\n\ncccccccccccc\n\n\n\nd") == ["aaaa\n\nbbbb", "cccccccccccc", "d"]
    keys = F.array(*(F.lit("k" * 10) for _ in range(7)))
    assert one(spark, segment.batches(keys, 3, 1000)) == [0, 0, 0, 1, 1, 1, 2]
    assert one(spark, segment.batches(keys, 100, 25)) == [0, 0, 1, 1, 2, 2, 3]


def test_numbering():
    nodes = ["d", "a", "b", "c"]
    edges = [("a", "b"), ("b", "d"), ("a", "c")]
    numbers = graph.number(nodes, edges)
    assert numbers == {"a": 1, "b": 2, "d": 3, "c": 4} and all(numbers[x] < numbers[y] for x, y in edges)
    with pytest.raises(ValueError):
        graph.number(["a", "b"], [("a", "b"), ("b", "a")])


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r.root, r.node): r.depth for r in graph.closure(edges, spark.createDataFrame([(1,)], "root long"), 2).collect()}
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2}
    assert [r.path for r in graph.cycles(edges).collect()] == ["1 -> 2 -> 3 -> 1"]


def test_three_valued_flags(spark):
    base = {"opinion_resolved": True, "override": None, "proposition": "p", "quote_matched": None, "opinion_chars": 900, "name_cite_ok": None, "pincite_given": True, "pincite_found": None, "unpaginated": None, "adverse": None, "supports": True, "score": 0.9, "inextractability": 0.1, "body_only": None, "application": None}
    cases = [({}, "verified"), ({"name_cite_ok": False}, "identity_unconfirmed"), ({"pincite_found": False}, "pincite_not_found"), ({"pincite_found": False, "unpaginated": True}, "pincite_unconfirmed"), ({"score": 0.8}, "verified"), ({"score": 0.79}, "somewhat"), ({"score": 0.5}, "flagged"), ({"opinion_chars": 399}, "flagged"), ({"opinion_chars": 400}, "verified"), ({"inextractability": 0.7}, "does_not_support"), ({"quote_matched": True, "inextractability": 0.7}, "verified"), ({"opinion_resolved": None}, "unable"), ({"proposition": " "}, "prop_not_extracted")]
    types = {"proposition": "string", "application": "string", "opinion_chars": "int", "score": "double", "inextractability": "double"}
    schema = ", ".join(f"{k} {types.get(k, 'boolean')}" for k in base)
    rows = spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema).select(grade.verdict().alias("v")).collect()
    assert [r.v for r in rows] == [v for _, v in cases]


def test_court_weights(spark):
    names = ["Supreme Court of the United States", "Supreme Court, Kings County", "Supreme Court of Iowa", "Court of Criminal Appeals of Texas", "Court of Criminal Appeals", "Court of Appeals for the Fifth Circuit", "Court of Appeals of Ohio", "District Court", "", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(grade.court_weight(F.col("n"), F.lit(None).cast("string")).alias("w")).collect()
    assert [r.w for r in rows] == [100, 40, 90, 90, 70, 80, 70, 50, 60, 60]


@pytest.mark.parametrize("distance,found", [(250, 1), (251, 0)])
def test_range_join_reach(spark, distance, found):
    a = spark.createDataFrame([("x", 1, 1000)], "by string, id long, pos long")
    b = spark.createDataFrame([("x", 2, 1000 + distance)], "by string, id long, pos long")
    assert match.within(a, b, "by", 250).count() == found


def test_span_merge_chains(spark):
    spans = spark.createDataFrame([(1, "A", s) for s in (0, 8, 9, 17, 18, 40)], "doc_id long, name string, start long")
    assert sorted(r.start for r in dedup.merge_spans(spans).collect()) == [0, 9, 18, 40]


def test_doubled(spark):
    rows = spark.createDataFrame([("a b a b",), ("a b a c",), ("a",), ("a a",)], "t string").select(dedup.doubled(F.col("t")).alias("d")).collect()
    assert [r.d for r in rows] == [True, False, False, True]


def test_lookup_map_takes_the_greatest_of_equal_places(spark):
    rows = [("a", 404, 1, "x"), ("a", 200, 7, "z"), ("a", 200, 5, "999"), ("a", 200, 5, "1749"), ("b", 300, 2, "q"), ("b", None, 2, "p"), ("", 200, 1, "y"), (None, 200, 1, "z")]
    for entries in (rows, rows[::-1]):
        got = resolve.lookup_map(spark.createDataFrame(entries, "key string, status int, pos long, value string").coalesce(1))
        assert {tuple(r) for r in got.collect()} == {("a", 200, 5, "999"), ("b", 300, 2, "q")}
