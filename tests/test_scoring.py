"""Scores with failing scorers, JSON corpora, owners of quotations, profiles."""

import pytest

from docketloom.operators import citations, ledger, scoring
from docketloom.sources import corpora


def test_chunks_and_failures(spark):
    def fussy(propositions, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return scoring.lexical(propositions, texts)

    rows = [(1, "alpha beta", "alpha " + "x " * 3000 + "beta"), (2, "alpha beta", "bad text"), (3, "alpha", "alpha"), (4, None, "a"), (5, "alpha", None), (6, "", "alpha"), (7, "alpha", "")]
    frame = spark.createDataFrame(rows, "id long, proposition string, text string")
    assert {r.id: r.score for r in scoring.support(frame, fussy).collect()} == {1: 0.5, 2: None, 3: 1.0, 4: None, 5: None, 6: 0.0, 7: 0.0}
    assert {r.id: r.score for r in scoring.support(frame, scoring.lexical, None).collect()}[1] == 1.0
    assert "".join(scoring.pieces("ab cd " * 999, 100)) == "ab cd " * 999 and scoring.pieces("", 5) == [""] and max(map(len, scoring.pieces("x" * 50, 7))) == 7


def test_json_corpora(spark, tmp_path):
    (tmp_path / "sections.json").write_text('[{"sectionNumber": "101", "heading": "H", "crossRefs": ["102", "999", "102"]}, {"sectionNumber": "102"}]')
    sections = corpora.read_json(spark, str(tmp_path / "sections.json"), corpora.SECTIONS)
    assert [tuple(r) for r in corpora.cross_references(sections).collect()] == [("101", "102")]
    corpora.write_json(sections, str(tmp_path / "out"))
    assert spark.read.schema(corpora.SECTIONS).json(str(tmp_path / "out")).count() == 2
    (tmp_path / "terms.json").write_text('[{"term": "claim", "candidates": [{"section": "101", "definition": "d"}, {"section": "102"}]}]')
    assert corpora.candidates(corpora.read_json(spark, str(tmp_path / "terms.json"), corpora.TERMS)).count() == 2
    (tmp_path / "broken.json").write_text('[{"term": ')
    with pytest.raises(Exception):
        corpora.read_json(spark, str(tmp_path / "broken.json"), corpora.TERMS).collect()


def test_quote_owners():
    text = 'It said "the very words of it". Baker v. State, 100 F.3d 10; accord Cole v. State, 200 F.3d 20. Later Dunn v. State, 300 F.3d 30. Then "a second quotation". ' + "x " * 200 + "Ebb v. State, 1 U.S. 2."
    got = [(text[a:b].split()[0], s) for _, a, b, s in citations.quote_owners(text)]
    assert got == [("Baker", False), ("Cole", True)]


def test_profiles_and_ranks(spark):
    assert ledger.gather({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"c": 5, "e": 6}, "d": {"x": 1}}) == {"a": {"b": 1, "c": 5, "e": 6}, "d": {"x": 1}}
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("Critical",), ("review",), ("odd",), (None,)], "s string").select(ledger.severity_rank(F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == [1, 4, 5, 5]
    assert ledger.sample(spark.range(100), 7, seed=1).collect() == ledger.sample(spark.range(100).repartition(3), 7, seed=1).collect()
