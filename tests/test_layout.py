"""Lines and runs from positioned spans."""

from docketloom.operators import layout

SPAN = "doc_id long, page int, i int, block int, x0 double, x1 double, y double, text string, font string, size double, bold boolean, italic boolean, width double"


def spans(spark, rows):
    return spark.createDataFrame([(d, p, i, 0, float(x), float(x + w), float(y), t, f, float(s), b, it, 600.0) for i, (d, p, x, w, y, t, f, s, b, it) in enumerate(rows)], SPAN)


def test_lines_and_runs(spark):
    rows = [
        (1, 1, 50, 10, 100.0, "R", "ABCDEF+Times-Bold", 14, True, False),
        (1, 1, 60, 60, 101.5, "ESPONDENT", "Times,Bold", 10, True, None),
        (1, 1, 130, 20, 100.5, "says", "Times", 10, None, False),
        (1, 1, 150.5, 9, 100.5, "so", "Times", 10, False, False),
        (1, 1, 50, 30, 103.6, "next ", "Times", 10, False, True),
        (1, 1, 90, 30, 105.0, "line", "Times", 10, False, False),
        (1, 2, 50, 30, 100.0, "other", "Times", 10, False, False),
        (1, 2, 50, 30, 400.0, None, "Times", 10, False, False),
        (2, 1, 50, 30, 100.0, "A", "Times", 10, False, False),
        (2, 1, 90, 30, 100.0, "B", "Arial", 8, False, False),
    ]
    df = spans(spark, rows)
    got = {(r.doc_id, r.page, r.line): r.text for r in layout.line_texts(df).collect()}
    assert got == {(1, 1, 0): "RESPONDENT saysso", (1, 1, 1): "next line", (1, 2, 0): "other", (2, 1, 0): "A B"}
    runs = {(r.doc_id, r.page, r.line, r.run): (r.text, r.bold, r.italic, r["size"]) for r in layout.style_runs(df).collect()}
    assert runs[1, 1, 0, 0] == ("RESPONDENT", True, False, 10.0) and runs[1, 1, 0, 1] == (" saysso", False, False, 10.0)
    assert runs[1, 1, 1, 0] == ("next ", False, True, 10.0) and len(runs) == 7


def test_kinds(spark):
    page = lambda d, p, font, texts, xs=(50,): [(d, p, x, 100, 100 + 20 * k, t, font, 10, False, False) for x in xs for k, t in enumerate(texts)]
    rows = page(1, 1, "Courier New", ["· 1 · Q. Where", "· 2 · A. There"]) + page(1, 2, "Times", ["x"]) + page(2, 1, "Times", ["Q. why"]) + page(3, 1, "LiberationMono", ["no marks"])
    df = spans(spark, rows)
    assert {r.doc_id: r.kind for r in layout.document_types(df).collect()} == {1: "deposition", 2: "general", 3: "general"}
    both = spark.createDataFrame([(4, 1, i, i, 40.0 + 300 * (i % 2), 240.0 + 300 * (i % 2), 100.0, "x", None, 10.0, None, None, 600.0) for i in range(4)], SPAN)
    assert layout.document_types(both).first().kind == "two-column"
    assert layout.document_types(df.where("false")).count() == layout.line_texts(df.where("false")).count() == 0
