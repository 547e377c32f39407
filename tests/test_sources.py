"""Files, Word packages, the paged source, the streaming ledger."""

import io
import zipfile


from docketloom.operators import citations, extract
from docketloom.sources import files
from docketloom.streaming import ledger

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def package(body: str, notes: str = "") -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
        if notes:
            z.writestr("word/footnotes.xml", f"<w:footnotes {NS}>{notes}</w:footnotes>")
    return out.getvalue()


def test_word_package(spark, tmp_path):
    p = lambda x, style="": f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr>{x}</w:p>'
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    body = p(run("Title"), "Heading1") + p(run("Text") + '<w:r><w:footnoteReference w:id="2"/></w:r>' + f"<w:del>{run('gone')}</w:del>" + run("more  words")) + p("")
    notes = f'<w:footnote w:id="2">{p(run("a note"))}</w:footnote>'
    (tmp_path / "a.docx").write_bytes(package(body, notes))
    (tmp_path / "b.docx").write_bytes(b"no package")
    rows = files.read_word(spark, str(tmp_path))
    got = {(r.path.rsplit("/", 1)[1], r.i): (r.style, r.text, r.error) for r in rows.collect()}
    assert got[("a.docx", 0)] == ("Heading1", "Title", None)
    assert got[("a.docx", 1)][1] == "Text a note. more  words"
    assert got[("b.docx", -1)][2] == "BadZipFile"
    checks = {r.check: r.status for r in files.word_checks(rows).collect()}
    assert checks == {"empty_paragraphs": "FAIL", "double_spaces": "WARN", "underscore_lines": "PASS", "heading_styles": "PASS", "signature_block": "WARN"}


def test_texts_and_sidecars(spark, tmp_path):
    (tmp_path / "x.md").write_text("a short text")
    (tmp_path / "y.txt").write_text("y")
    (tmp_path / "z.pdf").write_text("z")
    got = files.read_texts(spark, str(tmp_path))
    assert sorted(r.text for r in got.collect()) == ["a short text", "y"]
    side = spark.createDataFrame([("/s/x.txt", "native text of twenty or more"), ("/s/y.txt", "short")], "path string, text string")
    out = {r.path.rsplit("/", 1)[1]: (r.text, r.from_sidecar) for r in files.prefer_sidecar(got, side).collect()}
    assert out == {"x.md": ("native text of twenty or more", True), "y.txt": ("y", False)}


def fetch(page: int):
    return [(f"{page}-{i}", f'{{"page": {page}}}') for i in range(3)] if page < 4 else None


def test_paged_source(spark):
    spark.dataSource.register(files.PagedSource)
    df = spark.read.format("paged").option("fetch", "tests.test_sources:fetch").option("maxPages", "6").option("pagesPerPartition", "2").load()
    assert sorted(r.id for r in df.collect()) == [f"{p}-{i}" for p in range(4) for i in range(3)]


def failing(page: int):
    if page == 3:
        raise TimeoutError
    return fetch(page)


def test_what_a_paged_source_leaves_out_shows(spark):
    spark.dataSource.register(files.PagedSource)
    read = lambda name, most: spark.read.format("paged").option("fetch", f"tests.test_sources:{name}").option("maxPages", most).option("pagesPerPartition", "2").load().collect()
    assert [(r.page, r.note) for r in read("fetch", "3") if r.id is None] == [(3, "truncated")]
    assert [r.note for r in read("fetch", "4") if r.id is None] == []
    rows = read("failing", "6")
    assert [(r.page, r.note) for r in rows if r.id is None] == [(3, "failed: TimeoutError")] and {r.page for r in rows if r.id} == {0, 1, 2}


def test_sidecars_of_one_name_count_once(spark):
    got = spark.createDataFrame([("/a/x.md", "t")], "path string, text string")
    side = spark.createDataFrame([("/s/x.txt", "second of twenty letters"), ("/r/x.txt", "first of twenty letters")], "path string, text string")
    assert [r.text for r in files.prefer_sidecar(got, side).collect()] == ["first of twenty letters"]


def test_opinion_text(spark):
    rows = spark.createDataFrame([(" ", "<p>a &amp; b</p>"), ("plain", "<p>x</p>"), (None, None)], "plain string, html string")
    assert [r.t for r in rows.select(files.opinion_text("plain", "html").alias("t")).collect()] == ["a & b", "plain", None]


def test_ledger_batch_and_stream(spark, tmp_path):
    rows = [("f1", 1, "open"), ("f1", 3, "fixed"), ("f2", 2, "open")]
    events = spark.createDataFrame(rows, "id string, ts int, note string")
    got = {r.id: (r.latest.note, len(r.history)) for r in ledger.current(events, "id").collect()}
    assert got == {"f1": ("fixed", 2), "f2": ("open", 1)}
    src = str(tmp_path / "in")
    events.write.parquet(src)
    stream = spark.readStream.schema(events.schema).parquet(src)
    ledger.follow(stream, "id", str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination(120)
    assert {r.id: r.note for r in ledger.followed(spark, str(tmp_path / "out"), "id").collect()} == {"f1": "fixed", "f2": "open"}
    assert [r.id for r in ledger.remaining(events.select("id").distinct(), events.where("note = 'fixed'"), "id").collect()] == ["f2"]


def test_negated_verbs_are_no_treatment(spark):
    rows = [(1, "We do not overrule. 12 F.3d 4 was not overruled here."), (2, "12 F.3d 4 was overruled."), (3, "overruled " + "x" * 260 + " 12 F.3d 4")]
    pairs = spark.createDataFrame([(i, t, [], "12 F.3d 4") for i, t in rows], "id long, text string, tokens array<string>, cite string")
    got = {(r.id, r["class"], r.verb) for r in citations.treatments(pairs).collect()}
    assert got == {(2, "strong", "overruled")}


def test_citation_offsets(spark):
    texts = {1: "é See 37 N.Y.3d 371; Id. at 5; 5 U.S.C. § 552; 2020 WL 12345.", 3: "é See 37 N.Y.3d 371. “A quotation of some length,” Id. at 5."}
    docs = spark.createDataFrame([*texts.items(), (2, None)], "doc_id long, text string")
    rows = citations.citations(docs).orderBy("doc_id", "start").collect()
    assert [(r.doc_id, r.kind, texts[r.doc_id][r.start : r.end]) for r in rows] == [(1, "full", "37 N.Y.3d 371"), (1, "full", "2020 WL 12345"), (3, "full", "37 N.Y.3d 371"), (3, "id", "Id. at 5")]
    assert [r.key for r in rows] == ["37 ny3d 371", "2020 wl 12345", "37 ny3d 371", "37 ny3d 371"]  # an id. without a quotation folds into its antecedent
    assert [(r.doc_id, r.kind, r.reference) for r in citations.references(docs).collect()] == [(1, "statute", "U.S.C. § 552")]


def test_sections(spark):
    pages = spark.createDataFrame([("b", 1, "PJC 1.1\nshort"), ("b", 2, "PJC 1.1\n" + "long " * 60), ("b", 3, "PJC 1.2\nend")], "doc string, page int, text string")
    got = {r.section: (r.start_page, r.short) for r in extract.sections(pages).collect()}
    assert got == {"1.1": (2, False), "1.2": (3, True)}


