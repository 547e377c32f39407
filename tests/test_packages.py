"""Generated packages, one that passes and one that fails for every check of every court."""

import io
import zipfile

import pytest

from docketloom.sources import packages as P

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style="", align="", bold=False, underline=False, tab=False, num=False, line=None):
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + (f'<w:jc w:val="{align}"/>' if align else "") + ('<w:numPr><w:numId w:val="1"/></w:numPr>' if num else "") + (f'<w:spacing w:line="{line}"/>' if line else "")
    run = ("<w:b/>" if bold else "") + ('<w:u w:val="single"/>' if underline else "")
    return f'<w:p><w:pPr>{props}</w:pPr><w:r><w:rPr>{run}</w:rPr>{"<w:tab/>" if tab else ""}<w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def table(*rows):
    grid = "".join("<w:gridCol/>" for _ in rows[0])
    return f"<w:tbl><w:tblGrid>{grid}</w:tblGrid>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"


STYLES = '<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Century Schoolbook"/><w:sz w:val="{size}"/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId="Heading1"><w:pPr><w:keepNext/><w:keepLines/><w:contextualSpacing w:val="0"/></w:pPr></w:style>'
NUMBERING = '<w:abstractNum><w:lvl w:ilvl="0"><w:pStyle w:val="Heading1"/></w:lvl></w:abstractNum>'
FOOTER = '<w:p><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:rPr><w:b/><w:smallCaps/><w:sz w:val="20"/></w:rPr></w:r></w:p>'
SECTION = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:bottom="1440" w:left="1440" w:right="1440"/></w:sectPr>'
HEADS = {
    "core": "",
    "federal": p("UNITED STATES DISTRICT COURT", align="center", bold=True) + p("SOUTHERN DISTRICT OF TEXAS", align="center"),
    "texas": p("CAUSE NO. 2024-1", align="center"),
    "business": p("CAUSE NO. 24-BC11A-0001", align="center"),
    "new_york": p("SUPREME COURT OF THE STATE OF NEW YORK") + p("COUNTY OF KINGS"),
}
COURT = {"core": "x", "federal": "Civil Action No. 4:24-cv-1", "texas": "IN THE DISTRICT COURT", "business": "THE BUSINESS COURT", "new_york": "Index No. 5/2024"}
BODY = [p("ARGUMENT", "Heading1"), p("The rule is plain. It holds.", line=480), p("an item", "ListParagraph", num=True)]
END = [p("Respectfully submitted,"), p("/s/ Ann Roe")]
CERTIFICATE = [p("CERTIFICATE OF SERVICE"), p("I served this on all."), p("/s/ Ann Roe", underline=True, tab=True)]


def parts(court="core", **changed):
    caption = table((p("ROE v. DOE"), p("§", align="center"), p(COURT[court])), (p("x"), p("§", align="center"), p("HARRIS COUNTY, TEXAS")))
    out = {"styles": STYLES.format(size=28 if court == "business" else 24), "numbering": NUMBERING, "footer1": FOOTER, "head": HEADS[court], "caption": caption, "body": "".join(BODY), "end": "".join(END), "certificate": "".join(CERTIFICATE), "section": SECTION}
    return out | changed


def package(given):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, tag in (("styles", "styles"), ("numbering", "numbering"), ("footer1", "ftr")):
            if given[name] is not None:
                z.writestr(f"word/{name}.xml", f"<w:{tag} {NS}>{given[name]}</w:{tag}>")
        body = "".join(given[k] for k in ("head", "caption", "body", "end", "certificate", "section"))
        z.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


BROKEN = {
    "heading_styles": {"styles": STYLES.format(size=24).replace("<w:keepNext/>", "")},
    "document_font": {"styles": STYLES.format(size=22)},
    "heading_numbering": {"body": p("II. ARGUMENT", "Heading1")},
    "numbering_config": {"numbering": None},
    "empty_paragraphs": {"body": "".join(BODY) + p(" ")},
    "body_spacing": {"body": p("Too close.", line=240)},
    "double_spaces": {"body": p("One.  Two.")},
    "footer": {"footer1": FOOTER.replace('"20"', '"24"')},
    "caption_table": {"caption": table((p("a"), p("b")))},
    "page_size": {"section": SECTION.replace("15840", "20160")},
    "list_paragraphs": {"body": p("an item", "ListParagraph")},
    "signature_block": {"end": p("Respectfully submitted,")},
    "certificate_signatures": {"certificate": p("CERTIFICATE OF SERVICE") + p("I served it.") + p("/s/ Ann Roe")},
    "underscore_lines": {"end": "".join(END) + p("______")},
    "certificate_content": {"certificate": p("CERTIFICATE OF CONFERENCE") + p("Nothing.") + p("/s/ Ann Roe", underline=True, tab=True)},
    "known_names": {"end": p("Respectfully submitted,") + p("/s/ Bob Stranger")},
}
OF_COURTS = {
    "federal": {"court_header": {"head": p("UNITED STATES DISTRICT COURT")}, "caption_sign": {"caption": table((p("A v. B"), p("x"), p("Case No. 1")))}, "caption_parties": {"caption": table((p("A"), p("§", align="center"), p("Case No. 1")))}, "caption_number": {"caption": table((p("A v. B"), p("§", align="center"), p("x")))}, "judge_preamble": {"body": p("To the Honorable Judge Roe")}},
    "texas": {"cause_number": {"head": p("NO. 5")}, "caption_court": {"caption": table((p("A v. B"), p("§", align="center"), p("HARRIS COUNTY, TEXAS")))}, "caption_county": {"caption": table((p("A v. B"), p("§", align="center"), p("IN THE DISTRICT COURT")))}},
    "business": {"cause_number": {"head": p("CAUSE NO. 5", align="center")}, "caption_court": {"caption": table((p("A"), p("§", align="center"), p("x")))}},
    "new_york": {"court_header": {"head": p("SUPREME COURT")}, "caption_number": {"caption": table((p("A"), p("b"), p("c")))}},
}


def statuses(spark, folder, rules):
    out = {}
    for r in P.checked(P.read_packages(spark, str(folder)), rules).collect():
        out.setdefault(r.path.rpartition("/")[2].removesuffix(".docx"), {})[r.check] = r.status
    return out


def test_core_checks(spark, tmp_path):
    (tmp_path / "good.docx").write_bytes(package(parts()))
    (tmp_path / "bad.docx").write_bytes(b"no package")
    for check, changed in BROKEN.items():
        (tmp_path / f"{check}.docx").write_bytes(package(parts(**changed)))
    rules = P.core(names=["Ann Roe"])
    got = statuses(spark, tmp_path, rules)
    assert set(got["good"].values()) == {"PASS"} and set(got["good"]) == set(BROKEN) and len(BROKEN) == 16
    for check in BROKEN:
        assert got[check][check] in ("FAIL", "WARN"), check
        assert [c for c, s in got[check].items() if s != "PASS"] == [check]
    assert got["bad"] == {"package BadZipFile": "FAIL"}
    totals = {r.path.rpartition("/")[2]: (r.passed, r.failed, r.ok) for r in P.report(P.checked(P.read_packages(spark, str(tmp_path)), rules)).collect()}
    assert totals["good.docx"] == (16, 0, True) and totals["page_size.docx"] == (15, 1, False) and totals["known_names.docx"] == (15, 0, True)


@pytest.mark.parametrize("court", sorted(OF_COURTS))
def test_courts(spark, tmp_path, court):
    (tmp_path / "good.docx").write_bytes(package(parts(court)))
    for check, changed in OF_COURTS[court].items():
        (tmp_path / f"{check}.docx").write_bytes(package(parts(court, **changed)))
    got = statuses(spark, tmp_path, P.COURTS[court]())
    assert set(got["good"].values()) == {"PASS"}, got["good"]
    for check in OF_COURTS[court]:
        assert got[check][check] != "PASS"
