import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.operators import handoffs, office

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="{}"/><Relationship Id="r2" Target="{}"/></Relationships>'


def package(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in ({"[Content_Types].xml": "<x/>", "_rels/.rels": "<x/>"} | parts).items():
            z.writestr(name, text)
    return out.getvalue()


DOCX = package({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body><w:p><w:r><w:t>Before</w:t></w:r></w:p><w:p><w:pPr><w:pStyle w:val="Heading 2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a|b</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
PPTX = package({"ppt/presentation.xml": f'<p:p xmlns:p="x" xmlns:r="{R}"><p:sldId r:id="r2"/><p:sldId r:id="r1"/></p:p>', "ppt/_rels/presentation.xml.rels": RELS.format("slides/s1.xml", "slides/s2.xml"), "ppt/slides/s1.xml": f'<s xmlns:a="{A}"><a:p><a:r><a:t>one</a:t></a:r></a:p></s>', "ppt/slides/s2.xml": f'<s xmlns:a="{A}"><a:p><a:r><a:t>two</a:t></a:r></a:p></s>'})
XLSX = package({"xl/workbook.xml": f'<w xmlns:r="{R}"><sheets><sheet name="S" r:id="r1"/><sheet name="E" r:id="r2"/></sheets></w>', "xl/_rels/workbook.xml.rels": RELS.format("worksheets/a.xml", "worksheets/b.xml"), "xl/sharedStrings.xml": "<sst><si><t>name</t></si></sst>", "xl/worksheets/a.xml": '<w><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row></sheetData></w>', "xl/worksheets/b.xml": "<w/>"})


def test_office(spark):
    rows = [("d", DOCX, "docx"), ("p", PPTX, "pptx"), ("x", XLSX, "xlsx"), ("bad", b"PK\x03\x04junk", "docx"), ("none", None, "xlsx"), ("other", PPTX, "docx"), ("kind", DOCX, "odt")]
    files = spark.createDataFrame(rows, "path string, content binary, kind string")
    got = {(r.doc, r.anchor_kind, r.anchor_value): (r.content, r.code) for r in office.office_parts(files, "path", "content", "kind").collect()}
    assert got["d", "section", "1"] == ("Before", None) and got["d", "section", "2"][0] == "## Title\n\n| a\\|b |  |\n| --- | --- |\n| c |  |"
    assert got["p", "slide", "1"][0] == "two" and got["p", "slide", "2"][0] == "one"
    assert got["x", "sheet", "1"][0] == "## S\n\n| name |  | =1+1 |\n| --- | --- | --- |" and got["x", "sheet", "2"][0] == "## E"
    assert all(got[k, None, None] == (None, "malformed_input") for k in ("bad", "none", "other", "kind"))
    types = {r.path: r.t for r in files.select("path", office.ooxml_media_type(F.col("content")).alias("t")).collect()}
    assert types["d"].endswith("document") and types["x"].endswith("sheet") and types["bad"] is None and types["none"] is None
    ok = spark.createDataFrame([(b"%PDF-1", "application/pdf"), (b"<html>", "text/html"), (b"x", "text/html"), (b"x", "video/mp4")], "c binary, m string").select(office.rendered_bytes_valid(F.col("c"), F.col("m")).alias("ok"))
    assert [r.ok for r in ok.collect()] == [True, True, False, False]


def test_handoffs(spark):
    attempt = "struct<input_sha256:string,extractor_id:string,extractor_version:string,config_sha256:string,prerequisite_digest:string>"
    asked = spark.createDataFrame([("h1", ("i", "e", "1", "c", None), ["page"]), ("h2", ("i", "e", "1", "c", None), ["page"])], f"handoff_id string, attempt {attempt}, required_kinds array<string>")
    given = spark.createDataFrame([("h1", ("i", "e", "1", "c", None), [("line", "1")]), ("h2", ("i", "e", "2", "c", None), [("page", "1")]), ("h3", None, None)], f"handoff_id string, attempt {attempt}, anchors array<struct<kind:string,value:string>>")
    assert {tuple(r) for r in handoffs.extraction_problems(given, asked).collect()} == {("h1", "anchor_kind_missing"), ("h2", "attempt_changed"), ("h3", "handoff_unknown")}
    records = spark.createDataFrame([("s", "needs_agent", ("i", "e", "1", "c", None)), ("t", "needs_agent", ("i", "f", "1", "c", None)), ("u", "ok", None)], f"source_id string, state string, last_attempt {attempt}")
    recipes = spark.createDataFrame([("e", "1", "c", None)], "extractor_id string, extractor_version string, config_sha256 string, prerequisite_digest string")
    assert {(r.source_id, r.code) for r in handoffs.open_handoffs(records, recipes).collect()} == {("s", None), ("t", "recipe_missing")}
    pages = spark.createDataFrame([("r", 0, None, "a"), ("r", 1, "a", "b"), ("r", 2, "x", None)], "run_id string, page int, request_cursor string, next_cursor string")
    assert [r.page for r in handoffs.cursor_breaks(pages).collect()] == [2]
    events = spark.createDataFrame([(1, "handoff", "s", "1", "h1"), (2, "gap", "s", "0", None), (3, "gap", "z", "1", None), (4, "handoff", "s", "1", "h9")], "sequence int, kind string, source_id string, record_sha256 string, handoff_id string")
    now = spark.createDataFrame([("s", "1")], "source_id string, record_sha256 string")
    assert {tuple(r) for r in handoffs.event_problems(events, now, asked).collect()} == {(2, "record_changed"), (3, "source_unknown"), (4, "handoff_not_one")}


def test_cursor():
    c = handoffs.encode_cursor(b"k", "run", 3)
    assert handoffs.decode_cursor(b"k", c) == ("run", 3)
    with pytest.raises(ValueError):
        handoffs.decode_cursor(b"other", c)
