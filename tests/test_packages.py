"""Word files read in detail and written whole."""

from __future__ import annotations

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import grids as G
from paperloom.sources import docx
from paperloom.sources.write_docx import Package, plain_grid, to_docx, widths

SPACES = f'xmlns:w="{docx.W[1:-1]}" xmlns:m="{docx.M[1:-1]}" xmlns:r="{docx.R[1:-1]}" xmlns:a="{docx.A[1:-1]}" xmlns:wp="{docx.WP[1:-1]}" xmlns:v="{docx.V[1:-1]}" xmlns:mc="{docx.MC[1:-1]}"'


def word_file(body: str, **parts: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {SPACES}><w:body>{body}</w:body></w:document>")
        for name, text in parts.items():
            z.writestr(name.replace("__", "/").replace("_xml", ".xml"), text)
    return out.getvalue()


def m(tag: str, *inside: str) -> str:
    return f"<m:{tag}>{''.join(f'<m:r><m:t>{x}</m:t></m:r>' if not x.startswith('<') else x for x in inside)}</m:{tag}>"


@pytest.mark.parametrize(("equation", "text"), [
    (m("f", m("num", "a+b"), m("den", "c")), "(a+b)/c"), (m("f", m("num", "12"), m("den", "x - y")), "12/(x - y)"), (m("f", m("num", "ab"), m("den", "2.5")), "ab/2.5"),
    (m("sSup", m("e", "x"), m("sup", "2")), "x^{2}"), (m("sSub", m("e", "H"), m("sub", "2")), "H_{2}"), (m("sSubSup", m("e", "x"), m("sub", "1"), m("sup", "2")), "x_{1}^{2}"),
    (m("rad", m("deg", "3"), m("e", "x")), "3√(x)"), (m("rad", m("deg"), m("e", "x")), "√(x)"),
    (m("d", '<m:dPr><m:begChr m:val="["/><m:endChr m:val=""/></m:dPr>', m("e", "a"), m("e", "b")), "[a, b"), (m("d", m("e", "a")), "(a)"),
    (m("bar", m("e", "AB")), "A̅B̅"), (m("func", m("fName", "sin"), m("e", "x")), "sinx"), (m("nary", "<m:naryPr><m:chr/></m:naryPr>", m("sub", "1"), m("e", "k")), "1k"),
])
def test_equations(equation, text):
    assert docx.parse_docx(word_file(f"<w:p><m:oMath>{equation}</m:oMath></w:p>"))[0]["text"] == text


@pytest.mark.parametrize(("refs", "lines"), [
    ('<w:headerReference w:type="default" r:id="r1"/><w:headerReference w:type="first" r:id="r2"/>', ["First page", "Body"]), ('<w:headerReference w:type="even" r:id="r2"/><w:headerReference w:type="default" r:id="r1"/>', ["Other pages", "Body"]),
    ('<w:headerReference w:type="even" r:id="r1"/>', ["Body"]), ("", ["Body"]), ('<w:headerReference w:type="first" r:id="none"/>', ["Body"]),
])
def test_header_of_the_first_page(refs, lines):
    head = lambda text: f"<w:hdr {SPACES}><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:hdr>"
    rels = '<Relationships><Relationship Id="r1" Target="header1.xml"/><Relationship Id="r2" Target="/word/header2.xml"/></Relationships>'
    data = word_file(f"<w:p><w:r><w:t>Body</w:t></w:r></w:p><w:sectPr>{refs}</w:sectPr>", **{"word__header1_xml": head("Other pages"), "word__header2_xml": head("First page"), "word___rels/document_xml.rels": rels})
    assert [b["text"] for b in docx.parse_docx(data)] == lines


def test_alternates_hold_one_picture_and_symbols_are_characters():
    shape = '<w:r><mc:AlternateContent><mc:Choice><w:drawing><wp:anchor><wp:extent cx="127000" cy="63500"/>{}</wp:anchor></w:drawing></mc:Choice><mc:Fallback><w:pict><v:shape style="width:10pt;height:5pt"><v:imagedata r:id="r9"/></v:shape></w:pict></mc:Fallback></mc:AlternateContent></w:r>'
    none = '<w:r><mc:AlternateContent><mc:Choice><w:drawing/></mc:Choice><mc:Fallback><w:pict/></mc:Fallback></mc:AlternateContent></w:r>'
    body = f'<w:p>{shape.format("<a:blip r:embed=" + chr(34) + "r8" + chr(34) + "/>")}</w:p><w:p>{shape.format("")}</w:p><w:p>{none}</w:p><w:p><w:r><w:sym w:char="00B0"/></w:r></w:p>'
    a, b, c, d = docx.parse_docx(word_file(body))
    assert [(p["rid"], p["width"], p["height"]) for p in a["pictures"] + b["pictures"]] == [("r8", 10.0, 5.0), ("r9", 10.0, 5.0)]
    assert (a["shapes"], b["shapes"], c["shapes"], c["images"], d["text"]) == (0, 0, 1, 0, "°")


def borders(tag: str, **sides: str) -> str:
    return f"<w:{tag}>{''.join(f'<w:{k} w:val={chr(34)}{v}{chr(34)}/>' for k, v in sides.items())}</w:{tag}>"


@pytest.mark.parametrize(("props", "cell", "bordered"), [
    ("<w:tblPr>" + borders("tblBorders", top="nil", left="none") + "</w:tblPr>", "", False), ("<w:tblPr>" + borders("tblBorders", top="nil", left="single") + "</w:tblPr>", "", True), ("<w:tblPr><w:tblBorders/></w:tblPr>", "", True),
    ("<w:tblPr/>", "", False), ("", "", True), ('<w:tblPr><w:tblStyle w:val="TableGrid"/></w:tblPr>', "", True), ('<w:tblPr><w:tblStyle w:val="TableNormal"/></w:tblPr>', "", False), ('<w:tblPr><w:tblStyle w:val="Fancy"/></w:tblPr>', "", True),
    ("<w:tblPr/>", borders("tcBorders", bottom="single"), True), ("<w:tblPr/>", borders("tcBorders", bottom="nil"), False),
])
def test_borders(props, cell, bordered):
    table = docx.parse_docx(word_file(f"<w:tbl>{props}<w:tr><w:tc><w:tcPr>{cell}</w:tcPr><w:p/></w:tc></w:tr></w:tbl>"))[0]
    assert table["grid"]["bordered"] is bordered


def test_widths_as_columns_and_in_the_writer(spark):
    cases = [([], 3, 9000), ([], 6, 9000), ([100, 200], 2, 9000), ([100, 200], 3, 9000), ([9000, 3000], 2, 6000), ([], 1, 500)]
    rows = spark.createDataFrame(cases, "declared array<int>, n int, most int")
    got = [list(r[0]) for r in rows.select(G.widths(F.col("declared"), F.col("n"), F.col("most"))).collect()]
    assert got == [widths(*c) for c in cases] == [[1800] * 3, [1500] * 6, [100, 200], [1800] * 3, [4500, 1500], [500]]


def test_a_paper_with_tables_and_pictures(spark, tmp_path):
    grid = {"cols": [1000, 2000, 3000], "bordered": True, "cells": []}
    for row, cells in enumerate([[(2, "restart", "wide"), (1, None, "r")], [(1, None, ""), (1, "restart", "down"), (1, None, "x\ty")], [(1, None, "z"), (1, "continue", ""), (1, None, "end & <co>")]]):
        grid["cells"] += [{"row": row, "cell": k, "span": s, "merged": g, "bordered": None, "paragraphs": [{"text": t, "align": "center", "runs": None, "pictures": [{"target": "media/a.png", "width": 20.0, "height": 10.0}] if t == "z" else None}]} for k, (s, g, t) in enumerate(cells)]
    schema = f"paper_id string, seq int, style string, indent int, keep_next boolean, text string, pictures array<struct<target:string,width:double,height:double>>, grid {docx.GRID.replace(docx.PICTURES, 'array<struct<target:string,width:double,height:double>>')}"
    plan = [("p", 1, "heading", 0, True, "ON TOP", None, None), ("p", 2, "table", 360, False, "", None, grid), ("p", 3, "table", 0, False, "a\tb\nc\td", None, None), ("p", 4, "figure", 0, False, "Fig.\x01￾ 1\nsecond", [{"target": "media/b.jpeg", "width": 30.0, "height": None}, {"target": "media/none.png", "width": 1.0, "height": 1.0}], None), ("q", 1, None, None, None, None, None, None)]
    media = spark.createDataFrame([("p", "media/a.png", b"one"), ("p", "media/b.jpeg", b"two"), ("p", "media/unused.png", b"three"), ("r", "media/a.png", b"x")], "paper_id string, target string, content binary")
    made = to_docx(spark.createDataFrame(plan, schema), media)
    files = {r.paper_id: bytes(r.content) for r in made.collect()}
    assert files.keys() == {"p", "q"} and files == {r.paper_id: bytes(r.content) for r in made.collect()}
    names = zipfile.ZipFile(io.BytesIO(files["p"])).namelist()
    assert {n for n in names if "media" in n} == {f"word/media/{hashlib.sha1(c).hexdigest()}.{k}" for c, k in ((b"one", "png"), (b"two", "jpg"))}
    (tmp_path / "p.docx").write_bytes(files["p"])
    (tmp_path / "broken.docx").write_bytes(b"PK no")
    blocks, parts = docx.read_whole(spark.read.format("binaryFile").load(str(tmp_path)), with_media=True)
    assert blocks.where("kind = 'error'").count() == 1 and docx.media(parts).count() == 2
    rows = {r.block_pos: r for r in blocks.where("kind <> 'error'").collect()}
    assert [rows[k].kind for k in range(4)] == ["p", "table", "table", "p"] and rows[0].style == "heading" and rows[0].bold and rows[0].keep_next and rows[0].align == "center"
    assert rows[2].cells == [["a", "b"], ["c", "d"]] and rows[3].text == "Fig. 1\nsecond" and [p.height for p in rows[3].pictures] == [100.0]
    placed = {(r.row, r.cell): (r.col, r.span, r.down, r.width, r.bordered) for r in G.placed(G.cells_of(blocks.where("block_pos = 1")), ("paper_id", "block_pos"), 10128, "cols").collect()}
    assert placed == {(0, 0): (0, 2, 1, 3000, True), (0, 1): (2, 1, 1, 3000, True), (1, 0): (0, 1, 1, 1000, True), (1, 1): (1, 1, 2, 2000, True), (1, 2): (2, 1, 1, 3000, True), (2, 0): (0, 1, 1, 1000, True), (2, 1): (1, 1, 0, 2000, True), (2, 2): (2, 1, 1, 3000, True)}
    again = G.rebuilt(G.cells_of(blocks.where("block_pos = 1"))).first().grid
    texts = lambda cells: [(c["row"], c["cell"], c["span"], c["merged"], [p["text"] for p in c["paragraphs"]]) for c in cells]
    assert texts(again["cells"]) == texts(grid["cells"]) and again["cols"] == grid["cols"]
    light, parts = docx.read_whole(spark.read.format("binaryFile").load(str(tmp_path)))
    assert docx.media(parts).count() == 0 and docx.styles(parts).count() > 5 and light.count() == 5


def test_styles_and_parts_that_the_format_needs():
    data = Package({}).build([{"style": "or", "indent": 0, "keep_next": True, "text": "OR", "stops": None}, {"style": "table", "indent": 0, "keep_next": False, "text": "x", "grid": plain_grid("x")}])
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert {"[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/styles.xml", "word/footer1.xml", "word/_rels/document.xml.rels"} == set(z.namelist())
        body = z.read("word/document.xml").decode()
    assert body.index("<w:tbl>") < body.index("<w:sectPr>") and "w:pgBorders" in body and '<w:jc w:val="center"/>' in body


def test_a_paper_goes_through_whole(spark, tmp_path):
    """Read, classified, laid out and written again: runs, pictures, spanning tables, stops and marks are there."""
    from paperloom.operators import papers as P
    from paperloom.operators import render as V

    flags = ("bold", "italic", "underline", "sup", "sub", "highlight")
    run = lambda text, *on: {"text": text} | {f: f in on for f in flags}
    cells = [{"row": r, "cell": k, "span": s, "merged": None, "bordered": None, "paragraphs": [{"text": t, "align": None, "runs": None, "pictures": None}]} for r, k, s, t in [(0, 0, 2, "Rainfall"), (1, 0, 1, "May"), (1, 1, 1, "12 mm")]]
    picture = "array<struct<target:string,width:double,height:double>>"
    schema = f"paper_id string, seq int, style string, indent int, keep_next boolean, text string, runs {docx.RUN}, pictures {picture}, grid {docx.GRID.replace(docx.PICTURES, picture)}"
    lines = [("LAKE PUBLIC SCHOOL", None, None, None), ("ANNUAL EXAMINATION 2025-26", None, None, None), ("Class: VI\tSubject: Science\tMarks: 5", None, None, None), ("Section A (5 marks)", None, None, None), (None, [run("1. Why does "), run("ice", "bold"), run(" float in H"), run("2", "sub"), run("O? 2M")], None, None), ("", None, [{"target": "media/a.png", "width": 900.0, "height": 90.0}], None), ("2. Read the table. 3M", None, None, None), ("", None, None, {"cols": [2000, 2000], "bordered": True, "cells": cells})]
    plan = [("p", k, "table" if g else "question", 0, False, t, r, p, g) for k, (t, r, p, g) in enumerate(lines)]
    media = spark.createDataFrame([("p", "media/a.png", b"ice")], "paper_id string, target string, content binary")
    (tmp_path / "in").mkdir()
    for r in to_docx(spark.createDataFrame(plan, schema), media).collect():
        (tmp_path / "in" / "p.docx").write_bytes(r.content)
    blocks, parts = docx.read_whole(spark.read.format("binaryFile").load(str(tmp_path / "in")), with_media=True)
    found = P.lines(blocks)
    header = P.headers(found, r"(?i)public school")
    items = P.items(found, header).cache()
    made = V.with_looks(V.whole(header, items, P.entries(items), "LAKE PUBLIC SCHOOL"), blocks, docx.relations(parts))
    again, more = docx.read_whole(to_docx(made, docx.media(parts)).select(F.col("paper_id").alias("path"), "content"), with_media=True)
    rows = {r.text: r for r in again.where("kind = 'p'").collect()}
    stem = rows["1.\tWhy does ice float in H2O?\t2M"]
    assert [(r.text, [f for f in flags if r[f]]) for r in stem.runs] == [("1.\tWhy does ", []), ("ice", ["bold"]), (" float in H", []), ("2", ["sub"]), ("O?\t2M", [])]
    assert list(stem.stops) == [10488] and stem.style == "question" and stem.indent == 360
    shown = next(r for r in again.collect() if r.images)
    assert round(shown.pictures[0].width) == 464 and round(shown.pictures[0].height) == 46 and [bytes(r.content) for r in docx.media(more).collect()] == [b"ice"]
    table = again.where("kind = 'table'").first()
    assert [(c.row, c.cell, c.span, c.paragraphs[0].text) for c in table.grid.cells] == [(0, 0, 2, "Rainfall"), (1, 0, 1, "May"), (1, 1, 1, "12 mm")] and table.grid.bordered
