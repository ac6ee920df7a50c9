"""Word documents as tables: files in, a row per block out.

Files come through Spark's binaryFile source, so any store works; each is unpacked by the standard library in
its own row. Blocks keep their order in block_pos: header paragraphs below zero, the body from zero.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import stored

# Namespaces of the format.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"

WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
V = "{urn:schemas-microsoft-com:vml}"
MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: English metric units in a point.
EMU = 12_700

RUN = "array<struct<text:string,bold:boolean,italic:boolean,underline:boolean,sup:boolean,sub:boolean,highlight:boolean>>"
PICTURES = "array<struct<rid:string,width:double,height:double>>"
TEXTS = f"array<struct<text:string,align:string,runs:{RUN},pictures:{PICTURES}>>"
#: A table's declared column widths, whether it has borders, and its cells in order; merged: 'restart' or 'continue' for cells that span rows.
GRID = f"struct<cols:array<int>,bordered:boolean,cells:array<struct<row:int,cell:int,span:int,merged:string,bordered:boolean,paragraphs:{TEXTS}>>>"
NESTED = "array<struct<row:int,at:int,count:int,cells:array<array<string>>>>"
BLOCKS = f"paper_id string, block_pos int, kind string, text string, align string, bold boolean, images int, pictures {PICTURES}, shapes int, equations int, style string, num_id string, num_level int, runs {RUN}, indent int, keep_next boolean, stops array<int>, cells array<array<string>>, nested {NESTED}, grid {GRID}, floating boolean, error string"
PARTS = "paper_id string, part string, name string, target string, level int, format string, text string, start int, content binary"


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SRC-01: a listing without contents; the folder below path gives folder and class."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return files.select(
        F.col("path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"),
        F.regexp_extract("path", r"/Class-([IVX]+)/[^/]*$", 1).alias("sub"),
    )


# What parts of a fraction stand in parentheses for, and the character that draws a bar over the one before it.
TERMS, OVERLINE = "+-×÷ ", "\u0305"


def _math(node) -> str:
    """SRC-19: an equation in a line: fractions with a slash, powers and indices in braces, roots with their degree, delimiters as they are given, bars over each character."""
    tag = node.tag.removeprefix(M)
    if tag == "t":
        return node.text or ""
    if tag.endswith("Pr"):
        return ""
    part = {k: "".join(map(_math, node.findall(f"{M}{k}"))) for k in ("e", "num", "den", "sub", "sup", "deg")}
    term = lambda s: f"({s})" if any(c in s for c in TERMS) else s
    if tag == "f":
        return f"{term(part['num'])}/{term(part['den'])}"
    if tag in ("sSup", "sSub", "sSubSup"):
        return part["e"] + ("_{" + part["sub"] + "}" if "Sub" in tag else "") + ("^{" + part["sup"] + "}" if "Sup" in tag else "")
    if tag == "rad":
        return f"{part['deg']}√({part['e']})"
    if tag == "d":
        own = {k: x.get(f"{M}val") for k in ("begChr", "endChr") if (x := node.find(f"{M}dPr/{M}{k}")) is not None}
        return (own.get("begChr", "(") or "") + ", ".join(map(_math, node.findall(f"{M}e"))) + (own.get("endChr", ")") or "")
    if tag == "bar":
        return "".join(c + OVERLINE for c in part["e"])
    return "".join(map(_math, node))


def _flag(props, name: str) -> bool:
    """SRC-20: a run property that is there counts as on unless it says otherwise."""
    x = None if props is None else props.find(f"{W}{name}")
    return x is not None and x.get(f"{W}val", "true") not in ("0", "false", "none", "off")


def _points(style: str, name: str) -> float | None:
    value = dict(x.split(":", 1) for x in style.split(";") if ":" in x).get(name, "").strip()
    return float(value[:-2]) if value.endswith("pt") else None


def _walk(node, out: list, pictures: list, shapes: list, props=None) -> None:
    """SRC-15, SRC-18: (text, run properties) of a paragraph's runs in order; a line end for each break, a tab for each tab; pictures with their sizes in points, and shapes that hold none."""
    for x in node:
        if x.tag == f"{W}t":
            out.append((x.text or "", props))
        elif x.tag in (f"{W}tab", f"{W}ptab"):
            out.append(("\t", props))
        elif x.tag in (f"{W}br", f"{W}cr"):
            out.append(("\n", props))
        elif x.tag == f"{W}noBreakHyphen":
            out.append(("-", props))
        elif x.tag == f"{W}sym":
            out.append((chr(int(x.get(f"{W}char") or "20", 16)), props))
        elif x.tag == f"{MC}AlternateContent":  # the same thing twice: the first form that holds a picture, or else one shape
            forms = [([], []) for _ in x]
            for form, (found, drawn) in zip(x, forms, strict=True):
                _walk(form, [], found, drawn)
            found = next((f for f, _ in forms if f), [])
            pictures += found
            shapes += [] if found else [x]
        elif x.tag in (f"{M}oMath", f"{M}oMathPara"):
            out.append((_math(x), props))
        elif x.tag in (f"{W}drawing", f"{W}pict", f"{W}object"):
            found = [(b.get(f"{R}embed"), None, None) for b in x.iter(f"{A}blip")] + [(i.get(f"{R}id"), *(_points(s.get("style", ""), k) for k in ("width", "height"))) for s in x.iter(f"{V}shape") for i in s.iter(f"{V}imagedata")]
            extent = next(x.iter(f"{WP}extent"), None)
            size = (None, None) if extent is None else tuple(int(extent.get(k)) / EMU for k in ("cx", "cy"))
            pictures += [{"rid": rid, "width": w or size[0], "height": h or size[1]} for rid, w, h in found]
            shapes += [] if found else [x]
        elif x.tag == f"{W}r":
            _walk(x, out, pictures, shapes, x.find(f"{W}rPr"))
        elif x.tag not in (f"{W}pPr", f"{W}rPr", f"{W}del"):
            _walk(x, out, pictures, shapes, props)


def _paragraph(p) -> dict:
    """SRC-15: text, runs, alignment, weight, pictures, style and list level of a paragraph."""
    out, pictures, shapes = [], [], []
    _walk(p, out, pictures, shapes)
    props = p.find(f"{W}pPr")
    find = lambda path: None if props is None else props.find(path)
    value = lambda x: None if x is None else x.get(f"{W}val")
    level = find(f"{W}numPr/{W}ilvl")
    runs = []
    for text, own in out:
        vertical = None if own is None else value(own.find(f"{W}vertAlign"))
        run = {"bold": _flag(own, "b"), "italic": _flag(own, "i"), "underline": _flag(own, "u"), "sup": vertical == "superscript", "sub": vertical == "subscript", "highlight": _flag(own, "highlight")}
        if runs and {k: v for k, v in runs[-1].items() if k != "text"} == run:
            runs[-1]["text"] += text
        else:
            runs.append({"text": text, **run})
    worded = [r for r in runs if r["text"].strip()]
    whole = lambda x, name: None if x is None or not (x.get(f"{W}{name}") or "").lstrip("-").isdigit() else int(x.get(f"{W}{name}"))
    stops = [] if find(f"{W}tabs") is None else [whole(t, "pos") for t in find(f"{W}tabs") if t.get(f"{W}val") != "clear"]
    return {
        "indent": whole(find(f"{W}ind"), "left"), "keep_next": _flag(props, "keepNext"), "stops": [t for t in stops if t is not None],
        "kind": "p", "text": "".join(t for t, _ in out), "align": value(find(f"{W}jc")), "images": len(pictures), "pictures": pictures, "shapes": len(shapes), "equations": sum(1 for _ in p.iter(f"{M}oMath")), "runs": runs, "style": value(find(f"{W}pStyle")),
        "bold": bool(worded) and all(r["bold"] for r in worded), "num_id": value(find(f"{W}numPr/{W}numId")), "num_level": None if find(f"{W}numPr") is None else int(value(level) or 0),
    }


def _cell(cell) -> tuple[str, list[tuple[int, int, list]]]:
    """A cell's paragraphs, and its inner tables as (place of their first paragraph, paragraphs, cells)."""
    texts, inner = [], []
    for x in cell:
        if x.tag == f"{W}p":
            texts.append(_paragraph(x)["text"])
        elif x.tag == f"{W}tbl":
            own = [_paragraph(p)["text"] for p in x.iter(f"{W}p")]
            inner.append((len(texts), len(own), _cells(x)[0]))
            texts += own
    return "\n".join(texts), inner


def _cells(table) -> tuple[list[list[str]], list[dict]]:
    rows = [[_cell(c) for c in row.findall(f"{W}tc")] for row in table.findall(f"{W}tr")]
    nested = [{"row": k, "at": at, "count": n, "cells": cells} for k, row in enumerate(rows) for _, inner in row for at, n, cells in inner]
    return [[text for text, _ in row] for row in rows], nested


# Sides of a table's borders, and values that stand for none.
SIDES, NO_BORDER = ("top", "left", "bottom", "right", "insideH", "insideV"), ("none", "nil")


def _drawn(borders) -> bool | None:
    """Whether any of the sides that are told has a line; None if no side is."""
    told = [] if borders is None else [x.get(f"{W}val") for k in SIDES if (x := borders.find(f"{W}{k}")) is not None and x.get(f"{W}val") is not None]
    return any(v not in NO_BORDER for v in told) if told else None


def _bordered(table, cells: list[dict]) -> bool:
    """SRC-16: by the table's own borders, or else its style: plain and unnamed ones have none; any cell with a line settles it."""
    props = table.find(f"{W}tblPr")
    if props is None:
        return True
    borders, style = props.find(f"{W}tblBorders"), props.find(f"{W}tblStyle")
    own = _drawn(borders) is not False if borders is not None else style is not None and style.get(f"{W}val") not in (None, "TableNormal")
    return own or any(c["bordered"] for c in cells)


def _grid(table) -> dict:
    """SRC-16: declared widths, borders and cells with their spans and paragraphs; what inner tables hold is in their paragraphs."""
    cells = []
    for k, row in enumerate(table.findall(f"{W}tr")):
        for n, cell in enumerate(row.findall(f"{W}tc")):
            props = cell.find(f"{W}tcPr")
            get = lambda name: None if props is None else props.find(f"{W}{name}")  # noqa: E731, B023
            span, merge = get("gridSpan"), get("vMerge")
            own = [_paragraph(x) for x in cell.iter(f"{W}p")]
            cells.append({
                "row": k, "cell": n, "span": 1 if span is None else int(span.get(f"{W}val") or 1), "merged": None if merge is None else merge.get(f"{W}val", "continue"), "bordered": _drawn(get("tcBorders")),
                "paragraphs": [{c: p[c] for c in ("text", "align", "runs", "pictures")} for p in own],
            })
    cols = [int(x.get(f"{W}w") or 0) for x in table.findall(f"{W}tblGrid/{W}gridCol")]
    return {"cols": cols, "bordered": _bordered(table, cells), "cells": cells}


def _body(node):
    """SRC-16, SRC-17: paragraphs and tables in order, inside content controls too."""
    for x in node:
        if x.tag == f"{W}p":
            yield _paragraph(x)
        elif x.tag == f"{W}tbl":
            cells, nested = _cells(x)
            yield {"kind": "table", "text": "", "cells": cells, "nested": nested, "grid": _grid(x), "floating": x.find(f"{W}tblPr/{W}tblpPr") is not None}
        elif x.tag in (f"{W}sdt", f"{W}sdtContent", f"{W}ins"):
            yield from _body(x)


def _header_part(z: zipfile.ZipFile, body) -> str | None:
    """SRC-07: the header of the first section's first page, or else its default one, through the document's relations."""
    section = next(body.iter(f"{W}sectPr"), None)
    refs = {} if section is None else {x.get(f"{W}type"): x.get(f"{R}id") for x in reversed(section.findall(f"{W}headerReference"))}
    rid, rels = refs.get("first", refs.get("default")), "word/_rels/document.xml.rels"
    if rid is None or rels not in z.namelist():
        return None
    target = next((x.get("Target", "") for x in ElementTree.fromstring(z.read(rels)) if x.get("Id") == rid), "")
    name = target.removeprefix("/") if target.startswith("/") else f"word/{target}"
    return name if name in z.namelist() else None


def parse_docx(content: bytes) -> list[dict]:
    """SRC-03, SRC-07: the blocks of one file, with the page header's lines first where the body does not begin with them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if "word/document.xml" not in z.namelist():
            raise ValueError("not a Word document: word/document.xml is missing")
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
        if body is None:
            raise ValueError("not a Word document: it has no body")
        blocks = list(_body(body))
        name = _header_part(z, body)
        heads = [x for x in _body(ElementTree.fromstring(z.read(name))) if x["text"].strip()] if name else []
    top = " ".join(b["text"] for b in [b for b in blocks if b["text"].strip()][:4]).lower()
    if heads and not any(h["text"].lower() in top for h in heads):
        blocks = heads + blocks
    return [{"block_pos": k - (len(heads) if blocks[: len(heads)] == heads else 0), **b} for k, b in enumerate(blocks)]


def parse_parts(content: bytes, media: bool = True) -> list[dict]:
    """SRC-04, SRC-05, SRC-06, SRC-08: what a file holds besides its text: relations, styles, list levels and media."""
    out = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        read = lambda name: ElementTree.fromstring(z.read(name)) if name in names else ElementTree.Element("none")
        value = lambda node, path: None if (x := node.find(path)) is None else x.get(f"{W}val")
        for x in read("word/_rels/document.xml.rels"):
            out.append({"part": "relation", "name": x.get("Id"), "target": x.get("Target", "").removeprefix("/word/").removeprefix("/")})
        for x in read("word/styles.xml").findall(f"{W}style"):
            out.append({"part": "style", "name": x.get(f"{W}styleId"), "target": value(x, f"{W}basedOn"), "text": value(x, f"{W}pPr/{W}numPr/{W}numId"), "level": int(value(x, f"{W}pPr/{W}numPr/{W}ilvl") or 0)})
        numbering = read("word/numbering.xml")
        levels = {x.get(f"{W}abstractNumId"): x.findall(f"{W}lvl") for x in numbering.findall(f"{W}abstractNum")}
        for x in numbering.findall(f"{W}num"):
            starts = {o.get(f"{W}ilvl"): value(o, f"{W}startOverride") for o in x.findall(f"{W}lvlOverride")}
            for k in levels.get(value(x, f"{W}abstractNumId"), []):
                level = k.get(f"{W}ilvl")
                out.append({"part": "level", "name": x.get(f"{W}numId"), "level": int(level), "format": value(k, f"{W}numFmt") or "decimal", "text": value(k, f"{W}lvlText") or f"%{int(level) + 1}.", "start": int(starts.get(level) or value(k, f"{W}start") or 1)})
        out += [{"part": "media", "name": n.rsplit("/", 1)[1], "target": n.removeprefix("word/"), "content": z.read(n)} for n in sorted(names) if media and n.startswith("word/media/")]
    return out


#: Rows, and bytes of files, that one batch of a reader holds at least before it is passed on: a batch for each file costs more than its parsing.
BATCH_ROWS, BATCH_BYTES = 2_000, 4 << 20


def _reader(parse, columns: str):
    schema = _arrow(columns)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py()
                try:
                    rows += [{"paper_id": path, **(b | {"part_text": b.get("text")} if "part_text" in schema.names and "part" in b else b)} for b in parse(data)]
                except (ValueError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows += [{"paper_id": path, "kind": "error", "error": str(e)}] if "error" in schema.names else []
                size += len(data)
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def _arrow(columns: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(columns))


def read_blocks(files: DataFrame) -> DataFrame:
    """SRC-02: blocks of binaryFile rows (path, content); a file that is no Word document gives one row of kind error."""
    return files.select("path", "content").mapInArrow(_reader(parse_docx, BLOCKS), BLOCKS)


def parse_whole(content: bytes) -> list[dict]:
    return parse_docx(content) + parse_parts(content)


def parse_light(content: bytes) -> list[dict]:
    return parse_docx(content) + parse_parts(content, media=False)


def read_whole(files: DataFrame, with_media: bool = False) -> tuple[DataFrame, DataFrame]:
    """Blocks and parts from one reading of each file, which is written as a table; media are taken only if asked for. A file that can't be read is one row of kind error."""
    columns = BLOCKS + PARTS.removeprefix("paper_id string").replace(", text string", ", part_text string")
    rows = stored(files.select("path", "content").mapInArrow(_reader(parse_whole if with_media else parse_light, columns), columns))
    parts = rows.where("part is not null").select("paper_id", "part", "name", "target", "level", "format", F.col("part_text").alias("text"), "start", "content")
    return rows.where("part is null").select(*(c.split()[0] for c in _names(BLOCKS))), parts


def _names(columns: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(columns).fieldNames()


def read_parts(files: DataFrame) -> DataFrame:
    """Relations, styles, list levels and media of binaryFile rows, one table told apart by part."""
    return files.select("path", "content").mapInArrow(_reader(parse_parts, PARTS), PARTS)


def relations(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'relation'").select("paper_id", F.col("name").alias("rid"), "target")


def styles(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'style'").select("paper_id", F.col("name").alias("style"), F.col("target").alias("based_on"), F.col("text").alias("num"), "level")


def media(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'media'").select("paper_id", "target", "content")


def levels(parts: DataFrame) -> DataFrame:
    return parts.where("part = 'level'").select("paper_id", F.col("name").alias("num_id"), F.col("level").alias("num_level"), F.col("format").alias("num_format"), F.col("text").alias("level_text"), "start")
