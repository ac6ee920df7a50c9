"""SNK-05: Word files of layout plans, as binary rows.

A plan is rows (paper_id, seq, style, indent, keep_next, text) and, where it has them, stops, align, runs, pictures
(target, width, height in points) and grid. A file is a graph of parts: the document, its styles and footer, and its
media, each stored once by content whatever the number of pictures that show it. A paper's media and paragraphs reach
one task sorted, media first, and pass by as a stream that holds one paper.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from functools import lru_cache
from itertools import groupby
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..measures import MARGIN_BOTTOM, MARGIN_LEFT, MARGIN_RIGHT, MARGIN_TOP, PAGE_HEIGHT, PAGE_WIDTH, TEXT_WIDTH
from .docx import EMU, GRID, PICTURES, RUN

# Namespaces, content types and relation types of the format.
OFFICE, PACKAGE = "http://schemas.openxmlformats.org/officeDocument/2006", "http://schemas.openxmlformats.org/package/2006"
WORD, DRAWING = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006"
KIND = "application/vnd.openxmlformats-officedocument.wordprocessingml"
MEDIA_TYPES = {"png": "image/png", "jpg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp"}
SPACES = f'xmlns:w="{WORD}" xmlns:r="{OFFICE}/relationships" xmlns:wp="{DRAWING}/wordprocessingDrawing" xmlns:a="{DRAWING}/main" xmlns:pic="{DRAWING}/picture"'
# Looks of styles (bold, centred, size in half points, underlined), the font, and measures in twips.
LOOKS = {"school": (True, True, 32, False), "exam": (True, True, 26, False), "header": (True, False, 24, False), "header rule": (True, False, 24, False), "instructions": (True, False, 22, False), "heading": (True, True, 28, True), "title": (True, True, 24, False), "sub-heading": (True, False, 22, False), "umbrella": (True, False, 22, False), "or": (True, True, 22, False), "end": (True, True, 22, False), "figure": (False, True, 22, False)}
FONT, SIZE, CELL_WIDTH, CELL_MARGIN = "Times New Roman", 22, 1800, 80
COLUMNS = {"stops": "array<int>", "align": "string", "runs": RUN, "pictures": "array<struct<target:string,width:double,height:double>>", "grid": GRID.replace(PICTURES, "array<struct<target:string,width:double,height:double>>")}
FLAGS = {"bold": "<w:b/>", "italic": "<w:i/>", "red": '<w:color w:val="C00000"/>', "highlight": '<w:highlight w:val="yellow"/>', "underline": '<w:u w:val="single"/>', "sup": '<w:vertAlign w:val="superscript"/>', "sub": '<w:vertAlign w:val="subscript"/>'}


def style_id(style: str) -> str:
    return style.replace(" ", "-")


def _run(text: str, look: dict) -> str:
    props = "".join(xml for flag, xml in FLAGS.items() if look.get(flag))
    lines = ["<w:tab/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' if t else "" for t in line.split("\t")) for line in _clean(text).split("\n")]
    return f"<w:r>{f'<w:rPr>{props}</w:rPr>' if props else ''}{'<w:br/>'.join(lines)}</w:r>"


def _clean(text: str) -> str:
    """Without the control characters that XML can't hold."""
    return "".join(c for c in text if c in "\t\n" or c >= " " and c not in "￾￿")


def _drawing(number: int, rid: str, width: float, height: float) -> str:
    size = f'cx="{round(width * EMU)}" cy="{round(height * EMU)}"'
    shape = f'<pic:pic><pic:nvPicPr><pic:cNvPr id="{number}" name="Picture {number}"/><pic:cNvPicPr/></pic:nvPicPr><pic:blipFill><a:blip r:embed="{rid}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill><pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext {size}/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
    return f'<w:r><w:drawing><wp:inline distT="0" distB="0" distL="0" distR="0"><wp:extent {size}/><wp:docPr id="{number}" name="Picture {number}"/><a:graphic><a:graphicData uri="{DRAWING}/picture">{shape}</a:graphicData></a:graphic></wp:inline></w:drawing></w:r>'


@lru_cache(maxsize=256)
def _styles(names: tuple[str, ...]) -> str:
    return "".join(f'<w:style w:type="paragraph" w:styleId={quoteattr(style_id(s))}><w:name w:val={quoteattr(s)}/><w:pPr>{"<w:jc w:val=" + quoteattr("center") + "/>" if centred else ""}</w:pPr><w:rPr>{"<w:b/>" if bold else ""}<w:sz w:val="{size}"/>{"<w:u w:val=" + quoteattr("single") + "/>" if under else ""}</w:rPr></w:style>' for s in names for bold, centred, size, under in [LOOKS.get(s, (False, False, SIZE, False))])


class Package:
    """The parts of one file."""

    def __init__(self, media: dict[str, bytes]) -> None:
        self.media, self.stored, self.pictures = media, {}, 0

    def _rid(self, target: str) -> str | None:
        """The relation to a picture's part: equal contents share one."""
        content, kind = self.media.get(target), target.rsplit(".", 1)[-1].lower().replace("jpeg", "jpg")
        if content is None or kind not in MEDIA_TYPES:
            return None
        name = f"media/{hashlib.sha1(content).hexdigest()}.{kind}"
        return self.stored.setdefault(name, (f"rId{len(self.stored) + 10}", content))[0]

    def _content(self, text: str, runs: list[dict] | None, pictures: list[dict] | None, bold: bool) -> str:
        out = "".join(_run(r["text"] or "", r | {"bold": r.get("bold") or bold}) for r in runs or [{"text": text}] if r["text"])
        for p in pictures or []:
            if rid := self._rid(p["target"] or ""):
                self.pictures += 1
                out += _drawing(self.pictures, rid, p["width"] or 150.0, p["height"] or 100.0)
        return out

    def paragraph(self, p: dict) -> str:
        style = p["style"] or "question"
        tabs = "".join(f'<w:tab w:val="{"right" if t >= TEXT_WIDTH else "left"}" w:pos="{t}"/>' for t in p.get("stops") or [])
        align = p.get("align") or ("center" if LOOKS.get(style, (0, 0))[1] else None)
        props = f"<w:pStyle w:val={quoteattr(style_id(style))}/>" + ("<w:keepNext/>" if p["keep_next"] else "") + (f"<w:tabs>{tabs}</w:tabs>" if tabs else "") + f'<w:ind w:left="{p["indent"] or 0}"/>' + (f"<w:jc w:val={quoteattr(align)}/>" if align else "")
        return f"<w:p><w:pPr>{props}</w:pPr>{self._content(p['text'] or '', p.get('runs'), p.get('pictures'), LOOKS.get(style, (False,))[0])}</w:p>"

    def table(self, grid: dict, indent: int) -> str:
        """LAY-06: a table by its grid: widths, borders, cells over several columns or rows."""
        rows = [list(own) for _, own in groupby(sorted(grid["cells"], key=lambda c: (c["row"], c["cell"])), key=lambda c: c["row"])]
        cols = widths(grid["cols"], max((sum(c["span"] or 1 for c in r) for r in rows), default=1), TEXT_WIDTH - indent)
        line = "single" if grid["bordered"] else "nil"
        borders = "".join(f'<w:{k} w:val="{line}" w:sz="4" w:space="0" w:color="000000"/>' for k in ("top", "left", "bottom", "right", "insideH", "insideV"))
        out = ""
        for row in rows:
            at, out = 0, out + "<w:tr>"
            for c in row:
                span = c["span"] or 1
                merge = "" if not c["merged"] else f'<w:vMerge w:val="{c["merged"]}"/>'
                props = f'<w:tcW w:w="{sum(cols[at : at + span])}" w:type="dxa"/>' + (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + merge
                own = "".join(f"<w:p>{f'<w:pPr><w:jc w:val={quoteattr(p['align'])}/></w:pPr>' if p['align'] else ''}{self._content(p['text'] or '', p['runs'], p['pictures'], False)}</w:p>" for p in c["paragraphs"] or [])
                out += f"<w:tc><w:tcPr>{props}</w:tcPr>{own or '<w:p/>'}</w:tc>"
                at += span
            out += "</w:tr>"
        props = f'<w:tblW w:w="{sum(cols)}" w:type="dxa"/><w:tblInd w:w="{indent}" w:type="dxa"/><w:tblBorders>{borders}</w:tblBorders><w:tblLayout w:type="fixed"/>'
        return f"<w:tbl><w:tblPr>{props}</w:tblPr><w:tblGrid>{''.join(f'<w:gridCol w:w="{w}"/>' for w in cols)}</w:tblGrid>{out}</w:tbl>"

    def block(self, p: dict) -> str:
        grid = p.get("grid") or (plain_grid(p["text"]) if p["style"] == "table" and p["text"] else None)
        return self.table(grid, p["indent"] or 0) if grid and grid["cells"] else self.paragraph(p)

    def build(self, plan: list[dict]) -> bytes:
        body = "".join(map(self.block, plan))
        edge = "".join(f'<w:{side} w:val="{look}" w:sz="12" w:space="24" w:color="auto"/>' for side, look in (("top", "thinThickSmallGap"), ("left", "thinThickSmallGap"), ("bottom", "thickThinSmallGap"), ("right", "thickThinSmallGap")))
        section = f'<w:sectPr><w:footerReference w:type="default" r:id="rId2"/><w:pgSz w:w="{PAGE_WIDTH}" w:h="{PAGE_HEIGHT}"/><w:pgMar w:top="{MARGIN_TOP}" w:right="{MARGIN_RIGHT}" w:bottom="{MARGIN_BOTTOM}" w:left="{MARGIN_LEFT}" w:header="113" w:footer="200" w:gutter="0"/><w:pgBorders w:offsetFrom="page">{edge}</w:pgBorders></w:sectPr>'
        font = f'<w:rFonts w:ascii="{FONT}" w:hAnsi="{FONT}" w:cs="Mangal"/><w:sz w:val="{SIZE}"/><w:szCs w:val="{SIZE}"/>'
        styles = _styles(tuple(dict.fromkeys([*LOOKS, *sorted({p["style"] or "question" for p in plan})])))
        relations = [("rId1", "styles", "styles.xml"), ("rId2", "footer", "footer1.xml"), *((rid, "image", name) for name, (rid, _) in self.stored.items())]
        page = '<w:fldSimple w:instr="PAGE"><w:r><w:t>1</w:t></w:r></w:fldSimple>'
        types = [("/word/document.xml", "document.main"), ("/word/styles.xml", "styles"), ("/word/footer1.xml", "footer")]
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>' + "".join(f'<Default Extension="{k}" ContentType="{v}"/>' for k, v in MEDIA_TYPES.items()) + "".join(f'<Override PartName="{n}" ContentType="{KIND}.{k}+xml"/>' for n, k in types) + "</Types>",
            "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f"<w:document {SPACES}><w:body>{body}{section}</w:body></w:document>",
            "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{rid}" Type="{OFFICE}/relationships/{kind}" Target="{target}"/>' for rid, kind, target in relations) + "</Relationships>",
            "word/styles.xml": f"<w:styles {SPACES}><w:docDefaults><w:rPrDefault><w:rPr>{font}</w:rPr></w:rPrDefault></w:docDefaults>{styles}</w:styles>",
            "word/footer1.xml": f'<w:ftr {SPACES}><w:p><w:pPr><w:jc w:val="center"/></w:pPr><w:r><w:t xml:space="preserve">Page </w:t></w:r>{page}</w:p></w:ftr>',
        } | {f"word/{name}": content for name, (_, content) in self.stored.items()}
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, data in parts.items():
                z.writestr(zipfile.ZipInfo(name, (2000, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
        return out.getvalue()


def widths(declared: list[int] | None, n: int, most: int) -> list[int]:
    """LAY-06: the declared widths where there is one for each column, or else even ones; narrowed to what the page has."""
    own = list(declared) if declared and len(declared) == n else [round(min(most, n * CELL_WIDTH) / n)] * n
    total = sum(own)
    return [round(w * most / total) for w in own] if total > most else own


def plain_grid(text: str) -> dict:
    """A bordered table of texts: lines are rows, tabs part the cells."""
    cells = [{"row": k, "cell": n, "span": 1, "merged": None, "bordered": None, "paragraphs": [{"text": t, "align": None, "runs": None, "pictures": None}]} for k, line in enumerate(text.split("\n")) for n, t in enumerate(line.split("\t"))]
    return {"cols": [], "bordered": True, "cells": cells}


FILE = pa.schema([("paper_id", pa.string()), ("content", pa.binary())])


#: Files, and bytes of them, that one batch holds at least before it is passed on.
BATCH_FILES, BATCH_BYTES = 500, 4 << 20


def _files(batches):
    rows = (r for batch in batches for r in batch.to_pylist())
    out, size = [], 0
    for paper, own in groupby(rows, key=lambda r: r["paper_id"]):
        media, plan = {}, []
        for r in own:
            if r["__target"] is not None:
                media[r["__target"]] = r["__content"]
            else:
                plan.append(r)
        if plan:
            out.append({"paper_id": paper, "content": Package(media).build(plan)})
            size += len(out[-1]["content"])
        if len(out) >= BATCH_FILES or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema=FILE)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=FILE)


def to_docx(plan: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """(paper_id, content) of plans; pictures come from media (paper_id, target, content). Equal plans give equal bytes; a picture without content is left out."""
    given = [F.col(c) if c in ("paper_id", "seq", "style", "indent", "keep_next", "text") or c in plan.columns else F.lit(None).cast(kind).alias(c) for c, kind in {**dict.fromkeys(("paper_id", "seq", "style", "indent", "keep_next", "text")), **COLUMNS}.items()]
    rows = plan.select(*given).withColumns({"__target": F.lit(None).cast("string"), "__content": F.lit(None).cast("binary")})
    if media is not None:
        rows = rows.unionByName(media.select("paper_id", F.col("target").alias("__target"), F.col("content").alias("__content")), allowMissingColumns=True)
    # a file costs more than its rows weigh, so its number of tasks is named, or small tables would be packed by a task or two
    tasks = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(tasks, "paper_id").sortWithinPartitions("paper_id", F.asc_nulls_last("__target"), "seq")
    return ordered.mapInArrow(_files, "paper_id string, content binary")
