"""The rendered paper as rows: a paragraph, table or picture each, in order, with style, indent, tab stops and text.

The plan is relational: headers, headings and items become paragraphs by projection and union, and only
sources.write_docx turns them into a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..measures import TEXT_WIDTH

# Indents and tab stops in twips, notes on the source of a paper.
QUESTION_INDENT, PART_INDENT, INSTRUCTION_INDENT = 360, 720, 284
OPTION_STOPS = {4: [2880, 5400, 7920], 3: [3720, 7080], 2: [5400], 1: []}
HEADER_STOPS = [3600, 8640]
# Characters or items over which an entry may break over pages.
LONG_TEXT, LONG_ITEMS = 900, 8
PDF_NOTE = "## PDF source\n- The paper arrived as a PDF and was converted to Word before formatting. Line breaks, stacked fractions, tables and figure placement come from the conversion — check them against the PDF. Sending the original Word file gives a better result.\n"
DOC_NOTE = "## Word 97 source\n- The paper arrived as an old-format .doc file and was converted to .docx before formatting. Check figures and tables against the original; saving the paper as .docx in Word gives a better result.\n"

PLAN = ["paper_id", "block", "entry_no", "item_no", "line", "style", "indent", "keep_next", "stops", "text"]


def label_width(label: Column) -> Column:
    """Width of a label in twips at 11 points, by kinds of characters."""
    count = lambda pattern: F.char_length(label) - F.char_length(F.regexp_replace(label, pattern, ""))
    digits, marks, narrow, small = count(r"\d"), count(r"[().]"), count("[il]"), count("[a-hj-km-z]")
    return digits * 110 + marks * 73 + narrow * 61 + small * 98 + (F.char_length(label) - digits - marks - narrow - small) * 150


def part_indent(labels: Column) -> Column:
    """LAY-04: where the text of parts begins, clear of the widest label."""
    need = lambda x: (F.ceil((label_width(x) + 460) / 60) * 60).cast("int")
    return F.greatest(F.lit(PART_INDENT), F.coalesce(F.array_max(F.transform(labels, need)), F.lit(0)))


def with_mark(text: Column, mark: Column) -> Column:
    """LAY-03: a mark stands at the right margin, behind a tab."""
    return F.concat(text, F.when(mark.isNotNull(), F.concat(F.lit("\t"), T.mark_text(mark))).otherwise(""))


def option_lines(options: Column) -> Column:
    """LAY-08: options as lines of four, three, two or one, by the longest."""
    longest = F.array_max(F.transform(options, F.char_length))
    width = F.array_max(F.transform(options, T.text_width))
    per = T.options_per_line(F.size(options), longest, width)
    starts = F.sequence(F.lit(0), F.size(options) - 1)
    return F.transform(F.filter(starts, lambda k: k % per == 0), lambda k: F.struct(per.cast("int").alias("per"), F.array_join(F.slice(options, k + 1, per.cast("int")), "\t").alias("text")))


def _paragraph(rows: DataFrame, block: int, style: Column | str, text: Column, *, indent: Column | int = 0, keep: Column | bool = False, stops: Column | list[int] | None = None, entry: Column | None = None, item: Column | None = None, line: Column | None = None, own: Column | None = None) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    zero, tabs = F.lit(0), F.array(*map(F.lit, stops or [])).cast("array<int>") if not isinstance(stops, Column) else stops
    return rows.select("paper_id", F.lit(block).alias("block") if "section_no" not in rows.columns else (F.col("section_no") * 10 + block).alias("block"), (zero if entry is None else entry).alias("entry_no"), (zero if item is None else item).alias("item_no"), (zero if line is None else line).alias("line"), col(style).alias("style"), col(indent).cast("int").alias("indent"), col(keep).alias("keep_next"), tabs.alias("stops"), text.alias("text"), F.col("block_pos") if "block_pos" in rows.columns else F.lit(None).cast("int").alias("block_pos"), (F.lit(None).cast("string") if own is None else own).alias("own"))


def header_block(header: DataFrame, school: str) -> DataFrame:
    """LAY-07: four lines and the instructions of a paper's header, blanks where it is silent; a long subject moves the tab stops left."""
    blank = lambda c, other: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(other))
    exam = F.coalesce(F.upper(F.regexp_replace("exam", r"\s+", " ")), F.lit("EXAMINATION"))
    subject = F.concat(F.upper(blank("subject", "SUBJECT")), F.when(F.col("subject_code").isNotNull(), F.concat(F.lit(" ("), F.col("subject_code"), F.lit(")"))).otherwise(""))
    marks_at = min(HEADER_STOPS[1], TEXT_WIDTH - 2100)
    subject_at = F.least(F.lit(HEADER_STOPS[0]), marks_at - (1050 + F.char_length(subject) * 150) - 200)
    stops = F.when(subject_at >= HEADER_STOPS[0], F.array(*map(F.lit, HEADER_STOPS))).otherwise(F.array(F.greatest(F.lit(2200), subject_at), F.lit(marks_at))).cast("array<int>")
    date = F.when(F.col("date").rlike("^_+$") | (F.coalesce("date", F.lit("")) == ""), "____/____/________").otherwise(F.col("date"))

    def one(k: int, style: str, text: Column, tabs: Column, indent: int = 0, keep: bool = False, line: Column | None = None) -> Column:
        return F.struct(F.lit(-100_000 + k).alias("block"), (F.lit(0) if line is None else line).alias("line"), F.lit(style).alias("style"), F.lit(indent).alias("indent"), F.lit(keep).alias("keep_next"), tabs.alias("stops"), text.alias("text"))

    at = lambda *stops: F.array(*map(F.lit, stops)).cast("array<int>")
    lines = F.array(
        one(0, "school", F.lit(school), at()), one(1, "exam", exam, at()),
        one(2, "header", F.concat(F.lit("Class: "), blank("cls", "____"), F.lit("\tSubject: "), subject, F.lit("\tMarks: "), blank("marks", "____"), F.lit(" marks")), stops),
        one(3, "header rule", F.concat(F.lit("Date: "), date, F.lit("\tRoll No.:______________\tTime: "), blank("time", "3 hours")), at(*HEADER_STOPS)),
    )
    told = F.coalesce("instructions", F.array().cast("array<string>"))
    title = F.filter(F.array(one(4, "instructions", F.lit("General Instructions:"), at(), keep=True)), lambda _: F.size(told) > 0)
    numbered = lambda t, k: F.when(t.rlike(r"^\d+\s*[.)]"), F.regexp_replace(t, r"^(\d+\s*[.)])\s*", "$1\t")).otherwise(F.concat((k + 1).cast("string"), F.lit(".\t"), t))
    each = F.transform(told, lambda t, k: one(5, "instruction", numbered(t, k), at(INSTRUCTION_INDENT), INSTRUCTION_INDENT, True, k))
    # one row becomes all its lines, so the header is made once
    rows = header.select("paper_id", F.inline(F.concat(lines, title, each)))
    return rows.select("paper_id", "block", F.lit(0).alias("entry_no"), F.lit(0).alias("item_no"), "line", "style", "indent", "keep_next", "stops", "text", F.lit(None).cast("int").alias("block_pos"), F.lit(None).cast("string").alias("own"))


def body(classified: DataFrame, entries: DataFrame) -> DataFrame:
    """LAY-03 to LAY-06, LAY-09: headings, questions with their marks, continuations, parts, options, OR, tables and figures of every section, and END."""
    from .layout import umbrella

    e = entries.select("paper_id", "entry_no", F.col("marks").alias("__marks"), F.col("stem").alias("__stem"), part_indent(F.col("sub_labels")).alias("__left"), F.size("sub_labels").alias("__parts"), F.col("has_figure").alias("__figure"))
    rows = classified.join(e, ["paper_id", "entry_no"], "left")
    item, text = F.col("item"), F.coalesce("text", F.lit(""))
    entry = Window.partitionBy("paper_id", "section_no", "entry_no")
    w = entry.orderBy("item_no")
    following, size = F.lead("item").over(w), F.char_length(text) + F.coalesce(F.aggregate("options", F.lit(0), lambda a, o: a + F.char_length(o)), F.lit(0))
    rows = rows.withColumns({"__next": following, "__long": (F.sum(size).over(entry) > LONG_TEXT) | (F.count("*").over(entry) > LONG_ITEMS), "__first": F.row_number().over(w) == 1})
    # a long entry may break over pages, but for its first line and what belongs to the line before it
    chain = F.col("__next").isNotNull() & (~F.col("__long") | F.col("__first") | F.col("__next").isin("opts", "image", "images", "or"))
    owner = F.last(F.when(item != "cont", item), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumns({"__on": chain, "__under": F.coalesce((item == "cont") & (owner == "sub"), F.lit(False))})
    number = F.concat(F.col("number").cast("string"), F.lit(".\t"), F.when(F.col("alt").isNotNull(), F.concat(F.lit("("), F.col("alt"), F.lit(") "))).otherwise(""))
    asks = item.isin("stem") & F.col("number").isNotNull()
    style = F.when(item.startswith("heading"), "heading").when(asks, F.when(umbrella(F.col("text"), F.col("__parts"), F.lit(False), F.col("__figure")), "umbrella").otherwise("question")).when(item == "stem", F.when(F.col("center"), "title").otherwise("note")).when(item == "cont", "continuation").when(item == "sub", "part").when(item == "or", "or").when(item.isin("table", "tables", "pairs"), "table").when(item.isin("image", "images"), "figure").otherwise("options")
    label = F.concat_ws(" ", "label", "nested")
    shown = F.when(item.startswith("heading"), F.upper(text)).when(asks, with_mark(F.concat(number, text), F.col("__marks"))).when(item == "sub", with_mark(F.concat(label, F.lit("\t"), text), F.col("item_marks"))).when(item == "or", "OR").when(item.isin("table", "tables", "pairs"), F.array_join(F.transform("cells", lambda r: F.array_join(r, "\t")), "\n")).otherwise(with_mark(text, F.when((item == "cont") & ~F.col("item_marks").eqNullSafe(F.col("__marks")), F.col("item_marks"))))
    indent = F.when((item == "sub") | F.col("__under"), F.col("__left")).when(asks | item.isin("cont", "opts"), QUESTION_INDENT).otherwise(0)
    stops = F.when(item == "sub", F.array(F.col("__left"), F.lit(TEXT_WIDTH))).when(asks | (item == "cont"), F.array(F.lit(TEXT_WIDTH))).otherwise(F.array().cast("array<int>")).cast("array<int>")
    keep = style.isin("heading", "or") | F.when(item.isin("image", "images"), F.col("__next").isNotNull()).otherwise(F.col("__on") & ~item.isin("table", "tables", "pairs"))
    whole = _paragraph(rows.where(item != "opts"), 0, style, shown, indent=indent, keep=keep, stops=stops, entry=F.col("entry_no"), item=F.col("item_no"), own=text)
    lines = rows.where(item == "opts").withColumn("__lines", option_lines(F.col("options"))).select("*", (F.size("__lines") - 1).alias("__last"), F.posexplode("__lines").alias("__k", "__o"))
    per = F.create_map(*[x for k, v in OPTION_STOPS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<int>"))])
    options = _paragraph(lines, 0, "options", F.col("__o.text"), indent=QUESTION_INDENT, keep=F.col("__on") | (F.col("__k") < F.col("__last")), stops=F.element_at(per, F.col("__o.per")), entry=F.col("entry_no"), item=F.col("item_no"), line=F.col("__k"))
    end = _paragraph(classified.select("paper_id").distinct(), 100_000, "end", F.lit("END"))
    return whole.unionByName(options).unionByName(end)


def whole(header: DataFrame, classified: DataFrame, entries: DataFrame, school: str) -> DataFrame:
    """SNK-05, SET-02: the header's block and the body, numbered through: a plan that sources.write_docx takes."""
    both = header_block(header, school).unionByName(body(classified, entries))
    order = Window.partitionBy("paper_id").orderBy("block", "entry_no", "item_no", "line")
    return both.select("paper_id", F.row_number().over(order).alias("seq"), "style", "indent", "keep_next", "stops", "text", "block_pos", "own")


LOOKS = ("bold", "italic", "underline", "sup", "sub", "highlight")


def _slice(runs: Column, start: Column, size: Column) -> Column:
    """The runs, with all of their looks, of the characters from start (0 is the first) on."""
    ends = F.transform(F.sequence(F.lit(1), F.size(runs)), lambda k: F.aggregate(F.slice(runs, F.lit(1), k), F.lit(0), lambda a, r: a + F.char_length(r["text"])))
    low = lambda r, i: F.greatest(start - (F.get(ends, i) - F.char_length(r["text"])), F.lit(0))
    high = lambda r, i: F.least(start + size - (F.get(ends, i) - F.char_length(r["text"])), F.char_length(r["text"]))
    cut = F.transform(runs, lambda r, i: F.struct(F.substring(r["text"], low(r, i) + 1, F.greatest(high(r, i) - low(r, i), F.lit(0))).alias("text"), *(r[f].alias(f) for f in LOOKS)))
    return F.filter(cut, lambda r: r["text"] != "")


def with_looks(plan: DataFrame, blocks: DataFrame, relations: DataFrame) -> DataFrame:
    """LAY-02, LAY-05, LAY-06: a plan whose lines have the runs, pictures and grids of the blocks that they came from (read_blocks, relations). A line whose text its block holds as it is keeps its runs; label, number and mark stand around them. Pictures are no wider than the text."""
    names = relations.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("rid", "target"))).alias("__names"))
    b = blocks.select("paper_id", "block_pos", F.col("text").alias("__text"), F.col("runs").alias("__runs"), F.col("pictures").alias("__pictures"), F.col("grid").alias("__grid"))
    rows = plan.join(b, ["paper_id", "block_pos"], "left").join(names, "paper_id", "left")
    own, text = F.col("own"), F.col("text")
    there, here = F.position(own, F.col("__text")), F.position(own, text)
    plain = lambda t: F.struct(t.alias("text"), *(F.lit(False).alias(f) for f in LOOKS))
    ahead, behind = F.substring(text, F.lit(1), here - 1), F.substring(text, here + F.char_length(own), F.char_length(text))
    runs = F.filter(F.concat(F.array(plain(ahead)), _slice(F.col("__runs"), there - 1, F.char_length(own)), F.array(plain(behind))), lambda r: r["text"] != "")
    most = float(TEXT_WIDTH // 20 - 60)
    scale = lambda p: F.least(F.lit(1.0), most / p["width"])
    picture = lambda p: F.struct(F.try_element_at("__names", p["rid"]).alias("target"), (p["width"] * scale(p)).alias("width"), (p["height"] * scale(p)).alias("height"))
    inner = lambda p: F.struct(p["text"].alias("text"), p["align"].alias("align"), p["runs"].alias("runs"), F.transform(p["pictures"], picture).alias("pictures"))
    cell = lambda c: F.struct(*(c[f].alias(f) for f in ("row", "cell", "span", "merged", "bordered")), F.transform(c["paragraphs"], inner).alias("paragraphs"))
    grid = F.struct(F.col("__grid.cols").alias("cols"), F.col("__grid.bordered").alias("bordered"), F.transform("__grid.cells", cell).alias("cells"))
    rows = rows.withColumns({
        "runs": F.when((own != "") & (there > 0) & (here > 0) & (F.size("__runs") > 0), runs),
        "pictures": F.when((F.col("style") == "figure") & F.col("__names").isNotNull(), F.transform("__pictures", picture)),
        "grid": F.when((F.col("style") == "table") & F.col("__grid").isNotNull(), grid),
    })
    return rows.drop("block_pos", "own", *[c for c in rows.columns if c.startswith("__")])


def note_paragraphs(notes: DataFrame, key: str, note: str = "note") -> DataFrame:
    """SNK-07: the lines of Markdown notes as paragraphs, by their prefix, with bold parts as runs; [blocking] ones are red."""
    line = F.rtrim(F.col("raw"))
    rows = notes.select(key, F.posexplode(F.split(note, "\n")).alias("seq", "raw")).where(F.trim("raw") != "")
    style = F.when(line.startswith("# "), "title").when(line.startswith("## "), "heading").when(line.startswith("- "), "bullet").when(line.startswith("Source:"), "source").otherwise("text")
    own = F.trim(F.regexp_replace(line, r"^(# |## |- )", ""))
    parts = F.filter(F.split(F.regexp_replace(own, r"(\*\*[^*]+\*\*)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    run = lambda p: F.struct(F.when(p.rlike(r"^\*\*.*\*\*$"), F.regexp_replace(p, r"^\*\*|\*\*$", "")).otherwise(p).alias("text"), p.rlike(r"^\*\*.*\*\*$").alias("bold"), (p.rlike(r"^\*\*.*\*\*$") & F.lower(p).contains("blocking")).alias("red"))
    return rows.select(key, "seq", style.alias("style"), F.transform(parts, run).alias("runs"))


def with_provenance(note: Column, name: Column, mime: Column) -> Column:
    """SNK-14: what a note adds for a paper that came as PDF or as an old Word file."""
    pdf = F.lower(name).endswith(".pdf") | (mime == T.MIME_TYPES["pdf"])
    old = F.lower(name).endswith(".doc") | (mime == T.MIME_TYPES["doc"])
    return F.concat(note, F.when(pdf, F.concat(F.lit("\n"), F.lit(PDF_NOTE))).when(old, F.concat(F.lit("\n"), F.lit(DOC_NOTE))).otherwise(""))


def unreadable_note(base: Column, name: Column, day: Column, why: Column) -> Column:
    """SNK-13: the note of a PDF whose text can't be read."""
    return F.concat(
        F.lit("# Review — "), base, F.lit("\nSource: "), name, F.lit(" · Reviewed "), day, F.lit(" · Status: NEEDS FIXES — moved to 3_Needs-Fixes\n\n## Blocking\n- The text in this PDF cannot be read by software ("), why,
        F.lit("). **[blocking]**\n- Please upload the original Word (.docx) file of this paper to 1_Inbox instead. If the paper exists only as a PDF or a scan, tell the coordinator so it can be typed.\n"),
    )


def blocks_of_pages(lines: DataFrame, tables: DataFrame, images: DataFrame) -> DataFrame:
    """SNK-12: lines (paper_id, page, y0, text), tables (..., cells) and pictures (...) of pages as blocks in reading order."""
    none = {"text": F.lit(""), "cells": F.lit(None).cast("array<array<string>>")}
    fill = lambda df, kind, images: df.withColumns({k: v for k, v in none.items() if k not in df.columns} | {"kind": F.lit(kind), "images": F.lit(images)}).select("paper_id", "page", "y0", "kind", "text", "cells", "images")
    every = fill(lines, "p", 0).unionByName(fill(tables, "table", 0)).unionByName(fill(images, "p", 1))
    order = Window.partitionBy("paper_id").orderBy("page", "y0", "kind", "text")
    return every.select("paper_id", (F.row_number().over(order) - 1).alias("block_pos"), "kind", "text", "cells", "images")


# Folders, those that have class folders, and those that may be written.
FOLDERS = ["inbox", "formatted", "needs-fixes", "originals", "reviews", "archive"]


def checked_targets(rows: DataFrame, folder: str, writable: list[str], class_aware: list[str]) -> tuple[DataFrame, DataFrame]:
    """FLT-12: rows whose folder 'key' or 'key/Class-<numeral>' may be written, and the others with the reason in `refused`."""
    key, sub = F.substring_index(folder, "/", 1), F.regexp_extract(folder, "^[^/]+/(.*)$", 1)
    why = F.when(~key.isin(FOLDERS), F.concat(F.lit("unknown folder: "), F.col(folder))).when(~key.isin(writable), F.concat(F.lit("folder "), key, F.lit(" is read only"))).when((sub != "") & ~key.isin(class_aware), F.concat(F.lit("folder "), key, F.lit(" has no sub-folders"))).when((sub != "") & ~sub.rlike("^Class-[IVX]+$"), F.concat(F.lit("sub-folder must be Class-<Roman numeral>, got "), sub))
    marked = rows.withColumn("refused", why)
    return marked.where("refused is null").drop("refused"), marked.where("refused is not null")


def file_info(listing: DataFrame, folder: str) -> DataFrame:
    """PRJ-01: what a listing shows of each file; its owner only for the inbox."""
    own = ["id", "name", T.mime_type(F.col("name")).alias("mime_type"), "size", F.date_format("modified", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified"), F.coalesce("sub", F.lit("")).alias("sub")]
    return listing.select(*own, *(["owner"] if folder == "inbox" else []))
