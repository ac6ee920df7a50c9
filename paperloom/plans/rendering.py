"""Rendering, notes and listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import papers as P
from ..operators import render as V
from ..operators import structures as S
from . import papers, shapes
from .registry import query, table

SCHOOL = "LAKESIDE HIGH SCHOOL"


@query(
    "header_lines",
    """WITH p AS (SELECT CAST(l_orderkey AS VARCHAR) AS paper_id, sum(CAST(l_quantity AS INT)) AS m FROM lineitem GROUP BY 1)
    SELECT paper_id, 'school' AS style, 'LAKESIDE HIGH SCHOOL' AS text, '' AS stops FROM p UNION ALL SELECT paper_id, 'exam', 'EXAMINATION', '' FROM p
    UNION ALL SELECT paper_id, 'header', 'Class: VII' || chr(9) || 'Subject: SCIENCE' || chr(9) || 'Marks: ' || m || ' marks', '3600,8640' FROM p UNION ALL SELECT paper_id, 'header rule', 'Date: ____/____/________' || chr(9) || 'Roll No.:______________' || chr(9) || 'Time: 3 hours', '3600,8640' FROM p""",
)
def header_lines(spark, d):
    """LAY-07, LAY-01."""
    return V.header_block(P.headers(papers.lines(spark, d), r"(?i)\bschool\b"), SCHOOL).select("paper_id", "style", "text", F.array_join(F.transform("stops", lambda x: x.cast("string")), ",").alias("stops"))


_EXPECTED = [  # (shape, style, indent, keep with the next, tab stops, text), by hand
    (0, "heading", 0, "true", "", "SECTION A (5 MARKS)"), (0, "question", 360, "false", "10488", "1.\tWhy is {n} odd?\t2M"), (0, "question", 360, "false", "10488", "2.\tHow big is {m}?\t3M"), (0, "end", 0, "false", "", "END"),
    (1, "heading", 0, "true", "", "SECTION A"), (1, "question", 360, "false", "10488", "1.\tThe side of {n} is as long as the side of {m}."), (1, "question", 360, "true", "10488", "2.\tMatch:"), (1, "table", 0, "false", "", "Left\tRight\n{n}\tx\n{m}\ty"), (1, "end", 0, "false", "", "END"),
    (2, "heading", 0, "true", "", "SECTION A"), (2, "question", 360, "true", "10488", "1.\tWhich one is {n}?"), (2, "options", 360, "false", "2880,5400,7920", "(a) p\t(b) q\t(c) r\t(d) s"), (2, "question", 360, "true", "10488", "2.\tDraw {m}."), (2, "table", 0, "false", "", "1\n2"), (2, "or", 0, "true", "", "OR"), (2, "end", 0, "false", "", "END"),
]


@query("rendered_paragraphs", f"SELECT paper_id, style, CAST(indent AS INT) AS indent, keep_next = 'true' AS keep_next, stops, {shapes._FILL.format('t')} AS text FROM ({shapes._parts(3)}) JOIN {shapes._values(_EXPECTED, 'shape, style, indent, keep_next, stops, t')} USING (shape)")
def rendered_paragraphs(spark, d):
    """LAY-02 to LAY-06, LAY-08, LAY-09: whole papers as paragraphs."""
    found = shapes.classified(spark, d, [shapes.FIRST[0], *shapes.MORE])
    rows = V.body(found, P.entries(found))
    return rows.select("paper_id", "style", "indent", "keep_next", F.array_join(F.transform("stops", lambda x: x.cast("string")), ",").alias("stops"), "text")


#: An entry of over eight items may break over pages but behind its first line and above a part's options; a line that goes on a part stands in the part's column.
_LONG = [
    ["Section A", "1. Tell of {n} and {m}:", "(a) Why is it so? 1M", "(b) Second one.", "Go on for {m}.", "(c) third", "(d) Which is it?", "a) one  b) two  c) three  d) four", "(e) fifth", "(f) sixth", "(g) seventh", "(h) eighth"],
    ["Section A", "1. Tell of {n}:", "(i) First one.", "Go on for {m}.", "(ii) second"],
]
_KEPT = [
    (0, "heading", 0, "true", "SECTION A"), (0, "question", 360, "true", "1.\tTell of {n} and {m}:"), (0, "part", 720, "false", "(a)\tWhy is it so?\t1M"), (0, "part", 720, "false", "(b)\tSecond one."), (0, "continuation", 720, "false", "Go on for {m}."), (0, "part", 720, "false", "(c)\tthird"),
    (0, "part", 720, "true", "(d)\tWhich is it?"), (0, "options", 360, "false", "(a) one\t(b) two\t(c) three\t(d) four"), (0, "part", 720, "false", "(e)\tfifth"), (0, "part", 720, "false", "(f)\tsixth"), (0, "part", 720, "false", "(g)\tseventh"), (0, "part", 720, "false", "(h)\teighth"), (0, "end", 0, "false", "END"),
    (1, "heading", 0, "true", "SECTION A"), (1, "question", 360, "true", "1.\tTell of {n}:"), (1, "part", 780, "true", "(i)\tFirst one."), (1, "continuation", 780, "true", "Go on for {m}."), (1, "part", 780, "false", "(ii)\tsecond"), (1, "end", 0, "false", "END"),
]


@query("kept_lines", f"SELECT paper_id, style, CAST(indent AS INT) AS indent, keep_next = 'true' AS keep_next, {shapes._FILL.format('t')} AS text FROM ({shapes._parts(2)}) JOIN {shapes._values(_KEPT, 'shape, style, indent, keep_next, t')} USING (shape)")
def kept_lines(spark, d):
    """LAY-08: which lines keep with the next in short and long entries, and the column of lines that go on a part."""
    found = shapes.classified(spark, d, _LONG)
    return V.body(found, P.entries(found)).select("paper_id", "style", "indent", "keep_next", "text")


@query("note_paragraphs", """WITH n AS (SELECT p_partkey, p_name, p_size % 2 = 0 AS b FROM part) SELECT p_partkey, 0 AS seq, 'title' AS style, 'Review ' || p_partkey AS text, 0 AS bold, 0 AS red FROM n UNION ALL SELECT p_partkey, 1, 'source', 'Source: ' || p_name || '.docx', 0, 0 FROM n
  UNION ALL SELECT p_partkey, 3, 'heading', 'Marks', 0, 0 FROM n UNION ALL SELECT p_partkey, 4, 'bullet', CASE WHEN b THEN 'sums differ [blocking] here' ELSE 'a bold word' END, 1, CASE WHEN b THEN 1 ELSE 0 END FROM n UNION ALL SELECT p_partkey, 5, 'text', 'Done.', 0, 0 FROM n""")
def note_paragraphs(spark, d):
    """SNK-07: Markdown notes as styled paragraphs."""
    bullet = F.when(F.col("p_size") % 2 == 0, "sums differ **[blocking]** here").otherwise("a **bold** word")
    note = F.concat(F.lit("# Review "), F.col("p_partkey").cast("string"), F.lit("\nSource: "), F.col("p_name"), F.lit(".docx\n\n## Marks\n- "), bullet, F.lit("\nDone."))
    rows = V.note_paragraphs(table(spark, d, "part").select("p_partkey", note.alias("note")), "p_partkey")
    count = lambda f: F.size(F.filter("runs", lambda r: r[f]))
    return rows.select("p_partkey", "seq", "style", F.array_join(F.transform("runs", lambda r: r["text"]), "").alias("text"), count("bold").alias("bold"), count("red").alias("red"))


_SQ = lambda t: "'" + t.replace("'", "''") + "'"


@query("source_notes", f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'note' || chr(10) || {_SQ(V.PDF_NOTE)} WHEN 1 THEN 'note' || chr(10) || {_SQ(V.DOC_NOTE)} ELSE 'note' END AS note, contains('# Review — p' || page_id || chr(10) || 'Source: u', '# Review — p' || page_id) AND length(html) >= 0 AS stated FROM pages")
def source_notes(spark, d):
    """SNK-13, SNK-14."""
    k = F.col("page_id")
    name = F.when(k % 3 == 0, "a.PDF").when(k % 3 == 1, "a.doc").otherwise("a.docx")
    unreadable = V.unreadable_note(F.concat(F.lit("p"), k.cast("string")), F.col("url"), F.lit("1 Jan 2026"), F.concat(F.char_length("html").cast("string"), F.lit(" characters")))
    stated = unreadable.startswith(F.concat(F.lit("# Review — p"), k.cast("string"), F.lit("\nSource: "), F.col("url"), F.lit(" · Reviewed 1 Jan 2026 · Status"))) & unreadable.contains(F.concat(F.lit("("), F.char_length("html").cast("string"), F.lit(" characters). **[blocking]**")))
    return table(spark, d, "pages").select("page_id", V.with_provenance(F.lit("note"), name, F.lit("")).alias("note"), stated.alias("stated"))


@query("page_blocks", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS paper_id, event_id % 5 AS page, CAST(event_id AS DOUBLE) AS y0, event_id % 3 AS k, event_id FROM events) SELECT paper_id, row_number() OVER (PARTITION BY paper_id ORDER BY page, y0) - 1 AS block_pos, CASE WHEN k = 1 THEN 'table' ELSE 'p' END AS kind, CASE WHEN k = 0 THEN 'line ' || event_id ELSE '' END AS text, CASE WHEN k = 2 THEN 1 ELSE 0 END AS images, CASE WHEN k = 1 THEN CAST(event_id AS VARCHAR) END AS cell FROM e")
def page_blocks(spark, d):
    """SNK-12, SRC-09: lines, tables and pictures of pages in reading order as blocks."""
    key = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("paper_id"), (key % 5).alias("page"), key.cast("double").alias("y0"), (key % 3).alias("k"), key.cast("string").alias("id"))
    place = ["paper_id", "page", "y0"]
    out = V.blocks_of_pages(rows.where("k = 0").select(*place, F.concat(F.lit("line "), "id").alias("text")), rows.where("k = 1").select(*place, F.array(F.array("id")).alias("cells")), rows.where("k = 2").select(*place))
    return out.select("paper_id", F.col("block_pos").cast("long").alias("block_pos"), "kind", "text", "images", F.get(F.get("cells", F.lit(0)), F.lit(0)).alias("cell"))


@query("refused_targets", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'formatted/Class-VII' WHEN 1 THEN 'inbox' WHEN 2 THEN 'reviews/Class-V' WHEN 3 THEN 'formatted/Class-7' WHEN 4 THEN 'elsewhere' ELSE 'reviews' END AS target FROM orders)
  SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'folder inbox is read only' WHEN 2 THEN 'folder reviews has no sub-folders' WHEN 3 THEN 'sub-folder must be Class-<Roman numeral>, got Class-7' ELSE 'unknown folder: elsewhere' END AS refused FROM t WHERE o_orderkey % 6 IN (1, 2, 3, 4)""")
def refused_targets(spark, d):
    """FLT-12."""
    k = F.col("o_orderkey") % 6
    target = F.when(k == 0, "formatted/Class-VII").when(k == 1, "inbox").when(k == 2, "reviews/Class-V").when(k == 3, "formatted/Class-7").when(k == 4, "elsewhere").otherwise("reviews")
    return V.checked_targets(table(spark, d, "orders").select("o_orderkey", target.alias("target")), "target", ["formatted", "needs-fixes", "reviews"], ["formatted"])[1].select("o_orderkey", "refused")


@query("file_infos", "SELECT CAST(page_id AS VARCHAR) AS id, 'f' || page_id || '.docx' AS name, 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' AS mime_type, length(html) AS size, '2026-01-02T03:04:05Z' AS modified, '' AS sub, url AS owner FROM pages")
def file_infos(spark, d):
    """PRJ-01."""
    key = F.col("page_id").cast("string")
    rows = table(spark, d, "pages").select(key.alias("id"), F.concat(F.lit("f"), key, F.lit(".docx")).alias("name"), F.char_length("html").cast("long").alias("size"), F.lit("2026-01-02 03:04:05").cast("timestamp").alias("modified"), F.lit(None).cast("string").alias("sub"), F.col("url").alias("owner"))
    return V.file_info(rows, "inbox")


@query("run_slices", "WITH r AS (SELECT p_partkey, p_name || '-' || p_type AS t, length(p_name) AS a, length(p_type) AS b, p_partkey % 12 AS x FROM part) SELECT p_partkey, substr(t, x + 1, 9) AS text, CASE WHEN x < a THEN 1 ELSE 0 END + CASE WHEN x <= a AND x + 9 > a THEN 1 ELSE 0 END + CASE WHEN x + 9 > a + 1 AND x < a + 1 + b THEN 1 ELSE 0 END AS runs FROM r")
def run_slices(spark, d):
    """FN-12: nine characters across three runs."""
    run = lambda c, bold: F.struct(c.alias("text"), F.lit(bold).alias("bold"))
    runs = F.array(run(F.col("p_name"), True), run(F.lit("-"), False), run(F.col("p_type"), False))
    start = (F.col("p_partkey") % 12).cast("int")
    rows = table(spark, d, "part").select("p_partkey", S.slice_runs(runs, start, start + 9).alias("r"))
    return rows.select("p_partkey", F.array_join(F.transform("r", lambda x: x["text"]), "").alias("text"), F.size("r").alias("runs"))


@query("distinct_sets", "SELECT doc_id, len(list_distinct(string_split(text, ' '))) AS words FROM documents WHERE text IS NOT NULL")
def distinct_sets(spark, d):
    """SET-03."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.size(F.array_distinct(F.split("text", " "))).cast("long").alias("words"))


@query("header_and_body", "SELECT doc_id AS id, 'header' AS part, lang AS text FROM documents UNION ALL SELECT doc_id, 'body', sha256(text) FROM documents")
def header_and_body(spark, d):
    """SET-02."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.lit("header").alias("part"), F.col("lang").alias("text")).unionByName(docs.select(F.col("doc_id").alias("id"), F.lit("body").alias("part"), F.sha2("text", 256).alias("text")))
