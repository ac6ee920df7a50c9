"""Papers of many shapes: each part becomes a small paper of one of the shapes below, with its key and size in the text.

What a shape must give stands beside its lines and is what the SQL returns; it was written by hand from the rules, not
by the classifier. {n} is the part's key, {m} its size.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import papers as P
from ..operators import rules as R
from .registry import query, stored, table

# Each shape: lines ("..." text, ^ centred, [[...]] table, # picture), then questions (number, alt, marks, source, parts, options)
# and sections (letter, sum, expected, verdict). Marks that are a size are written as 'm'.
SHAPES: list[tuple[list, list, list]] = [
    (["Section A (5 marks)", "1. Why is {n} odd? 2M 2. How big is {m}? [3]"], [(1, None, 2, "paper", 0, 0), (2, None, 3, "paper", 0, 0)], [("A", 5, 5, "fine")]),
    (["Section A (4 marks)", "1. First of {n}.", "2M  2. Second of {n}.", "3M 3. Third.", "4. Last. 1M"], [(1, None, 2, "paper", 0, 0), (2, None, 3, "paper", 0, 0), (3, None, None, None, 0, 0), (4, None, 1, "paper", 0, 0)], [("A", 6, 4, "blocking")]),
    (["Section A (2 * 1 = 2)", "1. Is {n} prime?", "2. Is {m} prime?"], [(1, None, 1, "section", 0, 0), (2, None, 1, "section", 0, 0)], [("A", 2, 2, "fine")]),
    (["Section A (5 marks)", "Q.1. A) Write a letter about {n}.", "B) Write a story about {m}. 5M"], [(1, None, 5, "alternative A/B", 1, 0)], [("A", 5, 5, "fine")]),
    (["Section A", "1. (a) Label part {n}. 3M", "(b) Colour it. 2M"], [(1, None, 5, "stem and sub-parts", 1, 0)], [("A", 5, None, "fine")]),
    (["Section A (6 marks)", "1. Do any two of these:", "(a) add {n} 3M", "(b) halve {n} 3M", "(c) draw {m} 3M"], [(1, None, 6, "any N", 3, 0)], [("A", 6, 6, "fine")]),
    (["Section A", "Q.1. Answer:", "1) What is {n}? 2M", "2) What is {m}? 1M", "Q.2. Name it. 1M"], [(1, None, 3, "sum of sub-parts", 2, 0), (2, None, 1, "paper", 0, 0)], [("A", 4, None, "fine")]),
    (["Section A (3 marks)", "Answer the following in brief.", "1. Tell of {n}.", "OR", "1. Tell of {m}. 3M"], [(1, None, 3, "OR twin", 0, 0), (1, None, 3, "paper", 0, 0)], [("A", 3, 3, "fine")]),
    (["Section A", "Each question has one mark. (1×2=2)", "1. Which is {n}? a) one b) two c) {n} d) four", "2. Which is {m}?", "(a) ten\t(c) {m}", "(b) six\t(d) none"], [(1, None, 1, "section", 0, 4), (2, None, 1, "section", 0, 4)], [("A", 2, 2, "fine")]),
    (["Section A (4 marks)", "Q.1. Choose for {n}. (2x1=2) 1) It is", "a) hot  b) cold", "c) dry  d) wet", "Q.2. The side of {m} is", "(a) short", "(b) long", "(c) wide", "(d) none 2M"], [(1, None, 2, "paper", 1, 4), (2, None, None, None, 4, 0)], [("A", 2, 4, "add the missing marks")]),
    (["Section A (4 marks)", "1. Pick the right one for {n}. 4M", [["a)", "What is the size of it?\n(i)\n{m}\n(ii)\nnone"], ["b)", "What is the key of it?\n(i)\n{n}\n(ii)\nnone"]], [["", ""], ["", ""]]], [(1, None, 4, "paper", 2, 4)], [("A", 4, 4, "fine")]),
    (["Section A (7 marks)", [["1. In the box: what is {n}? 3M\nThink of {m}."], [""]], "Q.I. A Roman one. 4M"], [(1, None, 3, "paper", 0, 0), (1, None, 4, "paper", 0, 0)], [("A", 4, 7, "blocking")]),
    (["1. Before {n}. 2M", "2. After {n}. 3M", "^Grammar", "1. Again {m}. 4M"], [(1, None, 2, "paper", 0, 0), (2, None, 3, "paper", 0, 0), (1, None, 4, "paper", 0, 0)], [(None, 5, None, "fine"), (None, 4, None, "fine")]),
    (["Section A: Reading", "Section A: Reading (2 marks)", "1. Read of {n}. 2M", "Section A: II. Writing (3 marks)", "2. Write of {m}. 3M"], [(1, None, 2, "paper", 0, 0), (2, None, 3, "paper", 0, 0)], [("A", 5, 5, "fine")]),
    (["Section A (4 marks)", "Answer any 2 of the 3 questions. (2x2=4)", "1. One {n}.", "2. Two {n}.", "3. Three {m}."], [(1, None, 2, "group instruction", 0, 0), (2, None, 2, "group instruction", 0, 0), (3, None, 2, "group instruction", 0, 0)], [("A", 4, 4, "fine")]),
    (["Section A (5 marks) Q. 1. Glued to {n}. (1x5=5)", "--------  SECTION B - NEXT (2 MARKS)", "2. Look at the figure of {n}. 2M", "#"], [(1, None, 5, "paper", 0, 0), (2, None, 2, "paper", 0, 0)], [("A", 5, 5, "fine"), ("B", 2, 2, "fine")]),
]
#: Items that neighbours make: (shape, question's number, item, label, text, options or cells, as text), of the shapes below.
ITEMS: list[tuple] = [
    (0, 1, "stem", None, "The side of {n} is as long as the side of {m}.", None), (0, 2, "stem", None, "Match:", None), (0, 2, "pairs", None, None, "Left|Right|{n}|x|{m}|y"),
    (1, 1, "stem", None, "Which one is {n}?", None), (1, 1, "opts", None, None, "(a) p|(b) q|(c) r|(d) s"), (1, 2, "tables", None, None, "1|2"), (1, 2, "stem", None, "Draw {m}.", None), (1, 2, "or", "glued", None, None),
]
MORE: list[list] = [
    ["Section A", "1. The side of {n} is as long as", "the side of {m}.", "2. Match:", "Left\tRight", "{n}\tx", "{m}\ty"],
    ["Section A", "1. Which one is {n}?", "(a) p", "(b) q", "(c) r", "(d) s", "~[[1]]", "~[[2]]", "2. Draw {m}. OR"],
]


def _rows(family: list[list]):
    for shape, each in enumerate(family):
        for k, line in enumerate(each):
            if isinstance(line, list):
                yield shape, k, "table", "", None, 0, line, False
            elif line.startswith("~"):
                yield shape, k, "table", "", None, 0, [[line.strip("~[]")]], True
            else:
                yield shape, k, "p", line.lstrip("^#"), "center" if line[0] == "^" else None, int(line[0] == "#"), None, False


def blocks(spark, d, family: list[list]):
    shapes = spark.createDataFrame(list(_rows(family)), "shape int, block_pos int, kind string, text string, align string, images int, cells array<array<string>>, floating boolean")
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("paper_id"), (F.col("p_partkey") % len(family)).cast("int").alias("shape"), F.col("p_size").cast("string").alias("m"))
    filled = lambda c: F.replace(F.replace(c, F.lit("{n}"), F.col("paper_id")), F.lit("{m}"), F.col("m"))
    return part.join(F.broadcast(shapes), "shape").withColumns({"text": filled(F.col("text")), "cells": F.transform("cells", lambda r: F.transform(r, filled))}).drop("m")


def classified(spark, d, family: list[list]):
    return stored(P.items(P.lines(blocks(spark, d, family))))


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names})"


FIRST = [x for x, _, _ in SHAPES]


def _parts(n: int) -> str:
    return f"SELECT CAST(p_partkey AS VARCHAR) AS paper_id, p_partkey % {n} AS shape, CAST(p_size AS VARCHAR) AS m FROM part"


_FILL = "replace(replace({0}, '{{n}}', paper_id), '{{m}}', m)"


@query("shape_questions", f"SELECT paper_id, number, alt, CAST(marks AS DOUBLE) AS marks, marks_source, parts, options FROM ({_parts(len(SHAPES))}) JOIN {_values([(s, *q) for s, (_, qs, _) in enumerate(SHAPES) for q in qs], 'shape, number, alt, marks, marks_source, parts, options')} USING (shape)")
def shape_questions(spark, d):
    """WN-24, WN-27, WN-28, WN-11, WN-14, JN-11, AG-17, FLT-08, PRJ-11, FN-17, M1-M10 over whole papers."""
    rows = P.questions(classified(spark, d, FIRST))
    return rows.select("paper_id", "number", "alt", "marks", "marks_source", F.col("subs").cast("int").alias("parts"), F.col("options").cast("int").alias("options"))


@query("shape_sections", f"SELECT paper_id, letter, CAST(sum AS DOUBLE) AS sum, CAST(expected AS DOUBLE) AS expected, verdict FROM ({_parts(len(SHAPES))}) JOIN {_values([(s, *x) for s, (_, _, xs) in enumerate(SHAPES) for x in xs], 'shape, letter, sum, expected, verdict')} USING (shape)")
def shape_sections(spark, d):
    """WN-26, JN-06, AG-02 to AG-04, R02-R05: sections by their headings, instruction lines and parts."""
    return P.sections(P.entries(classified(spark, d, FIRST))).select("paper_id", "letter", "sum", "expected", "verdict")


@query("shape_items", f"SELECT paper_id, number, item, label, {_FILL.format('t')} AS text, {_FILL.format('held')} AS held FROM ({_parts(len(MORE))}) JOIN {_values(ITEMS, 'shape, number, item, label, t, held')} USING (shape)")
def shape_items(spark, d):
    """WN-06, WN-08, WN-09, WN-16, R20: broken lines joined, matching columns, options one to a line, tables side by side, glued OR."""
    found = classified(spark, d, MORE)
    held = F.coalesce(F.array_join("options", "|"), F.array_join(F.flatten("cells"), "|"))
    return found.where("number is not null").select("paper_id", "number", "item", "label", "text", held.alias("held"))


# Entries as operators.papers gives them, made from documents: the stem is the whole text, the rest hangs on the id.
_ENTRY_SQL = """SELECT doc_id, text, trim(text) = '' AS blank, doc_id % 3 = 0 AS has_cont, CASE doc_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 5 END AS options, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 2 END AS n_items, doc_id % 5 = 0 AS has_figure, doc_id % 7 = 0 AS or_glued, doc_id % 9 = 0 AS bare,
  CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS per, CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN ['(a)', '(b)'] WHEN 2 THEN ['(a)', '(c)'] WHEN 3 THEN ['(A)', '(b)', '(a)'] ELSE ['(i)', '(x)'] END AS subs FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"""
_RULE_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, '{rule}' AS rule, {message} AS message, {blocking} AS blocking FROM e WHERE {test}"
    for rule, message, blocking, test in [
        ("R20", "'\"OR\" at the end of a sentence'", "false", "or_glued"),
        ("R21", "'question has no text'", "true", "blank AND len(subs) = 0 AND options = 0"),
        ("R22", "'starts with a stray \"' || left(text, 1) || '\"'", "false", "regexp_matches(text, '^[.,;:]')"),
        ("R23", "'sub-part labels run ' || CASE doc_id % 5 WHEN 2 THEN '(a), (c)' ELSE '(a), (b), (i)' END", "false", "doc_id % 5 = 2 AND NOT regexp_matches(text, '(?i)^\\(?[a-h]\\)')"),
        ("R24", "options || ' options'", "false", "per = 1 AND options > 0 AND options <> 4 AND NOT regexp_matches(text, '(?i)assertion')"),
        ("R25", "'options are pictures: labels only'", "false", "bare"),
        ("R26", "'\"(marks)\" placeholder'", "false", "regexp_matches(text, '(?i)\\(\\s*marks?\\s*\\)')"),
        ("R27", "'degree written with the letter \"o\"'", "false", "regexp_matches(text, '\\b(\\d+)\\s*[oO]\\b') AND NOT contains(text, '°')"),
        ("R28b", "'\"IS\" in capitals'", "false", "regexp_matches(text, '\\b[A-Z]{2,}\\s+IS\\b|\\sIS_+')"),
        ("R29a", "'\"Rs\" for the rupee sign'", "false", "regexp_matches(text, '\\bRs\\.?\\s*\\d')"),
        ("R30a", "'unit power written with a dot'", "false", "regexp_matches(text, '\\b\\d+\\s*(?:m|cm|kg|g|km)\\s*\\.\\s*\\d\\b')"),
        ("R30b", "'\"Kg\" for kg'", "false", "regexp_matches(text, '\\bKg\\b')"),
        ("R31", "'repeated word'", "false", "regexp_matches(text, '(?i)" + "|".join(rf"\b{w}\s+{w}\b" for w in R.REPEATABLE) + "')"),
        ("R32", "'no punctuation at the end of the question'", "false", "NOT has_cont AND (options > 0 OR n_items = 1) AND regexp_matches(text, '[A-Za-z0-9]$') AND NOT regexp_matches(text, '(?i)^\\(?[a-h]\\)')"),
    ]
)


@query("entry_findings", f"WITH e AS ({_ENTRY_SQL}) {_RULE_ROWS}")
def entry_findings(spark, d):
    """R20-R32 with the conditions on an entry, over the whole texts of documents."""
    k = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    of = lambda *labels: F.array(*map(F.lit, labels))
    rows = table(spark, d, "documents").select(
        "doc_id", text.alias("stem"), text.alias("all_text"), (k % 3 == 0).alias("has_cont"), F.when(k % 4 == 0, 0).when(k % 4 == 1, 4).when(k % 4 == 2, 3).otherwise(5).alias("options"), F.when(k % 6 == 0, 1).otherwise(2).alias("n_items"), (k % 5 == 0).alias("has_figure"), (k % 7 == 0).alias("or_glued"), (k % 9 == 0).alias("bare_options"),
        F.when(k % 2 == 0, 1).otherwise(2).alias("per"), F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, of("(a)", "(b)")).when(k % 5 == 2, of("(a)", "(c)")).when(k % 5 == 3, of("(A)", "(b)", "(a)")).otherwise(of("(i)", "(x)")).alias("sub_labels"),
    )
    rules = [r for r in R.entry_rules() if r[0] not in ("R28a", "R29b", "R33", "R33m")]  # lookaheads, which the SQL engine lacks
    return R.findings(rows, "doc_id", rules).select("doc_id", "rule", "message", "blocking")


@query("figure_findings", """WITH t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'In the given figure find ' || p_name || '.' WHEN 1 THEN 'Draw a diagram of ' || p_name || '.' WHEN 2 THEN 'On the map of India mark ' || p_name || '.' WHEN 3 THEN 'Observe the picture of ' || p_name || '.' ELSE 'What is ' || p_name || '?' END AS s, p_size % 2 = 0 AS f FROM part)
  SELECT p_partkey, CASE WHEN regexp_matches(s, 'map') THEN 'R33m' ELSE 'R33' END AS rule, NOT regexp_matches(s, 'map') AS blocking FROM t WHERE NOT f AND p_partkey % 5 IN (0, 2, 3)""")
def figure_findings(spark, d):
    """R33, FLT-15: a figure that is asked for and not there blocks, a map is a note, a drawing task is neither."""
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("In the given figure find "), n, F.lit("."))).when(k == 1, F.concat(F.lit("Draw a diagram of "), n, F.lit("."))).when(k == 2, F.concat(F.lit("On the map of India mark "), n, F.lit("."))).when(k == 3, F.concat(F.lit("Observe the picture of "), n, F.lit("."))).otherwise(F.concat(F.lit("What is "), n, F.lit("?")))
    rows = table(spark, d, "part").select("p_partkey", text.alias("text"), (F.col("p_size") % 2 == 0).alias("f"))
    rules = [r for r in R.wording_rules(F.col("text"), has_figure=F.col("f")) if r[0] in ("R33", "R33m")]
    return R.findings(rows, "p_partkey", rules).select("p_partkey", "rule", "blocking")


@query("garbled_papers", "SELECT p_partkey, 'garbled Devanagari: ' || (p_size + 1) || ' of ' || (2 * (p_size + 1)) || ' signs stand alone' AS message FROM part WHERE p_partkey % 3 = 0 AND 2 * (p_size + 1) >= 20")
def garbled_papers(spark, d):
    """R01: of each third paper's signs every other one stands alone; in the others all follow a letter."""
    text = F.when(F.col("p_partkey") % 3 == 0, F.repeat(F.lit("का ि "), F.col("p_size") + 1)).otherwise(F.repeat(F.lit("का कि "), F.col("p_size") + 1))
    return R.findings(table(spark, d, "part").select("p_partkey", text.alias("text")), "p_partkey", R.garbled_rule(F.col("text"))).select("p_partkey", "message")
