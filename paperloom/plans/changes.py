"""What formatting changed in papers of two shapes, with the questions that it touched."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import changes as C
from ..operators import papers as P
from . import shapes
from .registry import query, stored

#: "<-" stands for a drawn arrow, "!!" for what is highlighted, "=" at the end for an equation.
FAMILY = [
    ["SECTION: FIRST OF {n}\t5M", "1. Turn it by 90o at {n}. 2M", "2. Draw an arrow <- to {m}. 3M", "(a) Heat to 30o", "(b) Cool to 10o", "(c) Leave at 20o", "(d) none"],
    ["<-", "Section A (5 marks)", [["1. In the box: what is {n}? 4M\nThink of {m}."], [""]], [["", ""], ["", ""]], "2. Keep this !!flag {m} 1M", "and solve it ="],
]
_EXPECTED = [
    (0, "lettered", 1, None, "A: SECTION: FIRST OF {n}\t5M"), (0, "degree", 1, 1, "Turn it by 90° at {n}."), (0, "shape", 1, 2, "1"), (0, "degree", 1, 2, "(a) Heat to 30° (b) Cool to 10° (c) Leave at 20° (d) none"),
    (1, "shape outside", None, None, "1"), (1, "unwrapped", None, None, "1"), (1, "empty table", None, None, "1"), (1, "highlight", 1, 2, "flag {m}"), (1, "equation", 1, 2, "1"),
]


def papers(spark, d):
    blocks = shapes.blocks(spark, d, FAMILY)
    count = lambda c, mark: F.when(c.contains(mark), 1).otherwise(0)
    flag = F.regexp_extract("text", r"!!(flag \d+)", 1)
    runs = F.array(F.struct(F.lit("Keep this ").alias("text"), F.lit(False).alias("highlight")), F.struct(flag.alias("text"), F.lit(True).alias("highlight")))
    blocks = stored(blocks.withColumns({"shapes": count(F.col("text"), "<-"), "equations": count(F.col("text"), " ="), "runs": F.when(flag != "", runs)}))
    lines = P.lines(blocks)
    return blocks, lines, stored(P.items(lines))


@query("paper_changes", f"SELECT paper_id, kind, section_no, number, {shapes._FILL.format('detail')} AS detail FROM ({shapes._parts(2)}) JOIN {shapes._values(_EXPECTED, 'shape, kind, section_no, number, detail')} USING (shape)")
def paper_changes(spark, d):
    """R34 to R37: the kinds of changes, from the papers themselves."""
    return C.changes(*papers(spark, d))


_LINES = [(0, 2, "Section heading without a letter given the next letter: A: SECTION: FIRST OF {n}\t5M. Confirm."), (0, 5, 'Degree signs: "o" after a number set as ° in Q.1, Q.2.'), (0, 8, "Drawing objects could not be carried over in Q.2 — check what stood there."), (1, 3, "1 table(s) used only for layout unwrapped into normal questions and option rows."), (1, 4, "1 empty table(s) dropped."), (1, 6, "1 equation object(s) set as plain text — verify they read correctly."), (1, 7, 'Teacher highlights kept as reviewer flags in Q.2: "flag {m}".'), (1, 9, "1 drawing object(s) outside the questions were dropped.")]


@query("change_lines", f"SELECT paper_id, seq, {shapes._FILL.format('line')} AS line FROM ({shapes._parts(2)}) JOIN {shapes._values(_LINES, 'shape, seq, line')} USING (shape)")
def change_lines(spark, d):
    """R34 to R37: the lines of the review note."""
    return C.change_lines(C.changes(*papers(spark, d)))
