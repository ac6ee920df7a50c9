"""R34 to R37: what formatting changed, as rows: (paper_id, kind, section_no, number, detail).

Each step that rewrites something hands out what it did next to its result: degree signs and letters of headings from
the classified items, tables that only laid out or were empty from blocks against the lines that came of them, drawn
shapes, equations and highlights from the blocks. What a block holds belongs to the question whose item is the last
at or above it, which one sort of a paper's items and blocks tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Kinds of changes in the order of the note, and their sentences; {n} is their number, {where} the questions, {what} the details.
SENTENCES = {
    "renamed": "File renamed {what}.",
    "lettered": "Section heading without a letter given the next letter: {what}. Confirm.",
    "unwrapped": "{n} table(s) used only for layout unwrapped into normal questions and option rows.",
    "empty table": "{n} empty table(s) dropped.",
    "degree": 'Degree signs: "o" after a number set as ° in {where}.',
    "equation": "{n} equation object(s) set as plain text — verify they read correctly.",
    "highlight": "Teacher highlights kept as reviewer flags in {where}: {what}.",
    "shape": "Drawing objects could not be carried over in {where} — check what stood there.",
    "shape outside": "{n} drawing object(s) outside the questions were dropped.",
}
COLUMNS = ["paper_id", "kind", "section_no", "number", "detail"]


def degrees(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with degree signs for the letters that stand for them, in texts and options, and the changes."""
    fixed = classified.withColumns({"__text": T.fix_degrees(F.col("text")), "__options": F.transform("options", T.fix_degrees)})
    changed = ~F.col("__text").eqNullSafe(F.col("text")) | ~F.col("__options").eqNullSafe(F.col("options"))
    events = fixed.where(changed).select("paper_id", F.lit("degree").alias("kind"), "section_no", "number", F.coalesce("__text", F.array_join("__options", " ")).alias("detail"))
    return fixed.withColumns({"text": F.col("__text"), "options": F.col("__options")}).drop("__text", "__options"), events


def located(found: DataFrame, classified: DataFrame) -> DataFrame:
    """found (paper_id, block_pos, ...) with section_no and number of the last question's item at or above each block; null outside questions."""
    own = classified.where("block_pos is not null").select("paper_id", "block_pos", F.struct("section_no", "entry_no", "item_no", "number").alias("__item"), F.lit(0).alias("__kind"))
    both = found.withColumns({"__item": F.lit(None).cast(own.schema["__item"].dataType), "__kind": F.lit(1)}).unionByName(own, allowMissingColumns=True)
    order = Window.partitionBy("paper_id").orderBy("block_pos", "__kind", "__item.section_no", "__item.entry_no", "__item.item_no")
    last = F.last("__item", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("__last", last).where("__kind = 1").withColumns({"section_no": F.col("__last.section_no"), "number": F.col("__last.number")}).drop("__item", "__kind", "__last")


def _of_blocks(blocks: DataFrame, classified: DataFrame) -> DataFrame:
    """Shapes, equations and highlights, with their questions, in one pass over the blocks."""
    has = lambda c, otherwise: F.col(c) if c in blocks.columns else otherwise
    count = lambda c: F.coalesce(has(c, F.lit(0)), F.lit(0))
    flagged = F.filter(F.col("runs"), lambda r: r["highlight"]) if "runs" in blocks.columns else F.array().cast("array<struct<text:string>>")
    marked = F.array_join(F.transform(flagged, lambda r: r["text"]), " ")
    one = lambda kind, test, detail: F.when(test, F.struct(F.lit(kind).alias("kind"), detail.alias("detail")))
    kinds = F.array_compact(F.array(one("shape", count("shapes") > 0, count("shapes").cast("string")), one("equation", count("equations") > 0, count("equations").cast("string")), one("highlight", F.coalesce(marked != "", F.lit(False)), F.substring(marked, 1, 40))))
    rows = blocks.select("paper_id", "block_pos", F.explode(kinds).alias("e")).select("paper_id", "block_pos", "e.kind", "e.detail")
    found = located(rows, classified)
    outside = (F.col("kind") == "shape") & F.col("number").isNull()
    return found.withColumns({"kind": F.when(outside, "shape outside").otherwise(F.col("kind")), "section_no": F.when(F.col("number").isNotNull(), F.col("section_no"))}).select(COLUMNS)


def _of_tables(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Tables that gave lines or options, and those that gave nothing."""
    gave = lines.groupBy("paper_id", "block_pos").agg(F.bool_or(F.col("kind") == "table").alias("kept"))
    joined = blocks.where("kind = 'table'").select("paper_id", "block_pos").join(gave, ["paper_id", "block_pos"], "left")
    kind = F.when(F.col("kept").isNull(), "empty table").when(~F.col("kept"), "unwrapped")
    return joined.withColumn("kind", kind).where("kind is not null").select("paper_id", "kind", F.lit(None).cast("int").alias("section_no"), F.lit(None).cast("int").alias("number"), F.lit("1").alias("detail"))


def changes(blocks: DataFrame, lines: DataFrame, classified: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """All changes of papers; names (paper_id, base, file_name) for those that are filed under another name."""
    none = F.lit(None).cast("int")
    lettered = classified.where("item = 'heading without letter'").select("paper_id", F.lit("lettered").alias("kind"), "section_no", none.alias("number"), F.concat(F.col("letter"), F.lit(": "), F.col("text")).alias("detail"))
    out = degrees(classified)[1].unionByName(lettered).unionByName(_of_blocks(blocks, classified)).unionByName(_of_tables(blocks, lines))
    if names is not None:
        new = F.concat("base", F.lit(".docx"))
        out = out.unionByName(names.where(new != F.col("file_name")).select("paper_id", F.lit("renamed").alias("kind"), none.alias("section_no"), none.alias("number"), F.concat("file_name", F.lit(" → "), new).alias("detail")))
    return out


def change_lines(events: DataFrame) -> DataFrame:
    """(paper_id, seq, line): a sentence for each kind of change, with its questions in order."""
    once = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "number", c.alias("x")))), lambda s: s["x"])), ", ")
    where = F.when(F.col("number").isNotNull(), F.concat(F.lit("Q."), F.col("number").cast("string")))
    counted = F.sum(F.when(F.col("kind").isin("shape", "shape outside", "equation"), F.col("detail").cast("int")).otherwise(1))
    quoted = F.when(F.col("kind") == "highlight", F.concat(F.lit('"'), F.col("detail"), F.lit('"'))).otherwise(F.col("detail"))
    by_kind = events.groupBy("paper_id", "kind").agg(counted.cast("string").alias("n"), once(where).alias("where"), once(quoted).alias("what"))
    order = F.array_position(F.array(*map(F.lit, SENTENCES)), F.col("kind"))
    sentence = F.element_at(F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv]), F.col("kind"))
    line = _fill(_fill(_fill(sentence, "{n}", F.col("n")), "{where}", F.col("where")), "{what}", F.col("what"))
    return by_kind.select("paper_id", order.cast("int").alias("seq"), line.alias("line"))


def _fill(text: Column, name: str, value: Column) -> Column:
    return F.replace(text, F.lit(name), F.coalesce(value, F.lit("")))
