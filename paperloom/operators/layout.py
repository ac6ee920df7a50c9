"""Layout: pieces and tables of a page, and the plan of a rendered paper.

Text pieces are rows (page, x0, y0, x1, y1, text). Rows and lines that hang on the ones before them are in pages.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Distance of page numbers from the edge in points, patterns of page numbers and instructing verbs.
EDGE = 50.0
PAGE_NUMBER = r"(?i)^\s*(page\s*\d+(\s*(of|/)\s*\d+)?|\d+\s*(of|/)\s*\d+|-?\s*\d+\s*-?)\s*$"
UMBRELLA = r"(?i)^(answer|attempt|choose|select|tick|fill|match|read|complete|do as directed|solve|unscramble|rearrange|arrange|identify|observe|name|define|give|state|write|put|mark|circle|classify|categori[sz]e|find|correct|rewrite|change|convert|expand|frame|make|pick|underline|very short|short|long|case[- ]based|hots|application)\b"
TABLE_UMBRELLA = r"(?i)^(answer|attempt|match|complete|fill)"


def outside_boxes(pieces: DataFrame, boxes: DataFrame, page: str) -> DataFrame:
    """JN-08: pieces that no table box of their page contains, or overlaps by more than half of the piece."""
    p, b = pieces.alias("p"), boxes.alias("b")
    width = F.least(F.col("p.x1"), F.col("b.x1")) - F.greatest(F.col("p.x0"), F.col("b.x0"))
    height = F.least(F.col("p.y1"), F.col("b.y1")) - F.greatest(F.col("p.y0"), F.col("b.y0"))
    area = (F.col("p.x1") - F.col("p.x0")) * (F.col("p.y1") - F.col("p.y0"))
    test = (F.col(f"p.{page}") == F.col(f"b.{page}")) & (width > 0) & (height > 0) & (width * height > 0.5 * area)
    return p.join(b, test, "left_anti")


def without_page_numbers(pieces: DataFrame, page_height: Column) -> DataFrame:
    """FLT-06: page numbers go near the top or bottom only."""
    return pieces.where(~(F.col("text").rlike(PAGE_NUMBER) & ((F.col("y0") < EDGE) | (F.col("y1") > page_height - EDGE))))


def stacked_fractions(rows: DataFrame, page: str) -> DataFrame:
    """JN-09, WN-25: a whole number over another, centred within eight points and at most twelve below, is a fraction on one line."""
    w = Window.partitionBy(page).orderBy("y0", "x0")
    centre = (F.col("x0") + F.col("x1")) / 2
    lead, lag = (lambda c: F.lead(c).over(w)), (lambda c: F.lag(c).over(w))
    over = F.col("text").rlike(r"^\d+$") & lead(F.col("text")).rlike(r"^\d+$") & (F.abs(lead(centre) - centre) < 8) & (lead("y0") - F.col("y0")).between(0.001, 12)
    marked = rows.withColumn("__over", F.coalesce(over, F.lit(False))).withColumn("__below", lead("text"))
    return marked.withColumn("__taken", F.coalesce(F.lag("__over").over(w), F.lit(False))).where("not __taken or __over").withColumn("text", F.when(F.col("__over"), F.concat("text", F.lit("/"), "__below")).otherwise(F.col("text"))).drop("__over", "__below", "__taken")


def good_table(area: Column, page_area: Column, rows: Column, columns: Column, header_cells: Column, longest: Column) -> Column:
    """FLT-07: small, at least two by two, a filled header row and no very long cell."""
    return (area >= 400) & (rows >= 2) & (columns >= 2) & (area <= 0.35 * page_area) & (header_cells >= F.greatest(F.lit(2), F.floor(columns / 2))) & (longest <= 120)


def umbrella(stem: Column, subs: Column, pairs: Column, table: Column | None = None) -> Column:
    """FLT-14: a stem that only introduces its parts, its matching columns or, after some verbs, its table."""
    own = F.regexp_replace(F.trim(stem), r"^\(?[A-Za-z]\)\s*", "")
    below = (subs >= 2) | pairs if table is None else (subs >= 2) | pairs | (table & F.trim(stem).rlike(TABLE_UMBRELLA))
    return (F.trim(stem) != "") & (F.char_length(F.trim(stem)) <= 140) & ~stem.contains("?") & own.rlike(UMBRELLA) & below


def plan(questions: DataFrame, paper: str) -> DataFrame:
    """LAY-03, LAY-04, LAY-08: style, indent and whether to keep with the next line, for each question in order."""
    w = Window.partitionBy(paper).orderBy("section_no", "entry_no")
    style = F.when(umbrella(F.col("stem"), F.col("subs"), F.lit(False)), "sub-heading").otherwise("question")
    return questions.select(paper, F.row_number().over(w).alias("seq"), style.alias("style"), F.lit(360).alias("indent"), ((F.col("subs") > 0) | (F.col("options") > 0)).alias("keep_next"), F.concat(F.col("number").cast("string"), F.lit(".")).alias("label"), "stem")
