"""Names, folders, superseded files, run results and the tracker.

Listings are rows (id, name, mime, size, modified, folder, sub, owner). Where the original walks papers one by
one and remembers names taken, a rank by modification time within each name gives the same answer in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ROMAN

# Labels of statuses and folders, and the tracker's columns in their order.
STATUS_LABELS = {"formatted": "Formatted", "needs-fixes": "Needs fixes", "unreadable": "Unreadable", "recovered": "Recovered", "error": "Error"}
TRACKER = ["date", "paper", "class", "subject", "exam", "session", "status", "marks", "header_marks", "sections", "questions", "blocking", "other_points", "filed_in", "owner", "link", "note"]


def is_paper(name: Column, mime: Column) -> Column:
    """FLT-01: .docx, .doc and .pdf by name or MIME type."""
    return F.lower(name).rlike(r"\.(docx?|pdf)$") | mime.isin("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/msword", "application/pdf")


def split_inbox(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-13, SET-01: papers and the rest, which keeps repeated rows."""
    test = F.coalesce(is_paper(F.col("name"), F.col("mime")), F.lit(False))
    return files.where(test), files.where(~test)


def name_parts(name: Column) -> Column:
    """PRJ-04: subject, class, exam and session of a name; blank if there are fewer parts."""
    return F.struct(*[F.split_part(name, F.lit("_"), F.lit(k)).alias(c) for k, c in enumerate(("subject", "cls", "exam", "session"), 1)])


def destination(folder: Column, name: Column) -> Column:
    """PRJ-05: the folder, and below it Class-<numeral> where the name's second part is a class."""
    cls = F.split_part(name, F.lit("_"), F.lit(2))
    return F.when(cls.isin(ROMAN) & folder.isin("formatted", "needsfixes", "archive"), F.concat(folder, F.lit("/Class-"), cls)).otherwise(folder)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """STR-03, JN-05: marks rows that a later attempt of the same key supersedes."""
    return rows.withColumn("superseded", F.row_number().over(Window.partitionBy(key).orderBy(*order)) > 1)


def superseded_notes(notes: DataFrame, files: DataFrame) -> DataFrame:
    """JN-05: review notes whose source file is listed again: note and file are both retired."""
    return notes.join(files.select(F.col("name").alias("source"), F.col("id").alias("file_id")), "source")


def taken_names(rows: DataFrame, listing: DataFrame, key: str, taken: bool = True) -> DataFrame:
    """JN-04."""
    return rows.join(listing.select(key).distinct(), key, "left_semi" if taken else "left_anti")


def in_tree(files: DataFrame, folders: DataFrame, roots: Column) -> DataFrame:
    """JN-14: files whose folder, or whose class folder's parent, is one of the pipeline's."""
    parents = folders.select(F.col("folder_id").alias("parent"), F.col("parent_id").alias("grandparent"), F.col("name").alias("folder_name"))
    placed = files.join(parents, "parent", "left")
    return placed.where(placed.parent.isin(roots) if not isinstance(roots, Column) else roots)


def run_summary(results: DataFrame, status: str = "status") -> DataFrame:
    """AG-09, SNK-08: one row of counts by status."""
    count = lambda s: F.count_if(F.col(status) == s)
    return results.agg(F.count("*").alias("processed"), count("formatted").alias("formatted"), count("needs-fixes").alias("needs_fixes"), count("recovered").alias("recovered"), count("unreadable").alias("unreadable"), count("error").alias("errors"))


def tracker_rows(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """PRJ-02, JN-13: the fixed columns in order; columns without a value are empty text."""
    return rows.select(*[F.coalesce(values[c].cast("string"), F.lit("")).alias(c) if c in values else F.lit("").alias(c) for c in TRACKER])


def status_label(status: Column) -> Column:
    """PRJ-03."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_LABELS.items() for x in kv]), status), status)


def compose_mail(name: Column, status: Column, blocking: Column, others: Column) -> Column:
    """PRJ-07: the message of each status, with blocking points as bullets; none for errors."""
    bullets = F.array_join(F.transform(blocking, lambda b: F.concat(F.lit("- "), b)), "\n")
    more = F.when(others > 0, F.concat(F.lit("\n"), others.cast("string"), F.lit(" other points are in the review note."))).otherwise("")
    return (
        F.when(status == "formatted", F.concat(F.lit("Your paper "), name, F.lit(" has been formatted."), more))
        .when(status == "needs-fixes", F.concat(F.lit("Your paper "), name, F.lit(" needs these fixes:\n"), bullets, more))
        .when(status == "unreadable", F.concat(F.lit("Your paper "), name, F.lit(" could not be read as text.")))
        .when(status == "recovered", F.concat(F.lit("Your paper "), name, F.lit(" had been filed before.")))
    )


def table_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """JN-10: rows of two runs by key: changed, removed or added."""
    both = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").when(F.col("old") != F.col("new"), "changed")
    return both.select(key, change.alias("change")).where("change is not null")


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """SET-05: lines only in one of the two, with their multiplicity."""
    return old.exceptAll(new).withColumn("side", F.lit("-")).unionByName(new.exceptAll(old).withColumn("side", F.lit("+")))
