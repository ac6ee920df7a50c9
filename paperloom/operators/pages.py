"""Lines of a page from positioned text: rows of pieces, fractions, wrapped lines, pictures side by side.

Pieces are rows (page, x0, y0, x1, y1, text) and may carry spans, their runs of one look with places of their own. What
hangs on the row, line or group before it is decided in one pass over a page's pieces in reading order, with the last
anchor as the only state, so a page of any number of pieces takes linear time; texts are put together by Spark.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..tables import stored
from .sequences import grouped, in_order

# Tolerances in points; patterns of lone marks, of labels that begin a line, and of lines that nothing joins.
ROW_TOLERANCE, TAB_GAP, OVERLAP = 3.0, 14.0, 5.0
ABOVE, STACKED, CENTRE, BESIDE = 12.0, 6.0, 8.0, 4.0
MARK_ONLY = r"(?i)^\s*(\d+\s*M(arks?)?|\[\d+\])\s*$"
LABEL = r"(?i)^\s*(Q\.?\s*\d+|\d{1,2}\s*[.)]|\(?[a-dA-D][).]|\(?(?:i{1,3}|iv|v|vi{0,3})\)|OR\b|Section\b|SECTION\b|Assertion|Reason|Direction|Note|Class\s*:|Date\s*:|Roll\s*No|Time\s*:|General\s+Instructions)"
NO_JOIN_AFTER = r"(?i)^\s*(Class\s*:|Date\s*:|Roll\s*No|Time\s*:|General\s+Instructions|Section\b)"
OR_ALONE, MARK_AT_END = r"(?i)^\s*OR\s*$", r"\d\s*M\s*$"
BARE_NUMBER = r"^\s*\d+\s*$"
SPAN = "struct<text:string,bold:boolean,italic:boolean,sup:boolean,x0:double,x1:double>"


def _gap(text: Column) -> Column:
    return F.struct(text.alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("sup"), F.lit(None).cast("double").alias("x0"), F.lit(None).cast("double").alias("x1")).cast(SPAN)


def _put_together(parts: Column, spans: bool) -> dict[str, Column]:
    """The text of parts (gap, text, spans) in order, and their spans with one for each gap."""
    out = {"text": F.array_join(F.transform(parts, lambda x: F.concat(x["gap"], x["text"])), "")}
    if spans:
        out["spans"] = F.flatten(F.transform(parts, lambda x: F.when(x["gap"] == "", x["spans"]).otherwise(F.concat(F.array(_gap(x["gap"])), x["spans"]))))
    return out


def _anchor(first: float | None, y0: float | None):
    new = first is None or y0 is None or abs(y0 - first) > ROW_TOLERANCE
    return (y0, True) if new else (first, False)


def rows_of_pieces(pieces: DataFrame, page: str) -> DataFrame:
    """WN-05, SRT-03: pieces in order of (y0, x0); a piece within three points of its row's first stays in the row; in a row a wide gap is a tab."""
    spans = "spans" in pieces.columns
    own = pieces.select(page, *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")), "text", *(["spans"] if spans else []))
    placed = grouped(own, [page], ["y0", "x0", "x1", "y1", "text"], ["y0"], _anchor, "row_no")
    part = F.struct("x0", "x1", "y1", "text", *([F.col("spans").cast(f"array<{SPAN}>").alias("spans")] if spans else []))
    rows = placed.groupBy(page, "row_no").agg(F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.array_sort(F.collect_list(part)).alias("parts"))
    wide = lambda x, i: x["x0"] - F.get("parts", i - 1)["x1"] > TAB_GAP
    gaps = F.transform("parts", lambda x, i: F.struct(F.when(i == 0, "").when(wide(x, i), "\t").otherwise(" ").alias("gap"), x["text"].alias("text"), *([x["spans"].alias("spans")] if spans else [])))
    return rows.select(page, "row_no", "y0", F.get("parts", F.lit(0))["x0"].alias("x0"), "x1", "y1", *(c.alias(n) for n, c in _put_together(gaps, spans).items()))


def _number(span: dict) -> bool:
    return span["x0"] is not None and span["text"].strip().isdigit()


def _over(a: dict, b: dict) -> bool:
    return abs((a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2) < CENTRE


def _grow(row: dict, below: dict, spans: list[dict]) -> None:
    if any(s["text"].strip() for s in spans):
        row["spans"] += [{"text": " ", "bold": False, "italic": False, "sup": False, "x0": None, "x1": None}, *spans]
    row["x1"], row["y1"] = max(row["x1"], below["x1"]), max(row["y1"], below["y1"])


def _lands(row: dict, ahead: deque[dict]) -> bool:
    """A number alone in its row joins the number under it in one of the next two."""
    if len(row["spans"]) != 1 or not _number(row["spans"][0]):
        return False
    upper = row["spans"][0]
    for below in [r for r in ahead if r["y0"] - row["y1"] <= ABOVE]:
        lower = next((s for s in below["spans"] if _number(s) and _over(s, upper)), None)
        if lower:
            lower.update(text=f"{upper['text'].strip()}/{lower['text'].strip()}", fraction=True)
            return True
    return False


def _takes(row: dict, below: dict) -> bool:
    """The row below continues this one: it starts with a fraction to the right of it, or one of its numbers stands under one of this row's."""
    if below["y0"] - row["y1"] >= STACKED:
        return False
    if row["x1"] <= below["x0"] + BESIDE and any(s.get("fraction") for s in below["spans"][:2]):
        _grow(row, below, below["spans"])
        return True
    for lower in filter(_number, below["spans"]):
        upper = next((s for s in row["spans"] if _number(s) and _over(s, lower)), None)
        if upper:
            upper["text"] = f"{upper['text'].strip()}/{lower['text'].strip()}"
            _grow(row, below, [s for s in below["spans"] if s is not lower])
            return True
    return False


def with_fractions(rows: Iterator[dict]) -> Iterator[dict]:
    """A page's rows in order, with the numbers that stand over one another as fractions; two rows are looked ahead to."""
    ahead: deque[dict] = deque()

    def look() -> bool:
        while len(ahead) < 2 and (row := next(rows, None)):
            ahead.append(row)
        return bool(ahead)

    while look():
        row = ahead.popleft()
        look()
        if _lands(row, ahead):
            continue
        while ahead and _takes(row, ahead[0]):
            ahead.popleft()
            look()
        yield row


def _merged(page: str, names: list[str], schema: pa.Schema, most: int = 5_000):
    """Pages one after the other; rows go on in batches of some thousand, whatever the size of pages."""

    def run(batches):
        out: list[dict] = []
        for _, rows in in_order(batches, [page]):
            for r in with_fractions(rows):
                text = "".join(s["text"] for s in r["spans"])
                out.append({c: text if c == "text" else r[c] for c in names})
                if len(out) >= most:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def inline_fractions(rows: DataFrame, page: str) -> DataFrame:
    """JN-09, WN-25: rows with spans, in which the parts of a fraction that were printed over one another stand on one line. Pages without two numbers over one another pass by: a join of numbers with those of the next two rows says which have them."""
    rows = stored(rows.select(page, "row_no", "y0", "x0", "x1", "y1", "text", "spans"))  # read four times below
    numbers = rows.select(page, "row_no", F.explode("spans").alias("s")).where(F.col("s.text").rlike(BARE_NUMBER) & F.col("s.x0").isNotNull()).select(page, "row_no", ((F.col("s.x0") + F.col("s.x1")) / 2).alias("centre"))
    above = numbers.select(page, F.explode(F.array(F.col("row_no") + 1, F.col("row_no") + 2)).alias("row_no"), F.col("centre").alias("upper"))
    pages = numbers.join(above, [page, "row_no"]).where(F.abs(F.col("centre") - F.col("upper")) < CENTRE).select(page).distinct()
    arrow = _arrow(rows.schema)
    touched = rows.join(pages, page, "left_semi").repartition(page).sortWithinPartitions(page, "row_no").mapInArrow(_merged(page, rows.columns, arrow), rows.schema)
    return rows.join(pages, page, "left_anti").unionByName(touched)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def join_wrapped(rows: DataFrame, page: str, right: float, left: float) -> DataFrame:
    """WN-07: a row goes on the line before if that reaches the right edge, is no heading and stands close above; a lone mark always does. Lines keep the spans that rows have."""
    text, spans = F.col("text"), "spans" in rows.columns
    looks = {"mark": text.rlike(MARK_ONLY), "label": text.rlike(LABEL), "head": text.rlike(NO_JOIN_AFTER), "or": text.rlike(OR_ALONE), "blank": F.trim(text) == "", "digit": text.rlike(r"\d\s*$"), "marked": text.rlike(MARK_AT_END), "m": text.rlike(r"^\s*M\s*$")}

    def step(last: tuple | None, x0, y0, x1, y1, mark, label, head, alone, blank, digit, marked, m):
        if last is not None:
            lx0, lx1, ly1, lhead, lalone, ldigit, lmarked = last
            close = y0 - ly1
            wrapped = lx1 >= right and not label and not lhead and not lalone and close < 6 and -12 <= x0 - lx0 <= 24 and lx0 - left < 60 and not lmarked
            if mark and close < 8 or wrapped:
                return (lx0, lx1 if mark and close < 8 else max(lx1, x1), y1, lhead, lalone and blank, digit or blank and ldigit, marked or blank and lmarked or m and ldigit), False
        return (x0, x1, y1, head, alone, digit, marked), True

    flagged = rows.select(page, "row_no", "x0", "y0", "x1", "y1", "text", *(["spans"] if spans else []), *(F.coalesce(c, F.lit(False)).alias(f"__{n}") for n, c in looks.items()))
    placed = grouped(flagged, [page], ["row_no"], ["x0", "y0", "x1", "y1", *(f"__{n}" for n in looks)], step, "line_no")
    part = F.struct("row_no", F.col("__mark").alias("mark"), "text", *(["spans"] if spans else []), "y0")
    lines = placed.groupBy(page, "line_no").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    gaps = F.transform("parts", lambda x, i: F.struct(F.when(i == 0, "").when(x["mark"], "\t").otherwise(" ").alias("gap"), x["text"].alias("text"), *([x["spans"].alias("spans")] if spans else [])))
    return lines.select(page, "line_no", F.get("parts", F.lit(0))["y0"].alias("y0"), *(c.alias(n) for n, c in _put_together(gaps, spans).items()))


def _beside(first: tuple | None, y0: float, y1: float):
    fits = first is not None and min(first[1], y1) - max(first[0], y0) > OVERLAP
    return (first, False) if fits else ((y0, y1), True)


def side_by_side(images: DataFrame, page: str) -> DataFrame:
    """WN-17: pictures in reading order whose heights overlap the group's first by more than five points share a group."""
    placed = grouped(images.select(page, "y0", "x0", "y1", "id"), [page], ["y0", "x0", "y1", "id"], ["y0", "y1"], _beside, "group_no")
    item = F.struct("y0", "x0", "y1", "id")
    return placed.groupBy(page, "group_no").agg(F.array_sort(F.collect_list(item)).alias("xs")).select(page, "group_no", F.transform("xs", lambda x: x["id"]).alias("ids"))
