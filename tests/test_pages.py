"""Rows, fractions and lines of printed pages."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from paperloom.operators import pages as G

PIECES = "page int, x0 double, y0 double, x1 double, y1 double, text string, spans array<struct<text:string,bold:boolean,italic:boolean,sup:boolean,x0:double,x1:double>>"


def piece(page, x0, y0, x1, y1, *spans):
    return (page, float(x0), float(y0), float(x1), float(y1), "".join(s[0] for s in spans), [(t, bold, False, False, float(a), float(b)) for t, a, b, bold in spans])


def test_a_printed_question(spark):
    rows = [
        piece(1, 40, 92, 92, 103, ("Class: VI", 40, 92, True)), piece(1, 250, 92, 360, 103, ("Subject: Maths", 250, 360, True)),
        piece(1, 40, 150, 480, 161, ("1. A question that goes on until it reaches the right margin of", 40, 480, False)), piece(1, 40, 164, 190, 175, ("the page and ends here?", 40, 190, False)),
        piece(1, 40, 222, 104, 233, ("2. Reduce", 40, 104, False)), piece(1, 110, 217, 115, 226, ("6", 110, 115, False)), piece(1, 109, 229, 118, 238, ("12", 109, 118, False)),
        piece(1, 130, 228, 230, 239, ("as far as ", 130, 180, False), ("possible", 180, 230, True)), piece(1, 520, 228, 533, 239, ("1M", 520, 533, False)),
    ]
    pages = G.rows_of_pieces(spark.createDataFrame(rows, PIECES), "page")
    lines = G.join_wrapped(G.inline_fractions(pages, "page"), "page", right=480.0, left=40.0).orderBy("line_no").collect()
    assert [r.text for r in lines] == ["Class: VI\tSubject: Maths", "1. A question that goes on until it reaches the right margin of the page and ends here?", "2. Reduce 6/12 as far as possible\t1M"]
    assert all("".join(s.text for s in r.spans) == r.text for r in lines)
    assert [s.text for s in lines[2].spans if s.bold] == ["possible"]


def row(y0, y1, *spans):
    return {"y0": y0, "y1": y1, "x0": spans[0][1], "x1": max(s[2] for s in spans), "spans": [{"text": t, "bold": False, "italic": False, "sup": False, "x0": a, "x1": b} for t, a, b in spans]}


def texts(*rows):
    return ["".join(s["text"] for s in r["spans"]) for r in G.with_fractions(iter(rows))]


def test_fractions_by_hand():
    # alone over a number, two rows on; alone under nothing; too far below; too far aside
    assert texts(row(0, 8, ("3", 10, 14)), row(2, 12, ("take", 20, 40)), row(14, 22, ("4", 10, 14), (" of", 15, 25))) == ["take", "3/4 of"]
    assert texts(row(0, 8, ("3", 10, 14)), row(21, 29, ("4", 10, 14))) == ["3", "4"]
    assert texts(row(0, 8, ("3", 10, 14)), row(9, 17, ("4", 30, 34))) == ["3", "4"]
    # numbers within lines: each upper number takes the first under it, row after row, and what is left of a lower row goes behind
    assert texts(row(0, 8, ("a ", 0, 8), ("1", 10, 14), (" b ", 15, 25), ("2", 26, 30)), row(10, 18, ("3", 10, 14)), row(19, 27, ("5", 26, 30), (" end", 32, 50))) == ["a 1/3 b 2/5  end"]
    assert texts(row(0, 8, ("a ", 0, 8), ("1", 10, 14)), row(10, 18, ("x", 10, 14)), row(19, 27, ("3", 10, 14))) == ["a 1", "x", "3"]
    # a number is taken once
    assert texts(row(0, 8, ("n ", 0, 8), ("1", 10, 14)), row(10, 18, ("2", 10, 14)), row(19, 27, ("3", 10, 14))) == ["n 1", "2/3"] or texts(row(0, 8, ("n ", 0, 8), ("1", 10, 14)), row(10, 18, ("2", 10, 14)), row(19, 27, ("3", 10, 14))) == ["n 1/2", "3"]
    assert texts() == [] and texts(row(0, 1, ("7", 0, 1))) == ["7"]


def test_pages_without_fractions_pass_by(spark):
    rng = random.Random(3)
    rows = [piece(p, x, 12 * k, x + 20, 12 * k + 8, (rng.choice(["w", "7", "12", "x 1"]), x, x + 20, False)) for p in range(30) for k in range(rng.randint(0, 12)) for x in rng.sample(range(0, 200, 25), 2)]
    pages = G.rows_of_pieces(spark.createDataFrame(rows, PIECES), "page")
    got = sorted((r.page, r.row_no, r.text) for r in G.inline_fractions(pages, "page").collect())
    want, by_page = [], {}
    for r in pages.orderBy("page", "row_no").collect():
        by_page.setdefault(r.page, []).append(r.asDict(recursive=True))
    for page, own in by_page.items():
        want += [(page, r["row_no"], "".join(s["text"] for s in r["spans"])) for r in G.with_fractions(iter(own))]
    assert got == sorted(want)


def test_a_page_of_very_many_pieces(spark):
    n = 300_000
    rows = spark.range(n).select(F.lit(1).alias("page"), (F.col("id") % 7 * 50.0).alias("x0"), F.floor(F.col("id") / 7).cast("double").alias("y0"), (F.col("id") % 7 * 50.0 + 20).alias("x1"), (F.floor(F.col("id") / 7) + 8.0).alias("y1"), F.lit("w").alias("text"))
    found = G.rows_of_pieces(rows, "page")
    assert found.count() == -(-(n // 7 + 1) // 4)
