"""Every query with SQL against DuckDB on the smallest tables; the others by loops."""

from __future__ import annotations

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from paperloom.plans import registry

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
registry.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, str):
            return str(list(v))
        if v is None or pd.isna(v):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    out = df[sorted(df.columns)].map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(name, spark, duck):
    got = plain(registry.QUERIES[name](spark, DIR).toPandas())
    want = plain(duck.execute(registry.ORACLE[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_rows_of_pieces_by_a_loop(spark):
    got = {(r.page, r.row_no): r.text for r in registry.QUERIES["row_group"](spark, DIR).collect()}
    from paperloom.plans.layouts import pieces

    want = {}
    for page, group in pieces(spark, DIR).toPandas().sort_values(["y0", "x0", "x1", "y1", "text"]).groupby("page"):
        rows = []
        for p in group.itertuples():
            if rows and abs(rows[-1][0] - p.y0) <= 3:
                rows[-1][1].append(p)
            else:
                rows.append((p.y0, [p]))
        for k, (_, parts) in enumerate(rows):
            parts = sorted(parts, key=lambda p: (p.x0, p.x1, p.y1, p.text))
            text = parts[0].text
            for a, b in zip(parts, parts[1:], strict=False):
                text += ("\t" if b.x0 - a.x1 > 14 else " ") + b.text
            want[page, k] = text
    assert got == want


def test_garbled_devanagari_by_a_loop(spark):
    signs, base = {*map(chr, range(0x93E, 0x94E)), "ं", "ँ"}, {*map(chr, range(0x905, 0x93A)), *map(chr, range(0x958, 0x960)), *map(chr, range(0x93E, 0x94E))}
    for r in registry.QUERIES["devanagari_ratio"](spark, DIR).limit(50).collect():
        text = ("ािक " if r.p_partkey % 2 == 0 else "किताब ") * 1
        n = r.marks // max(1, sum(c in signs for c in text))
        text = text * n
        assert r.marks == sum(c in signs for c in text)
        assert r.orphans == sum(c in signs and (i == 0 or text[i - 1] not in base) for i, c in enumerate(text))


def test_wrapped_lines_join(spark):
    from paperloom.operators.pages import join_wrapped

    rows = spark.createDataFrame([(1, 0, 10.0, 0.0, 400.0, 10.0, "Explain why the"), (1, 1, 10.0, 12.0, 200.0, 22.0, "sky is blue"), (1, 2, 10.0, 24.0, 50.0, 30.0, "2M"), (1, 3, 10.0, 40.0, 90.0, 50.0, "2. Next")], "page int, row_no int, x0 double, y0 double, x1 double, y1 double, text string")
    got = [r.text for r in join_wrapped(rows, "page", right=380.0, left=0.0).orderBy("line_no").collect()]
    assert got == ["Explain why the sky is blue\t2M", "2. Next"]


def test_side_by_side_by_a_loop(spark):
    from paperloom.plans.layouts import pieces

    got = {(r.page, r.group_no): [*map(int, r.ids.split(","))] for r in registry.QUERIES["side_by_side"](spark, DIR).collect()}
    want = {}
    for page, group in pieces(spark, DIR).toPandas().sort_values(["y0", "x0", "y1", "event_id"]).groupby("page"):
        groups = []
        for p in group.itertuples():
            if groups and min(groups[-1][1], p.y1) - max(groups[-1][0], p.y0) > 5:
                groups[-1][2].append(p.event_id)
            else:
                groups.append((p.y0, p.y1, [p.event_id]))
        want |= {(page, k): g[2] for k, g in enumerate(groups)}
    assert got == want
