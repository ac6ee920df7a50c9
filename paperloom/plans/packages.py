"""Word files written whole and read back; tables of cells laid out on a grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grids as G
from ..sources import docx
from ..sources.write_docx import to_docx
from .registry import query, table

#: Cells: three parts a row, fifty tables; a cell spans two columns or goes on from the row above by the part's size.
_CELLS = """SELECT t, i // 3 AS row, i % 3 AS cell, 1 + p_size % 2 AS span, CASE WHEN i < 3 OR p_size % 5 > 1 THEN NULL WHEN p_size % 5 = 1 THEN 'restart' ELSE 'continue' END AS merged, p_name
FROM (SELECT p_partkey % 50 AS t, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey) - 1 AS i, p_size, p_name FROM part)"""


def cells(spark, d):
    from pyspark.sql import Window

    i = F.row_number().over(Window.partitionBy(F.col("p_partkey") % 50).orderBy("p_partkey")) - 1
    rows = table(spark, d, "part").select((F.col("p_partkey") % 50).alias("t"), i.alias("i"), "p_size", "p_name")
    merged = F.when((F.col("i") < 3) | (F.col("p_size") % 5 > 1), None).when(F.col("p_size") % 5 == 1, "restart").otherwise("continue")
    return rows.select("t", F.floor(F.col("i") / 3).cast("int").alias("row"), (F.col("i") % 3).alias("cell"), (1 + F.col("p_size") % 2).cast("int").alias("span"), merged.alias("merged"), "p_name")


@query(
    "table_grids",
    f"""WITH c AS ({_CELLS}), p AS (SELECT *, sum(span) OVER (PARTITION BY t, row ORDER BY cell) AS e FROM c), n AS (SELECT *, max(e) OVER (PARTITION BY t) AS n, e - span AS col FROM p),
    w AS (SELECT *, CAST(round(CAST(least(9000, n * 1800) AS DOUBLE) / n) AS BIGINT) AS own FROM n), x AS (SELECT *, CASE WHEN own * n > 9000 THEN CAST(round(CAST(own * 9000 AS DOUBLE) / (own * n)) AS BIGINT) ELSE own END AS one FROM w),
    j AS (SELECT *, sum(CASE WHEN merged = 'continue' THEN 0 ELSE 1 END) OVER (PARTITION BY t, col ORDER BY row) AS island FROM x)
    SELECT t, row, cell, CAST(col AS INT) AS col, CAST(CASE WHEN merged = 'continue' THEN 0 ELSE count(*) OVER (PARTITION BY t, col, island) END AS INT) AS down, CAST(span * one AS INT) AS width FROM j""",
)
def table_grids(spark, d):
    """SRC-16, LAY-06: columns, rows covered and widths of cells that span."""
    return G.placed(cells(spark, d), ("t",), 9000).select("t", "row", "cell", "col", "down", "width")


@query("spanning_tables", f"WITH c AS ({_CELLS}) SELECT CAST(t AS VARCHAR) AS paper_id, CAST(row AS INT) AS row, CAST(cell AS INT) AS cell, CAST(span AS INT) AS span, merged, p_name AS text, t % 2 = 0 AS bordered FROM c")
def spanning_tables(spark, d):
    """SRC-16, SNK-05, LAY-06: tables of cells rebuilt, written into Word files and read back with spans, borders and texts."""
    none = F.lit(None)
    paragraph = F.array(F.struct(F.col("p_name").alias("text"), none.cast("string").alias("align"), none.cast(docx.RUN).alias("runs"), none.cast("array<struct<target:string,width:double,height:double>>").alias("pictures")))
    grids = G.rebuilt(cells(spark, d).withColumns({"bordered": F.col("t") % 2 == 0, "paragraphs": paragraph}), ("t",))
    plan = grids.select(F.col("t").cast("string").alias("paper_id"), F.lit(1).alias("seq"), F.lit("table").alias("style"), F.lit(0).alias("indent"), F.lit(False).alias("keep_next"), F.lit("").alias("text"), "grid")
    read = docx.read_blocks(to_docx(plan).select(F.col("paper_id").alias("path"), "content"))
    return G.cells_of(read).select("paper_id", "row", "cell", "span", "merged", F.get("paragraphs", F.lit(0))["text"].alias("text"), "bordered")


_RUNS = """SELECT CAST(c_custkey AS VARCHAR) AS paper_id, unnest([1, 2, 3, 4]) AS k, c_name, c_custkey FROM customer"""


@query(
    "word_packages",
    f"""SELECT paper_id, k - 1 AS block_pos, CASE k WHEN 1 THEN 'heading' WHEN 2 THEN 'question' WHEN 3 THEN 'figure' ELSE 'options' END AS style, CASE k WHEN 1 THEN 'SECTION A' WHEN 2 THEN '1.' || chr(9) || 'x2 of ' || c_name || chr(9) || '5M' WHEN 3 THEN '' ELSE 'a' || chr(9) || 'b' END AS text,
    CASE k WHEN 2 THEN '10488' WHEN 4 THEN '5400,7920' ELSE '' END AS stops, CASE k WHEN 2 THEN '1.' || chr(9) || 'x|' || '2/sup| of |' || c_name || '/bold|' || chr(9) || '5M' WHEN 1 THEN 'SECTION A/bold' WHEN 3 THEN '' ELSE 'a' || chr(9) || 'b' END AS runs, k = 1 AS keep_next,
    CASE WHEN k = 3 THEN '90.0x45.0:' || md5('picture ' || c_custkey % 7) || ',90.0x45.0:' || md5('picture ' || c_custkey % 7) ELSE '' END AS pictures, CASE WHEN k = 3 THEN 1 ELSE 0 END AS media FROM ({_RUNS})""",
)
def word_packages(spark, d):
    """SNK-05, LAY-02, LAY-05, SRC-08: styles, runs, stops and pictures written and read back; of two pictures with the same content one part is stored."""
    k, name = F.col("k"), F.col("c_name")
    flags = ("bold", "italic", "underline", "sup", "sub", "highlight")
    run = lambda text, *on: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), *(F.lit(f in on).alias(f) for f in flags))
    picture = lambda n: F.struct(F.concat(F.lit(f"media/{n}"), F.lit(".png")).alias("target"), F.lit(90.0).alias("width"), F.lit(45.0).alias("height"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"), "c_custkey", "c_name", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"))
    plan = rows.select(
        "paper_id", k.alias("seq"), F.when(k == 1, "heading").when(k == 2, "question").when(k == 3, "figure").otherwise("options").alias("style"), F.lit(360).alias("indent"), (k == 1).alias("keep_next"),
        F.when(k == 1, "SECTION A").when(k == 3, "").otherwise("a\tb").alias("text"), F.when(k == 2, F.array(F.lit(10488))).when(k == 4, F.array(F.lit(5400), F.lit(7920))).alias("stops"),
        F.when(k == 2, F.array(run("1.\tx"), run("2", "sup"), run(" of "), run(name, "bold"), run("\t5M"))).alias("runs"), F.when(k == 3, F.array(picture(1), picture(2))).alias("pictures"),
    )
    content = F.concat(F.lit("picture "), (F.col("c_custkey") % 7).cast("string")).cast("binary")
    media = rows.where("k < 3").select("paper_id", F.concat(F.lit("media/"), k.cast("string"), F.lit(".png")).alias("target"), content.alias("content"))
    blocks, parts = docx.read_whole(to_docx(plan, media).select(F.col("paper_id").alias("path"), "content"), with_media=True)  # read five times below
    of = docx.relations(parts).join(docx.media(parts), ["paper_id", "target"]).select("paper_id", F.col("rid"), F.md5("content").alias("digest"))
    stored = docx.media(parts).groupBy("paper_id").agg(F.count("*").cast("int").alias("n"))
    shown = blocks.select("paper_id", "block_pos", F.posexplode("pictures").alias("at", "p")).join(of.withColumnRenamed("rid", "own"), (F.col("p.rid") == F.col("own")) & (blocks.paper_id == of.paper_id)).select(blocks.paper_id, "block_pos", F.struct("at", F.concat(F.col("p.width").cast("string"), F.lit("x"), F.col("p.height").cast("string"), F.lit(":"), "digest").alias("t")).alias("x"))
    shown = shown.groupBy("paper_id", "block_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), ",").alias("shown"))
    look = F.transform("runs", lambda r: F.concat(r["text"], *(F.when(r[f], f"/{f}").otherwise("") for f in flags)))
    out = blocks.join(shown, ["paper_id", "block_pos"], "left").join(stored, "paper_id")
    return out.select("paper_id", "block_pos", "style", "text", F.array_join("stops", ",").alias("stops"), F.array_join(look, "|").alias("runs"), "keep_next", F.coalesce("shown", F.lit("")).alias("pictures"), F.when(F.col("shown").isNotNull(), F.col("n")).otherwise(0).alias("media"))
