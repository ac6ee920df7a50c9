"""What the fifth round changed: pictures as rows, Word files read once and in batches."""

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from paperloom.operators import structures as S
from paperloom.plans import registry
from paperloom.sources import docx
from paperloom.sources.write_docx import Package, _files

registry.load()


def test_pictures_go_to_the_lines_that_take_them(spark):
    lines = spark.createDataFrame([(1, 1, "a￼b￼"), (1, 2, None), (1, 3, ""), (1, 4, "￼"), (1, 5, "￼￼"), (2, 1, "￼")], "paper int, line int, text string")
    pictures = spark.createDataFrame([(1, k, f"i{k}") for k in (4, 3, 2, 1)] + [(3, 1, "other")], "paper int, at int, image string")
    got = S.placeholder_images(lines, pictures, ["paper"], ["line"], "text", "at", "image")
    assert got.columns == ["paper", "line", "text", "line_images"]
    assert {(r.paper, r.line): r.line_images for r in got.collect()} == {(1, 1): ["i1", "i2"], (1, 2): None, (1, 3): [], (1, 4): ["i3"], (1, 5): ["i4"], (2, 1): []}


def test_a_user_may_have_any_number_of_pictures(spark, tmp_path):
    """More than two thousand pictures in one paragraph, which a fixed list of them left without."""
    spark.range(2500).select(F.col("id").alias("event_id"), F.lit(7).cast("long").alias("user_id"), F.timestamp_seconds("id").alias("ts")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(registry.ORACLE["placeholder_images"]).fetchall()
    got = registry.QUERIES["placeholder_images"](spark, str(tmp_path)).collect()
    assert sorted((r.event_id, list(r.line_images)) for r in got) == sorted((k, list(v)) for k, v in want)


def test_files_pass_by_in_batches(spark):
    row = {"seq": 1, "style": "question", "indent": 0, "keep_next": False, "text": "x", "stops": None, "align": None, "runs": None, "pictures": None, "grid": None, "__target": None, "__content": None}
    made = list(_files(iter([pa.RecordBatch.from_pylist([{"paper_id": f"p{k}", **row} for k in range(40)])])))
    assert [b.num_rows for b in made] == [40] and made[0].column("content")[7].as_py() == Package({}).build([row])
    files = [("a", made[0].column("content")[0].as_py()), ("broken", b"PK no"), ("b", made[0].column("content")[1].as_py())]
    read = list(docx._reader(docx.parse_docx, docx.BLOCKS)(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*files, strict=True)], ["path", "content"])])))
    assert [[(r["paper_id"], r["kind"], r["text"]) for r in b.to_pylist()] for b in read] == [[("a", "p", "x"), ("broken", "error", None), ("b", "p", "x")]]


def test_word_packages_reads_each_file_once(spark):
    plan = registry.QUERIES["word_packages"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan
