"""A corpus pipeline: quality classifier, near-duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir), docs with the columns of documents, and all but the last return
those columns again, whatever other columns there are and whatever their names. In all stages null text counts as
empty, very long texts are read whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paperloom.llm.common import cut_lineage
from paperloom.llm.near_copies import survivors
from paperloom.llm.packing import pack
from paperloom.llm.quality import resample
from paperloom.llm.repeats import remove_repeats


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. Rows without doc_id are drawn by their texts; repeated rows share their draw, so they stay or go together, ties at the last place included; without labels all stay."""
    return resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, linked by fingerprints or by the likeness of their five-word shingles, one row: that of the smallest doc_id, nulls last, and of its texts the one with the least hash. Rows without doc_id or that share one go only where their texts are linked."""
    kept = survivors(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__kept"))
    hashed = docs.withColumn("__hash", F.xxhash64("text"))
    rows = hashed.join(kept, hashed["doc_id"].eqNullSafe(kept["__id"]) & (hashed["__hash"] == kept["__kept"]), "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id", "__hash").orderBy("text"))
    return rows.withColumn("__row", first).where("__row = 1").select(*docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 200 bytes that also start elsewhere; n_chars follows. No row goes: repeated rows, with or without doc_id, lose what they share and stay, empty ones too."""
    other = [c for c in docs.columns if c not in ("doc_id", "text")]
    cut = remove_repeats(docs.select("doc_id", "text", *(F.col(c).alias(f"other{k}") for k, c in enumerate(other))), as_text=True)
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"other{k}") for k, c in enumerate(other)} | ({"n_chars": F.char_length("kept").cast("long")} if "n_chars" in other else {})
    return cut.select(*(back[c].alias(c) for c in docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of tokens. Every row is packed, repeated and empty ones and those without doc_id too; ties go by doc_id, then text."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeated_passages),
    ("packing", pack_windows),
]

#: SQL can express neither the models, fingerprints nor tokens; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
