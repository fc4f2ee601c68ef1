"""A corpus pipeline: quality, near duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.llm import minhash, mixing, packing, quality, substring
from locusmill.llm.common import ROW_ID, Scratch, table, with_row_ids


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts, learnt from the labels of documents."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest doc_id, of each class of near duplicates; rows without a doc_id come last."""
    return minhash.keep_one(docs, null_ids=False)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of repeated windows; a document left without words stays, empty."""
    return substring.remove_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it."""
    rows = with_row_ids(docs, Scratch(spark, "mixed"))
    taken = mixing.mix_sources(rows, carry=ROW_ID).where("taken > 0").select(*ROW_ID, (F.col("taken") / F.col("size")).cast("int").alias("times_"))
    return rows.join(taken, list(ROW_ID)).withColumn("copy_", F.explode(F.array_repeat(F.lit(1), F.col("times_")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_documents),
    ("MinHash near-dedup", distinct_documents),
    ("substring dedup", without_repeats),
    ("mixing to target weights", mixed),
    ("best-fit packing", packed),
]

#: SQL can't run the tokenizer, the compressors or ProbMinHash; tests/llm/test_pipeline.py holds the stages against
#: brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = scratch.keep(docs, f"stage{k}")
    return docs
