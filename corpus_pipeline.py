"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes the rows its predecessor kept, written as Parquet and read
again.  A stage first drops the intermediates of the stage before, whose
result is written by then.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import decontaminate, linedup, neardup, packing, quality
from wearline.llm.common import drop_stored, table
from wearline.session import scratch_path, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(df: DataFrame) -> DataFrame:
    """The columns of documents; ``n_chars`` follows the text."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _begin(spark: SparkSession) -> None:
    ship_package(spark)
    drop_stored(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines leave the others."""
    _begin(spark)
    return _documents(quality.clean(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; a document left without a word goes."""
    _begin(spark)
    out = linedup.remove_repeated_lines(docs)
    emptied = (F.col("n_removed_lines") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return _documents(out.where(~F.coalesce(emptied, F.lit(False))))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    _begin(spark)
    return _documents(neardup.keep_one(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated with benchmark items go."""
    _begin(spark)
    return _documents(decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences of at most 2048 tokens."""
    _begin(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False).drop("ids")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", pack),
]

#: SQL cannot express the packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    out = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    drop_stored(spark)
    return docs
