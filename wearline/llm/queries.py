"""Contract queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wearline.llm import (
    decontaminate,
    langid,
    linedup,
    merkle,
    neardup,
    packing,
    phrases,
    quality,
    rules,
    sharding,
    substring,
    toxicity,
    warc,
)
from wearline.llm.common import table
from wearline.llm.sql import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record and read all records back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), spark)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity of every document; trained on ``labels``."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines left in every document."""
    out = linedup.remove_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("kept_sha256"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False).drop("ids")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; learned from three quarters of them."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~held))
    found = langid.identify(docs, model, with_spans=False).drop("spans")
    return found.withColumn("held_out", held)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and verdict of every document."""
    return quality.assess(table(spark, sf_dir, "documents")).drop("_k1", "_k2")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 200-byte strings leave of every document."""
    return substring.remove_repeated(table(spark, sf_dir, "documents"), with_kept=False).drop("kept")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    return neardup.link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best collocations of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proof of every document, and the root that tampered ones fold to."""
    manifest = merkle.build(table(spark, sf_dir, "documents"), also={"tampered": merkle.tampered_by_one(7)})
    return merkle.verify(manifest, "tampered")


def op13_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; learned from four fifths of the labels."""
    def held(doc_id: str):
        return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))

    docs = table(spark, sf_dir, "documents")
    model = rules.train(docs, table(spark, sf_dir, "labels").where(~held("doc_id")))
    scored = rules.score(docs, model)
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_rules")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py, one after the other."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_warc, op2_toxicity, op3_line_dedup, op4_packing, op5_language_id, op6_quality, op7_substring_dedup,
        op8_decontaminate, op9_near_duplicates, op10_sharding, op11_phrases, op12_merkle,
        op13_quality_score, pipeline,
    )
}
__all__ = ["ORACLES", "QUERIES"]
