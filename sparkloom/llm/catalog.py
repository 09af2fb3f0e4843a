"""Queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, jaccard, language, mixing, packing, patterns, pii, quality, repair, repeats, simhash, tokens
from .runtime import cut, ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"), weights=[3.0, 1.0, 2.0], share=1.5, most=2.0, max_copies=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), **tokens.public_paths(), capacity=2048, end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(_table(spark, sf_dir, "documents")))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.attribute_tokens(_table(spark, sf_dir, "documents"), **tokens.public_paths(), fields=["source", "lang", "text"], rule="first")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(_table(spark, sf_dir, "conversations"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=100, with_text=False)


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_documents(_table(spark, sf_dir, "documents"))


def op9_language_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_pages(_table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=3).select("doc_id", "fingerprint", "component_id")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    damaged = repair.damage(rows)
    return repair.digest(rows, damaged, cut(repair.edits(damaged)))


def op12_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patterns.match_rows(_table(spark, sf_dir, "clicks")).withColumn("labels_sha256", F.sha2("labels", 256)).drop("labels")


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"), percent=85, words_in=4)


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op6_chat": chat.SQL, "op12_row_patterns": patterns.SQL, "op13_jaccard": jaccard.SQL}
