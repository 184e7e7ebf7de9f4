"""Queries of the text operators over the whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.llm import bpe, conversations, decontamination, fingerprints, html_content, language_model, licenses, manifest, minhash, quality_classifier, quality_rules, sharding, toxicity
from foldspan.llm.common import crc_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(buckets: int, which: int) -> Column:
    """Whether a row is kept from learning, by its id; a row without an id is not."""
    return F.coalesce(crc_bucket("doc_id", buckets) == which, F.lit(False))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents")).drop("cleaned")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", ~held_out(5, 0))
    return scores.select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assigned(table(spark, sf_dir, "documents"), shards=8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extracted(table(spark, sf_dir, "pages"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = language_model.scored(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return scores.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_classifier.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", ~held_out(3, 1))
    return scores.select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_minhash": op1_minhash, "op2_quality_rules": op2_quality_rules, "op3_toxicity": op3_toxicity, "op4_license_scan": op4_license_scan, "op5_decontamination": op5_decontamination, "op6_sharding": op6_sharding, "op7_html_content": op7_html_content, "op8_language_model": op8_language_model, "op9_bpe": op9_bpe, "op10_quality_classifier": op10_quality_classifier, "op11_manifest": op11_manifest, "op12_conversations": op12_conversations, "op13_fingerprints": op13_fingerprints}


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": minhash.ORACLE, "op2_quality_rules": quality_rules.ORACLE, "op11_manifest": manifest.ORACLE, "op12_conversations": conversations.ORACLE}
