"""From raw documents to tokens: quality classifier, quality rules, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one before kept; all but the last return the
columns of documents. Rejected documents go; the rules stage also takes failing lines out of the texts it keeps; one
document of each near-duplicate class stays; documents that hold a benchmark passage go. Every stage judges each row by
its own text, so rows whose id is null or repeated are treated like others; columns that stages do not know stay, and an
empty table stays empty. Near-duplicates are those of five-word shingles at a similarity of 0.8, as for any stage on word
shingles; two-word shingles belong to the registered query op1 alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.llm import bpe, decontamination, minhash, quality_classifier, quality_rules
from foldspan.llm.common import written


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the classifier, taught by all labels of documents at hand, takes for bad. Null and empty texts
    are scored like others; equal texts share their verdict; without rows of both labels all stay."""
    return quality_classifier.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that pass the rules, less their failing lines; null and empty texts fail, n_chars follows the new text."""
    return quality_rules.cleaned(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class; rows without words stay."""
    return minhash.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that hold a benchmark passage; null and empty texts stay."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text): ids as little-endian unsigned 32-bit integers, text as decoded from them; a null text
    is empty."""
    coded = bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.decode("decoded", "UTF-8").alias("text"))


STAGES = [
    ("quality_classifier", classify_quality),
    ("quality_rules", apply_rules),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("byte_level_bpe", tokenize),
]

#: The classifier and the encoder are not expressible in SQL; tests hold the stages on a small table against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
