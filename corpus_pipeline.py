"""The corpus pipeline: documents to token ids, each stage one training-data operator.

A stage is (name, function of (spark, docs, sf_dir)); its result is written and
read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.llm import bpe, decontam, linededup, quality, simhash
from wordloom.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that the base rule and the outlier estimate keep."""
    return quality.keep(docs, labels=table(spark, sf, "labels", "doc_id", "quality"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Texts without lines that an earlier document holds; n_chars follows the text."""
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """The first document of each class of near duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return decontam.without_documents(docs, table(spark, sf, "benchmark", "item_id", "text"))


def encode(spark: SparkSession, docs: DataFrame, sf: str) -> DataFrame:
    """Token ids, and digests of ids and decoded text."""
    encoded = bpe.encode_documents(docs.select("doc_id", "text"), bpe.default_path())
    return encoded.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", simhash_dedup),
    ("benchmark decontamination", decontaminate),
    ("bpe", encode),
]
ORACLE_SQL = None  # fingerprints, outlier estimates and merges have no SQL form; tests/llm holds a brute-force version


def run(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf), name.replace(" ", "-"))
    return docs
