"""Trained subword vocabularies as versioned tables.

A version is a folder of its own, written whole before one row in ``commits`` names
it: readers see complete versions only, and a writer that fails leaves nothing that
is read.  Of two writers at once both versions are kept.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from wordloom.operators.tokens import Subwords
from wordloom.session import local_table

_COMMIT = "version bigint, folder string, family string, n_vocab bigint, n_merges bigint"
_VOCAB, _MERGES = "token string, id bigint, score double", "rank bigint, left string, right string, merged string"
_WORDS = "piece string, frequency bigint, tokens array<string>"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """version, folder, family, n_vocab, n_merges of the complete versions."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{path}/commits")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return local_table(spark, [], _COMMIT)


def write_subwords(model: Subwords, path: str) -> int:
    """Add a version with all tables of ``model``; returns its number."""
    spark = model.vocab.sparkSession
    folder = uuid.uuid4().hex
    vocab = model.vocab if "score" in model.vocab.columns else model.vocab.withColumn("score", F.lit(None).cast("double"))
    for name, df in (("vocab", vocab.select("token", "id", "score")), ("merges", model.merges), ("words", model.words)):
        df.write.parquet(f"{path}/{folder}/{name}")
    number = (versions(spark, path).agg(F.max("version")).first()[0] or 0) + 1
    saved = _read(spark, path, folder, model.family)
    row = (number, folder, model.family, saved.vocab.count(), saved.merges.count())
    local_table(spark, [row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return number


def _read(spark: SparkSession, path: str, folder: str, family: str) -> Subwords:
    def table(name: str, schema: str) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/{folder}/{name}")

    return Subwords(family, table("vocab", _VOCAB), table("merges", _MERGES), table("words", _WORDS))


def read_subwords(spark: SparkSession, path: str, version: int | None = None) -> Subwords:
    """A version, or the newest.  Raises LookupError if there is none, or if its tables are not whole."""
    known = versions(spark, path)
    if version is not None:
        known = known.where(F.col("version") == version)
    row = known.orderBy(F.col("version").desc(), "folder").first()
    if row is None:
        raise LookupError(f"no version {'' if version is None else version} in {path}")
    model = _read(spark, path, row["folder"], row["family"])
    if (model.vocab.count(), model.merges.count()) != (row["n_vocab"], row["n_merges"]):
        raise LookupError(f"version {row['version']} in {path} is not whole")
    return model
