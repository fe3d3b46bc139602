"""Resume tables: what has been processed so far."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.joins import lookup_join


def pending(df: DataFrame, manifest: DataFrame, file: str = "file", row: str = "row_no") -> DataFrame:
    """Rows past the recorded end of their file; files not listed are all new."""
    ends = manifest.groupBy(file).agg(F.max("end_row").alias("_end"))
    out = lookup_join(df, ends, [file], "left", [row])
    return out.where(F.col("_end").isNull() | (F.col(row) >= F.col("_end"))).drop("_end")


def advance(manifest: DataFrame, done: DataFrame, file: str = "file", row: str = "row_no") -> DataFrame:
    """New manifest: the furthest end per file (end_row is exclusive)."""
    new = done.groupBy(file).agg((F.max(row) + 1).alias("end_row"))
    both = manifest.select(file, "end_row").unionByName(new.select(file, F.col("end_row").cast("bigint")))
    return both.groupBy(file).agg(F.max("end_row").alias("end_row"))
