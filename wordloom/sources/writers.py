"""Writers.  All write from the executors in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.operators.metrics import format_predictions
from wordloom.operators.ordering import global_position


def write_string_list(df: DataFrame, path: str, text: str = "span") -> None:
    """One JSON object per line."""
    df.select(text).write.mode("overwrite").json(path)


def write_records(df: DataFrame, path: str) -> None:
    """Feature records, keyed by ``record_id``."""
    df.write.mode("overwrite").parquet(path)


def record_id(source: Column | str, *ids: Column | str) -> Column:
    """Key of a record: source and positions joined with underscores."""
    cols = [F.col(c) if isinstance(c, str) else c for c in (source, *ids)]
    return F.concat_ws("_", *[c.cast("string") for c in cols])


def write_chunks(df: DataFrame, path: str, rows_per_file: int, mode: str = "overwrite") -> None:
    """Files of at most ``rows_per_file`` rows."""
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_splits(df: DataFrame, path: str) -> None:
    """One folder per split; readers prune by it."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).csv(path, sep=sep)


def write_predictions(df: DataFrame, path: str, index: str, prediction: str, regression: bool = False) -> None:
    """index and prediction as TSV in index order, one folder per task."""
    rows = format_predictions(df, index, prediction, regression)
    rows.orderBy("index").write.mode("overwrite").option("header", True).csv(path, sep="\t")


def indexed_rows(df: DataFrame, order: Sequence[str], name: str = "index") -> DataFrame:
    """0-based row index over an explicit order, as the first column."""
    return global_position(df, order, name).select(name, *df.columns)


def write_indexed_pairs(df: DataFrame, path: str, order: Sequence[str]) -> None:
    rows = indexed_rows(df, order)
    rows.orderBy("index").write.mode("overwrite").option("header", True).option("quote", "").csv(path, sep="\t")
