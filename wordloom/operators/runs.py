"""Experiment tables: configuration sweeps, evaluation logs, bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.operators.joins import lookup_join
from wordloom.operators.ordering import exact_percentiles
from wordloom.session import local_table

CONFIG_COLUMNS = ("embedding_size", "hidden_size", "intermediate_size", "num_attention_heads", "num_hidden_layers")


def config_grid(spark: SparkSession, base: Mapping[str, int], vary: Mapping[str, Sequence[int]]) -> DataFrame:
    """One row per sweep point: the base configuration with one value changed."""
    rows = []
    for feature, values in vary.items():
        for v in values:
            rows.append((len(rows), feature, *[int(v if k == feature else base[k]) for k in base]))
    schema = "run_number bigint, feature string, " + ", ".join(f"{k} bigint" for k in base)
    return local_table(spark, rows, schema)


def vary_configs(bases: DataFrame, vary: Mapping[str, Sequence[int]], keys: Sequence[str] = CONFIG_COLUMNS) -> DataFrame:
    """The same sweep for a table of base configurations, row by row."""
    points = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(int(v)).cast("bigint").alias("value")) for f, vs in vary.items() for v in vs]
    )
    others = [c for c in bases.columns if c not in keys]
    rows = bases.select("*", F.explode(points).alias("_p"))
    return rows.select(
        *others, F.col("_p.feature").alias("feature"),
        *[F.when(F.col("_p.feature") == k, F.col("_p.value")).otherwise(F.col(k).cast("bigint")).alias(k) for k in keys],
    )


def explicit_configs(spark: SparkSession, points: Sequence[Sequence[int]], keys: Sequence[str] = CONFIG_COLUMNS) -> DataFrame:
    """Sweep points given as tuples."""
    return local_table(spark, [tuple(map(int, p)) for p in points], ", ".join(f"{k} bigint" for k in keys))


def skip_configs(grid: DataFrame, unwanted: Column) -> DataFrame:
    return grid.where(~unwanted)


def runs_with_evals(runs: DataFrame, evals: DataFrame, run: str = "run_name") -> DataFrame:
    """Configuration and scalar metrics on every evaluation row of the run."""
    return lookup_join(evals, runs, [run], "inner")


def run_config_lookup(runs: DataFrame, wanted: DataFrame, run: str = "run_name") -> DataFrame:
    return lookup_join(wanted, runs, [run])


def upsert_run_map(existing: DataFrame, new: DataFrame, run: str = "run_name", order: Sequence[str] = ()) -> DataFrame:
    """Configuration per run; an entry in ``new`` replaces the existing one.

    Of several new rows for a run the last one wins: the largest by ``order``
    (columns of ``new`` that are not kept), then by the values themselves.
    Write the result to a new location: its input is read lazily.
    """
    values = [c for c in existing.columns if c != run]
    last = new.groupBy(run).agg(F.max(F.struct(*order, *values)).alias("_last"))
    latest = last.select(run, *[F.col(f"_last.{c}").alias(c) for c in values])
    return existing.join(latest.select(run), run, "left_anti").unionByName(latest)


def filter_tokenizer_type(df: DataFrame, names: Sequence[str], column: str = "tokenizer") -> DataFrame:
    """Rows of the listed tokenizers, in list order (``list_pos``)."""
    order = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return df.where(F.col(column).isin(*names)).withColumn("list_pos", (order - 1).cast("bigint"))


def param_percentiles(df: DataFrame, value: str) -> DataFrame:
    """p25, p50, p75, p100 with linear interpolation."""
    return exact_percentiles(df, value, (0.25, 0.5, 0.75, 1.0), ("p25", "p50", "p75", "p100"))


def bucket_labels(df: DataFrame, value: str) -> DataFrame:
    """band, upper, label: legend text of the four percentile bands."""
    row = param_percentiles(df, value)
    size = lambda c: F.bround(F.col(c) / 1_000_000, 0).cast("bigint").cast("string")
    uppers = ["p25", "p50", "p75", "p100"]
    lows = [F.lit("0")] + [size(c) for c in uppers[:-1]]
    items = [
        F.struct(
            F.lit(i + 1).cast("bigint").alias("band"), F.col(c).alias("upper"),
            F.concat(lows[i], F.lit(" < Num. par. <= "), size(c), F.lit(" Mil.")).alias("label"),
        )
        for i, c in enumerate(uppers)
    ]
    return row.select(F.inline(F.array(*items)))
