"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.session import scratch_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = 128  # entries that running_sum adds up at a time


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    """A whole input table, only the named columns."""
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: computed once, and
    lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def set_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add result columns; an input column of the same name (in any case) is
    replaced, so that clashing extra columns never make a name ambiguous."""
    taken = {c.lower() for c in columns}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in taken], *[v.alias(k) for k, v in columns.items()])


def carried(docs: DataFrame, needed: tuple[str, ...], sets: tuple[str, ...], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the columns it needs and, as one struct, all others: no name of theirs can
    clash with names inside.  Returns the columns of ``docs`` that are not set, and ``sets``."""
    own = {c.lower(): c for c in docs.columns}
    others = [c for c in docs.columns if c.lower() not in needed]
    rest = [F.struct(*[docs[f"`{c}`"] for c in others]).alias("rest_")] if others else []
    out = work(docs.select(*[docs[f"`{own[n]}`"].alias(n) for n in needed], *rest))
    kept = [c for c in docs.columns if c.lower() not in sets]
    return out.select(*[(F.col(c.lower()) if c.lower() in needed else F.col("rest_").getField(c)).alias(c) for c in kept], *sets)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once: inside a higher-order
    function a column expression is otherwise evaluated again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running_sum(values: Column) -> Column:
    """Sums of an int array before each element, and the total as last entry.

    Blocks keep the appending fold short, so the cost stays near linear.
    """
    empty = F.array().cast("array<bigint>")

    def fold(xs: Column, add: Callable[[Column], Column]) -> Column:
        start = F.struct(empty.alias("out"), F.lit(0).cast("bigint").alias("sum"))
        return F.aggregate(xs, start, lambda a, x: F.struct(
            F.concat(a["out"], F.array(a["sum"])).alias("out"), (a["sum"] + add(x)).alias("sum")))

    def spread(blocks: Column) -> Column:
        return let(fold(blocks, lambda b: b["sum"]), lambda top: F.concat(
            F.flatten(F.zip_with(blocks, top["out"], lambda b, o: F.transform(b["out"], lambda v: v + o))),
            F.array(top["sum"])))

    def cut(xs: Column) -> Column:
        starts = F.when(F.size(xs) > 0, F.sequence(F.lit(1), F.size(xs), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda s: fold(F.slice(xs, s, F.lit(BLOCK)), lambda x: x.cast("bigint")))

    return let(values, lambda xs: let(cut(xs), spread))
