"""Resume tables that hold every finished row range of a file.

One furthest end per file loses rows if ranges finish out of order, so the table holds
all ranges.  ``commit`` adds one folder per writer: its ranges are written whole before
Spark's ``_SUCCESS`` marker, and only marked folders are read.  Writers never touch each
other's folders, so any number of them may commit at once, in any order.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from wordloom.operators.joins import lookup_join
from wordloom.session import local_table

SCHEMA = "file string, start_row bigint, end_row bigint"  # end_row is exclusive
_MARKER = "_SUCCESS"


def merged(ranges: DataFrame) -> DataFrame:
    """The fewest ranges that cover the same rows: overlapping and touching ones become one.

    Ranges with a null, and empty ones, cover no row.
    """
    ordered = Window.partitionBy("file").orderBy("start_row", "end_row")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    found = ranges.select("file", F.col("start_row").cast("bigint"), F.col("end_row").cast("bigint")).where("file is not null and start_row < end_row")
    opens = F.coalesce(F.col("start_row") > F.max("end_row").over(before), F.lit(True))
    numbered = found.withColumn("opens", opens).withColumn("island", F.sum(F.col("opens").cast("bigint")).over(ordered))
    return numbered.groupBy("file", "island").agg(F.min("start_row").alias("start_row"), F.max("end_row").alias("end_row")).drop("island")


def covered(done: DataFrame, file: str = "file", row: str = "row_no", block: int = 1 << 20) -> DataFrame:
    """The ranges that the rows of ``done`` make up.

    Rows are first summed up in blocks of ``block`` row numbers, which spreads a long file;
    only the ranges that remain are ordered per file, in a sort that may spill.
    """
    rows = done.select(F.col(file).alias("file"), F.col(row).cast("bigint").alias("r")).where("file is not null and r is not null").distinct()
    rows = rows.withColumn("block", F.floor(F.col("r") / block))
    run = F.col("r") - F.row_number().over(Window.partitionBy("file", "block").orderBy("r"))
    ends = [F.min("r").alias("start_row"), (F.max("r") + 1).alias("end_row")]
    return merged(rows.withColumn("run", run).groupBy("file", "block", "run").agg(*ends).drop("block", "run"))


def _paths(spark: SparkSession, path: str):
    """The file system of ``path`` and its folders."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system, ([s.getPath() for s in system.listStatus(folder)] if system.exists(folder) else [])


def commits(spark: SparkSession, path: str) -> list[str]:
    """The folders of complete commits; what a failed writer left is not among them."""
    system, folders = _paths(spark, path)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(str(f.toString()) for f in folders if system.exists(marker(f, _MARKER)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All finished ranges, merged.  No commit yet: no rows."""
    found = commits(spark, path)
    return merged(spark.read.schema(SCHEMA).parquet(*found)) if found else local_table(spark, [], SCHEMA)


def commit(ranges: DataFrame, path: str) -> str:
    """Add ``ranges`` as one commit; returns its folder.  A commit of the same ranges twice
    changes nothing that is read."""
    folder = f"{path}/commit-{uuid.uuid4().hex}"
    merged(ranges).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(folder)
    return folder


def compact(spark: SparkSession, path: str) -> None:
    """Replace the commits by one.  The new one is complete before an old one goes, so no
    range is ever missing; a reader that listed the old ones before must read again."""
    old = commits(spark, path)
    if len(old) > 1:
        commit(spark.read.schema(SCHEMA).parquet(*old), path)
        system, _ = _paths(spark, path)
        for folder in old:
            system.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder), True)


def pending(df: DataFrame, finished: DataFrame, file: str = "file", row: str = "row_no", max_ranges: int = 256) -> DataFrame:
    """Rows of ``df`` in no finished range; rows without a file or number are always pending.

    A file's ranges travel as one sorted array, at most ``max_ranges`` of them in a row: more
    are split into arrays of consecutive ranges, each joined by the row numbers it spans.
    """
    ranges = merged(finished)
    number = F.row_number().over(Window.partitionBy("file").orderBy("start_row"))
    parts = ranges.withColumn("part", F.floor((number - 1) / max_ranges))
    spans = F.sort_array(F.collect_list(F.struct("start_row", "end_row"))).alias("_spans")
    lists = parts.groupBy("file", "part").agg(spans, F.min("start_row").alias("_from"))
    begins = lists.groupBy("file").agg(F.sort_array(F.collect_list("_from")).alias("_begins"))
    out = lookup_join(df, begins.withColumnRenamed("file", file), [file], "left", [row])
    part = F.size(F.filter("_begins", lambda b: b <= F.col(row))) - 1
    out = out.withColumn("_part", F.when(F.col("_begins").isNotNull(), part).cast("bigint"))
    tables = lists.select(F.col("file").alias(file), F.col("part").alias("_part"), "_spans")
    out = lookup_join(out, tables, [file, "_part"], "left", [row], max_rows=1_000)
    inside = F.exists("_spans", lambda s: _holds(s, F.col(row)))
    return out.where(~F.coalesce(inside, F.lit(False))).drop("_begins", "_part", "_spans")


def _holds(span: Column, row: Column) -> Column:
    return (span["start_row"] <= row) & (row < span["end_row"])
