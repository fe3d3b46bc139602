"""Session helpers: a builder for local runs and the checkpoint folder rule."""

from __future__ import annotations

import os
import tempfile
import uuid

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

def local_session(app: str = "wordloom", cpus: int | str = 8) -> SparkSession:
    """Session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else os.cpu_count()))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("WORDLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; fall back to a fresh local
    folder only for local masters, where driver and executors share a disk."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="wordloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables, next to the checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and fixes the partition layout, so that
    partition ids and positions survive the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """A checkpoint dealt out evenly over as many partitions as shuffles have: for work that
    costs far more a row than the row's size, by which small partitions are merged."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(df.repartition(parts))


def measured(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """A table known to be small, as a local relation with an exact size.

    Reads at most ``max_rows + 1`` rows.  A table within the bound gets exact
    statistics, so Spark's own size check decides on broadcasting it; a larger
    one is returned unchanged and joins by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df
    return df.sparkSession.createDataFrame(rows, df.schema)


def local_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Driver-side rows as a local relation (exact statistics)."""
    types = StructType.fromDDL(schema)
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    arrow = to_arrow_schema(types)
    table = pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)
    return spark.createDataFrame(table, types)
