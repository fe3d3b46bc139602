"""Split tables as folders of Arrow stream files, a Spark data source.

``<path>/<split>/state.json`` lists the files of a split and ``<path>/dataset_dict.json``
the splits.  Tasks write files under names of their own; the list is written last, by the
driver, so a reader meets a split whole or not at all, and what a failed or repeated task
left is in no list.  Files are read in parallel, one partition each, batch by batch.

Paths may be local folders that all executors share, or any address that pyarrow's file
systems know.  Two appends to one split at the same time are not supported.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from contextlib import ExitStack
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

# --- fixed values: names of the format ------------------------------------------------------
FORMAT = "arrow_folder"
STATE, SPLITS = "state.json", "dataset_dict.json"
# --------------------------------------------------------------------------------------------


def _open(path: str) -> tuple[fs.FileSystem, str]:
    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
    return system, inner.rstrip("/")


def _load(path: str, name: str) -> dict | None:
    system, inner = _open(path)
    if system.get_file_info(f"{inner}/{name}").type == fs.FileType.NotFound:
        return None
    with system.open_input_stream(f"{inner}/{name}") as f:
        return json.loads(f.read())


def _save(path: str, name: str, value: dict) -> None:
    """Written under another name and moved: no reader sees half a file."""
    system, inner = _open(path)
    system.create_dir(inner)
    draft = f"{inner}/_{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(json.dumps(value, indent=1).encode())
    system.move(draft, f"{inner}/{name}")


def _delete(path: str, names: list[str]) -> None:
    system, inner = _open(path)
    for name in names:
        system.delete_file(f"{inner}/{name}")


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str | None, str]]  # split, name


class _Writer(DataSourceArrowWriter):
    """One folder; or, with ``splits``, one for each value of the column ``split``, in one pass."""

    def __init__(self, path: str, schema: StructType, overwrite: bool, splits: list[str] | None):
        self.path, self.overwrite, self.splits = path, overwrite, splits
        self.schema = StructType([f for f in schema if not splits or f.name != "split"])

    def _folder(self, split: str | None) -> str:
        return self.path if split is None else f"{self.path}/{split}"

    def _parts(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, pa.Table]]:
        rows, types = pa.Table.from_batches([batch]), to_arrow_schema(self.schema)
        for split in self.splits or [None]:
            part = rows if split is None else rows.filter(pc.equal(rows["split"], split))
            if part.num_rows:
                yield split, part.select(types.names).cast(types)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        open_files, names = {}, []
        with ExitStack() as stack:
            for batch in iterator:
                for split, part in self._parts(batch):
                    if split not in open_files:
                        system, inner = _open(self._folder(split))
                        system.create_dir(inner)
                        names.append((split, f"data-{uuid.uuid4().hex}.arrow"))
                        out = stack.enter_context(system.open_output_stream(f"{inner}/{names[-1][1]}"))
                        open_files[split] = stack.enter_context(pa.ipc.new_stream(out, part.schema))
                    open_files[split].write_table(part)
        return _Written(names)

    def commit(self, messages: list[_Written | None]) -> None:
        old = {}
        for split in self.splits or [None]:
            folder = self._folder(split)
            old[folder] = (_load(folder, STATE) or {}).get("_data_files", [])
            new = [{"filename": name} for m in messages if m for of, name in m.files if of == split]
            _save(folder, STATE, {"_data_files": new if self.overwrite else old[folder] + new, "_schema": self.schema.json()})
        if self.splits:
            _save(self.path, SPLITS, {"splits": self.splits})
        if self.overwrite:  # only after the new lists stand
            for folder, files in old.items():
                _delete(folder, [f["filename"] for f in files])

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for split, name in m.files if m else ():
                _delete(self._folder(split), [name])


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        state = _load(self.path, STATE)
        if state is None:
            raise FileNotFoundError(f"no {STATE} in {self.path}")
        return [InputPartition(f["filename"]) for f in state["_data_files"]] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        types = to_arrow_schema(self.schema)
        system, inner = _open(self.path)
        with system.open_input_stream(f"{inner}/{partition.value}") as f:
            for batch in pa.ipc.open_stream(f):
                yield from pa.Table.from_batches([batch]).select(types.names).cast(types).to_batches()


class ArrowFolder(DataSource):
    """``spark.read.format("arrow_folder").load(path)`` and ``df.write.format("arrow_folder")``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        """The recorded schema; folders of other writers: that of their first file."""
        state = _load(self.options["path"], STATE)
        if state is None:
            raise FileNotFoundError(f"no {STATE} in {self.options['path']}")
        if "_schema" in state:
            return StructType.fromJson(json.loads(state["_schema"]))
        system, inner = _open(self.options["path"])
        with system.open_input_stream(f"{inner}/{state['_data_files'][0]['filename']}") as f:
            return from_arrow_schema(pa.ipc.open_stream(f).schema)

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        splits = self.options.get("splits")
        return _Writer(self.options["path"], schema, overwrite, json.loads(splits) if splits else None)


def write_folder(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.sparkSession.dataSource.register(ArrowFolder)
    df.write.format(FORMAT).mode(mode).save(path)


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ArrowFolder)
    return spark.read.format(FORMAT).load(path)


def write_arrow_splits(df: DataFrame, path: str, splits: Sequence[str] = ("train", "validation", "test")) -> None:
    """One folder per split, in one pass; the list of splits comes last.  A row that is in none
    of ``splits`` fails the write, and nothing of it is read."""
    known = F.col("split").isin(*splits)
    checked = F.when(known, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("no such split: "), F.coalesce("split", F.lit("null")))))
    df.sparkSession.dataSource.register(ArrowFolder)
    rows = df.withColumn("split", checked)
    rows.write.format(FORMAT).option("splits", json.dumps(list(splits))).mode("overwrite").save(path)


def read_arrow_splits(spark: SparkSession, path: str) -> DataFrame:
    """All splits with a column ``split``; a folder without splits is all train."""
    names = (_load(path, SPLITS) or {}).get("splits")
    parts = [read_folder(spark, f"{path}/{n}").withColumn("split", F.lit(n)) for n in names] if names else [
        read_folder(spark, path).withColumn("split", F.lit("train"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
