"""Filter, sample and de-duplicate a growing corpus.

Each job is ``readStream → row-local transformation → sink`` with the position
kept in a checkpoint, so a restart neither skips nor repeats a document.  Batch
results go to ``batch_id=<n>`` folders that are overwritten as a whole: a batch
repeated after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.functions.keys import hash_key
from wordloom.operators.curate import dedup_spans, limited_vocab_spans
from wordloom.operators.sample import sample_n, sample_spans_per_doc
from wordloom.session import measured
from wordloom.sources.intervals import commits


def _run(stream: DataFrame, each, checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def stream_filter(
    stream: DataFrame, vocab: DataFrame, sink: str, checkpoint: str, ids: Sequence[str] = ("doc_id",), dedup: bool = False,
) -> StreamingQuery:
    """Limited-vocabulary spans of every new document."""
    vocab = measured(vocab.select("word"))  # read once, not for every batch

    def each(batch: DataFrame, batch_id: int) -> None:
        kept = limited_vocab_spans(batch, vocab, list(ids))
        if dedup:
            kept = dedup_spans(kept, "span", [*ids, "start"])
        kept.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _run(stream, each, checkpoint)


def stream_sample(
    stream: DataFrame, k: int, sink: str, checkpoint: str, ids: Sequence[str] = ("doc_id",), seed: int | str = 0,
) -> StreamingQuery:
    """k spans per new document; ``read_sample`` applies the total limit."""

    def each(batch: DataFrame, batch_id: int) -> None:
        sample_spans_per_doc(batch, k, ids, seed=seed).write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _run(stream, each, checkpoint)


def read_sample(sampled: DataFrame, limit: int, ids: Sequence[str] = ("doc_id", "start"), seed: int | str = 0) -> DataFrame:
    return sample_n(sampled, limit, ids, seed)


def _versions(spark: SparkSession, sink: str) -> dict[int, str]:
    """The finished versions of a reservoir by number."""
    return {int(f.rsplit("=", 1)[1]): f for f in commits(spark, sink) if "/version=" in f}


def read_reservoir(spark: SparkSession, sink: str) -> DataFrame:
    """The rows that a reservoir holds now."""
    found = _versions(spark, sink)
    return spark.read.parquet(found[max(found)])


def stream_reservoir(
    stream: DataFrame, k: int, limit: int, sink: str, checkpoint: str, ids: Sequence[str] = ("doc_id",),
    seed: int | str = 0, total_seed: int | str = 0,
) -> StreamingQuery:
    """k spans per document, and of all documents seen so far only ``limit`` spans.

    The reservoir always equals ``read_sample`` over everything that arrived, however the
    stream was cut into batches.  A full reservoir has a largest key: spans beyond it are
    dropped inside their rows, so later batches shuffle few rows or none.  Each batch writes
    the whole reservoir as a new version from the last one before it; a batch repeated
    after a failure does the same again.  Two versions are kept, at most 2 * ``limit`` rows.
    """
    by = [*ids, "start"]
    key = hash_key(total_seed, *by)

    def each(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = {v: f for v, f in _versions(spark, sink).items() if v < batch_id}
        rows = sample_spans_per_doc(batch, k, ids, seed=seed)
        if before:
            held = spark.read.parquet(before[max(before)])
            size, last = held.agg(F.count(F.lit(1)), F.max(key)).first()
            rows = (rows.where(key <= last) if size >= limit and size else rows).unionByName(held)
        written = sample_n(rows, limit, by, total_seed).write.mode("overwrite")
        written.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{sink}/version={batch_id}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for folder in sorted(before.items())[:-1]:
            old = path(folder[1])
            old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)

    return _run(stream, each, checkpoint)


def stream_dedup(
    stream: DataFrame, sink: str, checkpoint: str, text: str = "span", ids: Sequence[str] = ("doc_id", "start"),
    across_batches: bool = False,
) -> StreamingQuery:
    """One row per text within a batch; optionally also against earlier batches.

    Across batches a state store keeps the hash of every text seen, so a batch
    costs the same however much was written before; of equal texts that arrive in
    one batch any row may stay.  Use the RocksDB state store for many texts.
    """
    if across_batches:
        stream = stream.withColumn("_hash", F.sha2(text, 256)).dropDuplicates(["_hash"]).drop("_hash")

    def each(batch: DataFrame, batch_id: int) -> None:
        unique = batch if across_batches else dedup_spans(batch, text, list(ids))
        unique.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return _run(stream, each, checkpoint)
