"""Sinks and sources by round trip, resume tables, incremental jobs.

Each query writes a table made from the driver tables to a new folder next to
the checkpoints and returns what a reader finds there.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import KEPT, ORACLE, VOCAB, as_bigint, documents, hkey, query, rounded, table, vocabulary, SPANS
from catalog.evaluation import turn_pairs
from wordloom.functions import text as tx
from wordloom.operators import curate as cu, sample as sa
from wordloom.plans.tokenizer_experiment import tokenizer_experiment
from wordloom.session import scratch_dir
from wordloom.sources import arrowfolders as af, intervals as iv, manifest as mf, readers as rd, writers as wr
from wordloom.streaming import corpus as st

_DOCS = "SELECT doc_id, source, text FROM documents"


@query("write_records", "SELECT source || '_' || doc_id AS record_id, text AS \"TEXT\", source AS \"DATA_SOURCE\" FROM documents")
def _(spark, sf):
    path = scratch_dir(spark, "records")
    rows = documents(spark, sf)
    wr.write_records(
        rows.select(wr.record_id("source", "doc_id").alias("record_id"), F.col("text").alias("TEXT"), F.col("source").alias("DATA_SOURCE")), path
    )
    return spark.read.parquet(path)


@query("write_chunks", _DOCS)
def _(spark, sf):
    path = scratch_dir(spark, "chunks")
    wr.write_chunks(documents(spark, sf), path, 100)
    return spark.read.parquet(path)


@query("write_splits", f"""
SELECT doc_id, text, CASE WHEN r < 60 THEN 'test' WHEN r < 150 THEN 'validation' ELSE 'train' END AS split FROM (
SELECT doc_id, text, row_number() OVER (ORDER BY {hkey(4, 'doc_id')} DESC, doc_id DESC) - 1 AS r FROM documents)""")
def _(spark, sf):
    path = scratch_dir(spark, "splits")
    wr.write_splits(sa.split_tail(documents(spark, sf, "doc_id", "text"), ["doc_id"], 90, 60, seed=4), path)
    return rd.read_splits(spark, path)


@query("read_splits", "SELECT doc_id, text, 'train' AS split FROM documents")
def _(spark, sf):
    path = scratch_dir(spark, "nosplit")
    documents(spark, sf, "doc_id", "text").write.parquet(path)
    return rd.read_splits(spark, path)


_FREQ = (
    r"SELECT word, count(*) AS frequency FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word "
    "FROM documents) GROUP BY word"
)


@query("read_vocab", _FREQ)
def _(spark, sf):
    """A frequency table written as CSV and read as a vocabulary."""
    from catalog.common import frequencies

    path = scratch_dir(spark, "vocab")
    wr.write_csv(frequencies(spark, sf), path)
    return rd.read_vocab(spark, path, schema="word string, frequency bigint")


@query("write_csv", _FREQ)
def _(spark, sf):
    from catalog.common import frequencies

    path = scratch_dir(spark, "csv")
    wr.write_csv(frequencies(spark, sf), path)
    return spark.read.schema("word string, frequency bigint").option("header", True).csv(path)


@query("write_string_list", f"WITH {SPANS} SELECT span FROM spans")
def _(spark, sf):
    path = scratch_dir(spark, "lists")
    docs = documents(spark, sf, "doc_id", F.lower("text").alias("text"))
    wr.write_string_list(cu.to_spans(docs), path)
    return spark.read.schema("span string").json(path)


@query("read_string_lists", """
SELECT CAST(position AS BIGINT) AS position, text FROM (SELECT unnest(range(0, len(p))) AS position, unnest(p) AS text
FROM (SELECT string_split(text, '.') AS p FROM documents))""")
def _(spark, sf):
    """A JSON array of its sentences per document, written and read."""
    path = scratch_dir(spark, "arrays")
    documents(spark, sf, F.to_json(tx.dot_sentences("text")).alias("value")).write.text(path)
    return as_bigint(rd.read_string_lists(spark, path, lines=True), "position").select("position", "text")


@query("read_record_map", "SELECT CAST(doc_id AS VARCHAR) AS record_id, text AS \"TEXT\", source AS \"DATA_SOURCE\" FROM documents")
def _(spark, sf):
    """JSON objects of records, one object per line."""
    path = scratch_dir(spark, "maps")
    record = F.struct(F.col("text").alias("TEXT"), F.col("source").alias("DATA_SOURCE"))
    documents(spark, sf).select(F.to_json(F.create_map(F.col("doc_id").cast("string"), record)).alias("value")).write.text(path)
    return rd.read_record_map(spark, path, "TEXT string, DATA_SOURCE string", lines=True)


@query("read_age_lines", r"""
SELECT word, round(CAST(days AS DOUBLE) / 365, 9) AS age, CAST(days AS VARCHAR) AS raw_age FROM (
SELECT doc_id * 7 % 2190 + 1 AS days, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS word FROM documents)""")
def _(spark, sf):
    path = scratch_dir(spark, "ages")
    days = ((F.col("doc_id") * 7) % 2190 + 1).cast("string")
    words = F.array_join(F.transform(tx.word_tokens("text"), lambda w: F.concat(F.lit("'"), w, F.lit("'"))), ", ")
    lines = documents(spark, sf, "text", F.concat(days, F.lit(":\n["), words, F.lit("]")).alias("value"))
    lines.where(F.size(tx.word_tokens("text")) > 0).select("value").write.text(path)
    return rounded(rd.read_age_lines(spark, path), "age", digits=9)


@query("read_eval_files", """
SELECT item_id, CAST(length(text) AS BIGINT) AS label, 'train' AS split FROM benchmark
UNION ALL SELECT item_id, length(text), 'validation' FROM benchmark""")
def _(spark, sf):
    path = scratch_dir(spark, "evalfiles")
    rows = table(spark, sf, "benchmark", "item_id", F.length("text").cast("bigint").alias("label"))
    for name in ("train", "validation"):
        rows.write.option("header", True).csv(f"{path}/{name}.csv")
    return rd.read_eval_files(spark, f"{path}/train.csv", f"{path}/validation.csv", schema="item_id bigint, label bigint")


@query("read_pair_tsv", """
SELECT '1' AS label, CAST(a.conv_id AS VARCHAR) AS id1, CAST(a.turn AS VARCHAR) AS id2,
replace(a.text, chr(10), ' ') AS s1, replace(b.text, chr(10), ' ') AS s2
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def _(spark, sf):
    path = scratch_dir(spark, "pairs")
    flat = lambda c: F.replace(F.col(c), F.lit("\n"), F.lit(" "))
    rows = turn_pairs(spark, sf).select(
        F.lit("1").alias("label"), F.col("conv_id").alias("id1"), F.col("turn").alias("id2"), flat("s1").alias("s1"), flat("s2").alias("s2")
    )
    rows.write.option("header", True).option("quote", "").csv(path, sep="\t")
    return rd.read_pair_tsv(spark, path)


# --- resume ----------------------------------------------------------------------------
_MANIFEST = "m AS (SELECT source AS file, max(doc_id) // 2 AS end_row FROM documents GROUP BY 1)"


def _manifest(spark, sf):
    rows = documents(spark, sf, F.col("source").alias("file"), F.col("doc_id").alias("row_no"))
    return rows, rows.groupBy("file").agg(F.floor(F.max("row_no") / 2).alias("end_row"))


@query("resume_manifest", f"WITH {_MANIFEST} SELECT file, doc_id AS row_no FROM documents JOIN m ON file = source WHERE doc_id >= end_row")
def _(spark, sf):
    return mf.pending(*_manifest(spark, sf))


@query("advance_manifest", "SELECT source AS file, max(doc_id) + 1 AS end_row FROM documents GROUP BY 1")
def _(spark, sf):
    rows, manifest = _manifest(spark, sf)
    return mf.advance(manifest, mf.pending(rows, manifest))


def _turns(spark, sf):
    """Numbered rows of files: three writers take turns of fifty rows."""
    rows = documents(spark, sf, F.col("source").alias("file"), F.col("doc_id").alias("row_no"))
    return rows, F.floor(F.col("row_no") / 50) % 3


def _committed(spark, sf, *writers):
    """A resume table after ``writers`` have finished, in this order."""
    path = scratch_dir(spark, "intervals")
    rows, writer = _turns(spark, sf)
    for w in writers:
        iv.commit(iv.covered(rows.where(writer == w)), path)
    return iv.read(spark, path)


_TURN = "doc_id // 50 % 3"


@query("resume_intervals", f"SELECT source AS file, doc_id AS row_no FROM documents WHERE NOT coalesce({_TURN} <> 1 AND source IS NOT NULL, false)")
def _(spark, sf):
    """Rows left after two of three writers finished, the last one first."""
    return iv.pending(_turns(spark, sf)[0], _committed(spark, sf, 2, 0))


@query("finished_intervals", f"""
SELECT file, min(doc_id) AS start_row, max(doc_id) + 1 AS end_row FROM (
SELECT source AS file, doc_id, doc_id - row_number() OVER (PARTITION BY source ORDER BY doc_id) AS run
FROM (SELECT DISTINCT source, doc_id FROM documents WHERE {_TURN} <> 1 AND source IS NOT NULL)) GROUP BY file, run""")
def _(spark, sf):
    return _committed(spark, sf, 2, 0)


@query("arrow_splits", ORACLE["write_splits"])
def _(spark, sf):
    """The splits of ``write_splits`` as folders of Arrow files, written and read."""
    path = scratch_dir(spark, "arrow")
    af.write_arrow_splits(sa.split_tail(documents(spark, sf, "doc_id", "text"), ["doc_id"], 90, 60, seed=4), path)
    return af.read_arrow_splits(spark, path)


# --- incremental -------------------------------------------------------------------------
def _stream(spark, sf):
    """The documents as a growing folder of several files."""
    path = scratch_dir(spark, "incoming")
    documents(spark, sf).repartition(6).write.parquet(path)
    return rd.stream_corpus(spark, path, "doc_id bigint, source string, text string", files_per_batch=2)


def _finish(started, spark, sink):
    started.awaitTermination()
    return spark.read.parquet(sink).drop("batch_id")


@query("stream_corpus", _DOCS)
def _(spark, sf):
    sink, marks = scratch_dir(spark, "sink"), scratch_dir(spark, "marks")
    copy = _stream(spark, sf).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks)
    copy.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink)


@query("stream_filter", f"WITH {KEPT} SELECT doc_id, source, start, n_tokens, span FROM kept")
def _(spark, sf):
    sink, marks = scratch_dir(spark, "sink"), scratch_dir(spark, "marks")
    vocab = vocabulary(spark, sf)
    return as_bigint(_finish(st.stream_filter(_stream(spark, sf), vocab, sink, marks), spark, sink), "start")


@query("stream_resume", f"WITH {KEPT} SELECT doc_id, source, start, n_tokens, span FROM kept")
def _(spark, sf):
    """Started twice on one checkpoint, with new files in between: nothing is repeated or missed."""
    path, sink, marks = (scratch_dir(spark, n) for n in ("incoming", "sink", "marks"))
    vocab, docs = vocabulary(spark, sf), documents(spark, sf)
    some = -(-spark.sparkContext.defaultParallelism // 2)  # files of a batch: two batches at each start, every core has work
    docs.where("doc_id % 2 = 0").repartition(3 * some).write.parquet(path)
    stream = rd.stream_corpus(spark, path, "doc_id bigint, source string, text string", files_per_batch=2 * some)
    st.stream_filter(stream, vocab, sink, marks).awaitTermination()
    docs.where("doc_id % 2 = 1").repartition(3 * some).write.mode("append").parquet(path)
    return as_bigint(_finish(st.stream_filter(stream, vocab, sink, marks), spark, sink), "start")


@query("stream_sample", f"""
WITH {SPANS.replace('lower(text)', 'text')}, s AS (SELECT doc_id, source, start, span FROM spans
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {hkey(0, 'doc_id', 'start')}, start) <= 4)
SELECT doc_id, source, start, span FROM s ORDER BY {hkey(9, 'doc_id', 'start')}, doc_id, start LIMIT 1000""")
def _(spark, sf):
    sink, marks = scratch_dir(spark, "sink"), scratch_dir(spark, "marks")
    found = _finish(st.stream_sample(_stream(spark, sf), 4, sink, marks), spark, sink)
    return as_bigint(st.read_sample(found, 1000, seed=9), "start")


@query("stream_reservoir", ORACLE["stream_sample"])
def _(spark, sf):
    """As ``stream_sample``, but only the total of 1,000 spans is ever kept."""
    sink, marks = scratch_dir(spark, "sink"), scratch_dir(spark, "marks")
    st.stream_reservoir(_stream(spark, sf), 4, 1000, sink, marks, total_seed=9).awaitTermination()
    return as_bigint(st.read_reservoir(spark, sink), "start")


@query("stream_dedup", "SELECT DISTINCT text FROM documents")
def _(spark, sf):
    sink, marks = scratch_dir(spark, "sink"), scratch_dir(spark, "marks")
    started = st.stream_dedup(_stream(spark, sf), sink, marks, "text", ["doc_id"], across_batches=True)
    return _finish(started, spark, sink).select("text")


# --- grid of subword vocabularies -----------------------------------------------------------
FAMILIES, GRID_SIZES = ("BPE", "WordPiece"), (30_000, 32_000)


@query("tokenizer_experiment")
def _(spark, sf):
    docs = documents(spark, sf, "text")
    parts = docs.select(F.explode(tx.word_tokens("text")).alias("word")).distinct().select(
        "word", F.array(F.substring("word", 1, 3), F.expr("substring(word, 4)")).alias("parts")
    )
    tasks = documents(spark, sf, F.col("lang").alias("task"), "text")
    return tokenizer_experiment(docs, docs, parts, FAMILIES, GRID_SIZES, tasks)
