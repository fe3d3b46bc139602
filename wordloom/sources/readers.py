"""Readers: files to DataFrames of the corpus data model.

Schemas are given, not inferred, wherever the format is known, so opening a
source runs no job over the data.
"""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from wordloom.operators.ordering import running_by_group
from wordloom.session import measured, scratch_dir

# --- fixed values: text column and splits of the named corpora ---------------------------
CORPORA = {
    "wikipedia": ("text", ("train",)),
    "bookcorpus": ("text", ("train",)),
    "cbt": ("content", ("train", "test", "validation")),
    "c4": ("text", ("train", "validation")),
    "wikitext": ("text", ("train", "validation", "test")),
}
DOC_END = "</doc>"
DOC_HEAD_END = "\">\n"
RECORD_SCHEMA = (
    "TEXT string, DATA_SOURCE string, SENTENCE_LENGTH int, TOTAL_AGE int, AVG_AGE double, "
    "OOV_COUNT int, OOV_WORDS array<string>"
)
# --------------------------------------------------------------------------------------------


def to_corpus(df: DataFrame, source: str, split: str, text: str = "text") -> DataFrame:
    """Common corpus shape: source, split, text."""
    return df.select(F.lit(source).alias("source"), F.lit(split).alias("split"), F.col(text).alias("text"))


def union_corpora(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def read_corpus(
    spark: SparkSession, name: str, paths: Mapping[str, str], fmt: str = "parquet", text: str | None = None,
) -> DataFrame:
    """A named corpus: its splits (name to path) in one table."""
    column, splits = CORPORA.get(name, ("text", tuple(paths)))
    column = text or column
    reader = spark.read if fmt == "parquet" else spark.read.schema(f"`{column}` string")
    wanted = [s for s in splits if s in paths]
    if not wanted:
        raise ValueError(f"no path for any of the splits {splits}")
    return union_corpora([to_corpus(reader.format(fmt).load(paths[s]), name, s, column) for s in wanted])


def split_markup_docs(
    df: DataFrame, text: str = "value", end: str = DOC_END, head_end: str = DOC_HEAD_END, keep_blank: bool = False,
) -> DataFrame:
    """Concatenated documents to rows: cut at ``end``, keep what follows the
    last ``head_end``.  Blank documents are dropped unless ``keep_blank``."""
    others = [c for c in df.columns if c != text]
    parts = df.select(*others, F.posexplode(F.split(text, _literal(end))).alias("doc_no", "_p"))
    body = F.element_at(F.split("_p", _literal(head_end)), -1)
    docs = parts.select(*others, "doc_no", body.alias("text"))
    return docs if keep_blank else docs.where(F.col("text").rlike(r"\S"))


def _literal(s: str) -> str:
    import re

    return re.escape(s)


def read_markup_docs(
    spark: SparkSession, glob: str, keep_blank: bool = False, end: str = DOC_END, head_end: str = DOC_HEAD_END, lines: bool = False,
) -> DataFrame:
    """path, doc_no, text from extractor files holding many documents each, or with the documents of
    one source on each line (``lines``), counted anew on every line.

    A document or a line, not a file, is a record: large files are split and read in parallel.
    """
    if lines:
        files = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), "value")
        docs = split_markup_docs(files, "value", end, head_end, keep_blank)
        return docs.select("path", F.col("doc_no").cast("bigint").alias("doc_no"), "text")
    parts = spark.read.text(glob, lineSep=end).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"),
        F.element_at(F.split("value", _literal(head_end)), -1).alias("text"))
    docs = running_by_group(parts, ["path"], ["_start", "_at"], {}, position="doc_no").select("path", "doc_no", "text")
    return docs if keep_blank else docs.where(F.col("text").rlike(r"\S"))


def parse_string_lists(df: DataFrame, text: str = "value") -> DataFrame:
    """Rows of JSON arrays of strings to one row per string."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.from_json(text, "array<string>")).alias("position", "text"))


def read_string_lists(spark: SparkSession, glob: str, lines: bool = False) -> DataFrame:
    """path, position, text from files that are JSON arrays of strings, or hold one on
    each line (``lines``: such files are split)."""
    files = spark.read.text(glob, wholetext=not lines).select(F.input_file_name().alias("path"), "value")
    return parse_string_lists(files)


def parse_record_maps(df: DataFrame, text: str = "value", value_schema: str = RECORD_SCHEMA) -> DataFrame:
    """record_id and fields of JSON objects of records."""
    maps = df.select(F.from_json(text, f"map<string, struct<{_ddl_fields(value_schema)}>>").alias("_m"))
    return maps.select(F.explode("_m").alias("record_id", "_r")).select("record_id", "_r.*")


def read_record_map(spark: SparkSession, glob: str, value_schema: str = RECORD_SCHEMA, lines: bool = False) -> DataFrame:
    """record_id and fields from files that are JSON objects of records, or hold one on
    each line (``lines``: such files are split)."""
    return parse_record_maps(spark.read.text(glob, wholetext=not lines), value_schema=value_schema)


def _ddl_fields(schema: str) -> str:
    fields, depth, out = [], 0, ""
    for ch in schema + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            fields.append(out.strip())
            out = ""
        else:
            out += ch
    return ", ".join(": ".join(f.split(" ", 1)) for f in fields)


def read_vocab(spark: SparkSession, path: str, word_col: str = "word", schema: str | None = None) -> DataFrame:
    """Vocabulary CSV with a header; rows without a word are dropped.

    Words such as ``null`` or ``nan`` stay words.  Of a repeated word the largest
    value of each other column stays.
    """
    reader = spark.read.option("header", True)
    df = (reader.schema(schema) if schema else reader).csv(path)
    df = df.withColumnRenamed(word_col, "word").where(F.col("word").isNotNull())
    others = [F.max(c).alias(c) for c in df.columns if c != "word"]
    once = df.groupBy("word").agg(*others) if others else df.distinct()
    return once.select(*df.columns)


def parse_age_lines(df: DataFrame, text: str = "value") -> DataFrame:
    """word, age (years), raw_age (days as written) from alternating lines
    ``<age>:`` and ``['w1', 'w2', …]``."""
    lines = df.select(F.split(text, "\n").alias("_l"))
    pairs = lines.where(F.size("_l") >= 2).select(
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.floor(F.size("_l") / 2).cast("int") - 1),
                lambda i: F.struct(
                    F.get("_l", 2 * i).alias("age_line"), F.get("_l", 2 * i + 1).alias("words_line")
                ),
            )
        ).alias("_p")
    )
    return _age_words(pairs.select("_p.*"))


def _age_words(pairs: DataFrame) -> DataFrame:
    raw = F.regexp_replace("age_line", ".$", "")
    body = F.substring("words_line", 2, 2**31 - 1)
    words = pairs.select(raw.alias("raw_age"), F.explode(F.split(body, ",")).alias("_w"))
    return words.select(
        F.regexp_replace("_w", "[ '\\]]", "").alias("word"), (F.col("raw_age").cast("double") / 365).alias("age"), "raw_age"
    )


def read_age_lines(spark: SparkSession, path: str) -> DataFrame:
    """``parse_age_lines`` of files.  A line, not a file, is a record: large files are split.

    Lines are written once with their place in their split; one row per split then gives
    their number in the file, and an age line meets the line after it by a join.
    """
    scan = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"), (F.octet_length("value") + 1).alias("bytes"), "value")
    kept = scratch_dir(spark, "age-lines")
    scan.write.parquet(kept)
    lines = spark.read.schema(scan.schema).parquet(kept)
    splits = lines.groupBy("path", "start").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("size").alias("size"))
    file = Window.partitionBy("path")  # of its splits
    earlier = file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    offsets = measured(splits.select(
        "path", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        (F.sum("bytes").over(file) == F.col("size")).alias("closed")))
    numbered = lines.select("path", "start", "at", "value").join(offsets, ["path", "start"]).withColumn("_n", F.col("at") + F.col("shift"))
    pair = F.floor(F.col("_n") / 2).alias("pair")
    ages = numbered.where("_n % 2 = 0").select("path", pair, "closed", F.col("value").alias("age_line"))
    words = numbered.where("_n % 2 = 1").select("path", pair, F.col("value").alias("words_line"))
    both = ages.join(words, ["path", "pair"], "left")
    # a last age line that is ended stands before an empty line
    return _age_words(both.where("closed OR words_line IS NOT NULL").select("age_line", F.coalesce("words_line", F.lit("")).alias("words_line")))


def read_eval_files(
    spark: SparkSession, train: str, validation: str, test: str | None = None, schema: str | None = None, predict: bool = False,
) -> DataFrame:
    """Local CSV or JSON splits in one table with ``split``.

    The extensions must agree; a test file is required only for prediction.
    """
    ext = os.path.splitext(train)[1].lstrip(".")
    if ext not in ("csv", "json"):
        raise ValueError("train file must be csv or json")
    for path in (validation, *([test] if test else [])):
        if os.path.splitext(path)[1].lstrip(".") != ext:
            raise ValueError("all files must have the same extension")
    if predict and not test:
        raise ValueError("a test file is needed to predict")
    reader = spark.read.option("header", True) if ext == "csv" else spark.read
    parts = []
    for split, path in (("train", train), ("validation", validation), ("test", test)):
        if path:
            if schema is None:
                df = reader.option("inferSchema", True).format(ext).load(path)
                schema = df.schema if split == "train" else schema
            else:
                df = reader.schema(schema).format(ext).load(path)
            parts.append(df.withColumn("split", F.lit(split)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_pair_tsv(spark: SparkSession, path: str) -> DataFrame:
    """label, id1, id2, s1, s2; quotation marks are data."""
    schema = "label string, id1 string, id2 string, s1 string, s2 string"
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path, sep="\t", quote="")


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """A split table; data without a split column is all train."""
    df = spark.read.parquet(path)
    return df if "split" in df.columns else df.withColumn("split", F.lit("train"))


def stream_corpus(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int = 100) -> DataFrame:
    """Incremental corpus: new files in bounded batches."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
    )
