"""Line de-duplication against levelled sorted runs of line hashes.

A run is a Parquet folder of (hash, first document) sorted by hash within hash
ranges.  Each batch of documents is joined with the runs by hash (what they do
not hold is new), and the new hashes become a run of level 0.  When a level
holds ``FANOUT`` runs they are merged into one run of the next level, so a batch
meets a number of runs that grows with the logarithm of the batches.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.llm.common import carried, set_columns, table, written
from wordloom.llm.registry import query
from wordloom.session import scratch_dir

MIN_CHARS = 10
FANOUT = 2
BATCHES = 4
RUN_SCHEMA = "h binary, first bigint"


def _key(line: bytes) -> bytes:
    """The line without blanks at its ends, A-Z lower-cased (bytes methods touch ASCII only)."""
    return line.strip().lower()


def _counts(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def line_hashes(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """Distinct 128-bit hashes of a text's line keys of at least ``min_chars``."""

    @F.arrow_udf("array<binary>")
    def hashes(texts: pa.Array) -> pa.Array:
        offsets, out = [0], []
        for t in texts:
            keys = {_key(line) for line in (t.as_py() or "").encode().split(b"\n")}
            out += [xxhash.xxh3_128_digest(k) for k in keys if _counts(k, min_chars)]
            offsets.append(len(out))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out, pa.binary()))

    return hashes(text)


def without_lines(text: Column, dropped: Column, min_chars: int = MIN_CHARS) -> Column:
    """struct(text, n_lines, n_dropped): the text without lines whose hash is in ``dropped``."""

    @F.arrow_udf("struct<text:string,n_lines:bigint,n_dropped:bigint>")
    def rebuild(texts: pa.Array, drops: pa.Array) -> pa.Array:
        kept, total, gone = [], [], []
        for t, d in zip(texts, drops):
            raw = (t.as_py() or "").encode()
            lines = raw.split(b"\n")
            drop = set(d.as_py() or ())
            left = [x for x in lines if not (_counts(k := _key(x), min_chars) and xxhash.xxh3_128_digest(k) in drop)] if drop else lines
            kept.append(b"\n".join(left).decode())
            total.append(len(lines))
            gone.append(len(lines) - len(left))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], ["text", "n_lines", "n_dropped"])

    return rebuild(text, dropped)


class LineRuns:
    """The levelled runs, in the shared folder or any other that all executors see."""

    def __init__(self, spark: SparkSession, path: str | None = None, fanout: int = FANOUT):
        self.spark, self.fanout = spark, fanout
        self.path = path or scratch_dir(spark, "line-runs")
        self.levels: dict[int, list[str]] = {}

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.path}/level{level}-{uuid.uuid4().hex}"
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows.repartition(n, "h").sortWithinPartitions("h").write.parquet(path)
        self.levels.setdefault(level, []).append(path)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(RUN_SCHEMA).parquet(path)

    def runs(self) -> list[DataFrame]:
        return [self._read(p) for level in sorted(self.levels) for p in self.levels[level]]

    def add(self, pairs: DataFrame) -> DataFrame:
        """Pairs (doc_id, h) of one batch; returns those to drop and adds the new hashes.

        A hash of the runs belongs to an earlier batch: all its pairs go.  Of a
        new hash the pairs of the smallest document of the batch stay.
        """
        keys = pairs.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        old = None
        for run in self.runs():
            held = run.select("h")
            old = held if old is None else old.unionByName(held)  # a hash is in one run only
        if old is None:
            marked = keys.withColumn("old", F.lit(False))
        else:
            marked = keys.join(old.withColumn("old", F.lit(True)), "h", "left").withColumn("old", F.coalesce("old", F.lit(False)))
        marked = written(marked, "line-keys")
        self._write(marked.where("not old").select("h", "first"), 0)
        self._compact()
        repeated = marked.where("old or first < last").select("h", F.when(~F.col("old"), F.col("first")).alias("first"))
        return pairs.join(repeated, "h").where("first is null or doc_id > first").select("doc_id", "h")

    def _compact(self) -> None:
        """Merge full levels; the merged runs' folders stay for readers that began before."""
        level = 0
        while len(self.levels.get(level, [])) >= self.fanout:
            merged = self._read(self.levels[level][0])
            for path in self.levels[level][1:]:
                merged = merged.unionByName(self._read(path))
            self.levels[level] = []
            self._write(merged, level + 1)
            level += 1


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """Drop lines that a document with a smaller ``doc_id`` holds too.

    ``docs`` needs doc_id and text; other columns stay.  ``text`` is replaced,
    ``n_lines`` (before) and ``n_dropped`` are set.  Documents go through the
    runs in batches of ascending doc_id, so the smallest holder of a line keeps
    it.  A null or empty text is one empty line and becomes an empty text.  A
    null doc_id comes after all others.  Rows of one doc_id are one document:
    they keep the same lines, and every row stays a row.  Other columns may have any name.
    """
    return carried(docs, ("doc_id", "text"), ("text", "n_lines", "n_dropped"), lambda rows: _dedup(rows, min_chars, batches, fanout))


def _dedup(docs: DataFrame, min_chars: int, batches: int, fanout: int) -> DataFrame:
    spark = docs.sparkSession
    last = F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))
    shares = [k / batches for k in range(1, batches)]
    cuts = set(shares and docs.agg(F.percentile_approx(last, shares, 1000)).first()[0] or ())
    batch = sum(((last > F.lit(c)).cast("int") for c in cuts), F.lit(0))
    lines = docs.select(last.alias("doc_id"), batch, F.explode(line_hashes(docs["text"], min_chars))).toDF("doc_id", "batch", "h")
    pairs = written(lines, "line-pairs")
    runs = LineRuns(spark, fanout=fanout)
    drops = None
    for k in range(len(cuts) + 1):
        found = runs.add(pairs.where(F.col("batch") == k).select("doc_id", "h"))
        drops = found if drops is None else drops.unionByName(found)
    lists = drops.groupBy("doc_id").agg(F.collect_set("h").alias("dedup_drop")).withColumnRenamed("doc_id", "dedup_id")
    joined = docs.join(lists, last == F.col("dedup_id"), "left")
    out = joined.withColumn("dedup_new", without_lines(docs["text"], F.col("dedup_drop"), min_chars))
    new = {c: F.col(f"dedup_new.{c}") for c in ("text", "n_lines", "n_dropped")}
    return set_columns(out, new).drop("dedup_new", "dedup_drop", "dedup_id")


_SQL = r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut),
keyed AS (SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, i, line, coalesce(doc_id > first, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", _SQL)
def op3_line_dedup(spark, sf):
    out = dedup_lines(table(spark, sf, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
