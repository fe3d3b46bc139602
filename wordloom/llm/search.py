"""Ranked lexical search, reversed: the items are indexed, the documents stream by.

The items' terms become an inverted index of bounded size that every task holds.  A
first pass reduces each document to its length and its counts of those terms; sums
over these give the corpus statistics.  A second pass drives the counts through the
index and updates one bounded heap per item; the heaps of all tasks are merged.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from wordloom.llm.common import LOWER, UPPER, table, written
from wordloom.llm.registry import query
from wordloom.operators.ordering import global_running_sum

TOP = 20
POSTINGS = 500_000      # (item, term) entries of an index; more items are searched in several passes
CELLS = 2_000_000       # scores, and postings met, that a task computes at a time
# Fixed values of the contract: what separates terms (all other bytes belong to one), the
# score's whole-number parameters
_BETWEEN = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_FLAT, _BY_LENGTH, _SCALE, _TF, _M = 75, 25, 1_000_000_000, 1_000, 12
_BYTES = bytes.maketrans(bytes(_BETWEEN) + UPPER.encode(), b" " * len(_BETWEEN) + LOWER.encode())


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased; a null text has none."""
    return (text or b"").translate(_BYTES).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class _Index:
    """term -> number; postings of a term: items and how often each repeats it."""

    def __init__(self, texts: list[bytes | None]):
        self.items = len(texts)
        self.number: dict[bytes, int] = {}
        lists: list[list[tuple[int, int]]] = []
        for item, text in enumerate(texts):
            for term, times in Counter(terms(text)).items():
                k = self.number.setdefault(term, len(lists))
                if k == len(lists):
                    lists.append([])
                lists[k].append((item, times))
        self.size = np.array([len(x) for x in lists], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)])[:-1].astype(np.int64)
        flat = np.array([p for x in lists for p in x], np.int64).reshape(-1, 2)
        self.item, self.times = flat[:, 0].copy(), flat[:, 1].copy()


def _counted(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms), term and tf (numbers and counts of the index' terms)."""

    def count(batches):
        number = index.value.number
        for batch in batches:
            sizes, offsets, found, times = [], [0], [], []
            for text in batch.column(1):
                words = terms(text.as_py())
                sizes.append(len(words))
                counts = Counter(map(number.get, words))
                counts.pop(None, None)
                found += counts.keys()
                times += counts.values()
                offsets.append(len(found))
            at = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())),
                pa.ListArray.from_arrays(at, pa.array(times, pa.int64()))], ["doc_id", "n", "term", "tf"])

    return docs.mapInArrow(count, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


class _Heaps:
    """The best documents of each item so far; equal scores prefer the smaller id, null last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items)  # what a document must reach; scores are whole numbers

    def offer(self, ids: list[int | None], scores: np.ndarray) -> None:
        """``scores`` is a row per document, a column per item."""
        least = self.least
        if len(scores) > self.top:
            cut = len(scores) - self.top
            least = np.maximum(least, np.partition(scores, cut, axis=0)[cut])
        at, items = np.nonzero(scores >= least)
        for row, item, score in zip(at.tolist(), items.tolist(), scores[at, items].tolist()):
            entry = (int(score), -(2**63 if ids[row] is None else ids[row]))
            heap = self.heaps[item]
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]

    def rows(self) -> pa.RecordBatch:
        flat = [(item, None if doc == -(2**63) else -doc, score) for item, heap in enumerate(self.heaps) for score, doc in heap]
        columns = zip(*flat) if flat else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], ["item", "doc_id", "score"])


def _scores(index: _Index, weights: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Scores of len(m) documents and all items, whole numbers below 2**53."""
    gain = weights[term] * ((_SCALE * tf) // (_TF * tf + _M * m[doc]))
    sizes = index.size[term]
    entry = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(index.start[term], sizes)
    cell = np.repeat(doc, sizes) * index.items + index.item[entry]
    sums = np.bincount(cell, np.repeat(gain, sizes) * index.times[entry], len(m) * index.items)
    return sums.reshape(len(m), index.items)


def _best(counted: DataFrame, index, n_docs: int, n_terms: int, df: dict[int, int], top: int) -> DataFrame:
    """item, doc_id, score: each task's heaps."""

    def search(batches):
        own = index.value
        weights = np.array([weight(n_docs, df.get(k, 0)) for k in range(len(own.number))], np.int64)
        heaps = _Heaps(own.items, top)
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ends = np.append(batch.column(2).offsets.to_numpy(), 0)[: batch.num_rows + 1]
            term, tf = batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()
            met = np.concatenate([[0], np.cumsum(own.size[term])])
            lo = 0
            while lo < batch.num_rows:  # documents whose scores and postings fit the bound; at least one
                most = min(batch.num_rows, lo + max(1, CELLS // max(1, own.items)))
                hi = int(np.searchsorted(met[ends[lo + 1: most + 1]], met[ends[lo]] + CELLS, "right")) + lo
                hi = max(lo + 1, hi)
                a, b = int(ends[lo]), int(ends[hi])
                doc = np.repeat(np.arange(hi - lo), np.diff(ends[lo: hi + 1]))
                m = np.array([_FLAT + _BY_LENGTH * n * n_docs // max(1, n_terms) for n in sizes[lo:hi]], np.int64)
                heaps.offer(ids[lo:hi], _scores(own, weights, doc, term[a:b].astype(np.int64), tf[a:b], m))
                lo = hi
        yield heaps.rows()

    return counted.mapInArrow(search, "item bigint, doc_id bigint, score bigint")


def _in_passes(items: DataFrame, postings: int) -> list[list]:
    """The items' (id, text) in groups whose index has at most ``postings`` entries.  An
    item is not split: one that is larger makes a group of its own."""
    size = F.size(F.array_distinct(F.split(F.translate("text", UPPER, LOWER), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    sized = items.withColumn("_n", F.coalesce(size, F.lit(0)).cast("bigint"))
    total = sized.agg(F.sum("_n")).first()[0] or 0
    if total <= postings:
        return [[tuple(r) for r in items.collect()]]
    placed = global_running_sum(sized, [F.col("id").asc(), F.xxhash64("text").asc()], {"_upto": F.col("_n")})
    placed = written(placed.withColumn("_pass", F.floor(((F.col("_upto") - 1) * 2) / F.lit(postings))), "search-items")
    numbers = sorted(r[0] for r in placed.select("_pass").distinct().collect())
    return [[(r["id"], r["text"]) for r in placed.where(F.col("_pass") == k).select("id", "text").collect()] for k in numbers]


def search(docs: DataFrame, items: DataFrame, top: int = TOP, postings: int = POSTINGS, item_id: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents with a score above 0.

    Every document is scored against every item that shares a term with it.  A null
    text has no terms; empty documents are in no statistic.  Equal scores go by
    ascending doc_id, null last; rows of ``docs`` that repeat a doc_id are documents of
    their own, rows of ``items`` that repeat an id items of their own.  Texts of any length
    are read whole.  Without documents or items the result is empty.  ``docs`` needs
    doc_id and text; other columns do not matter.
    """
    spark = docs.sparkSession
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    asked = items.select(items[f"`{item_id}`"].alias("id"), items["text"].alias("text"))
    out = None
    for group in _in_passes(asked, postings):
        index = _Index([None if text is None else text.encode() for _, text in group])
        shared = spark.sparkContext.broadcast(index)
        counted = written(_counted(narrow, shared), "search-counts")
        n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        rows = counted.select(F.explode("term").alias("term")).groupBy("term").count().collect()  # at most the index' terms
        best = _best(counted, shared, n_docs, n_terms, {r[0]: r[1] for r in rows}, top)
        order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(i for i, _ in group)), f"item bigint, item_id {asked.schema['id'].dataType.simpleString()}")
        found = ranked.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


_TERM = r"'[0-9a-z\x{80}-\x{10FFFF}]+'"


def _low(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), {_TERM})"


_SQL = f"""
WITH d AS (SELECT doc_id, {_low('text')} AS t FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(t) AS n FROM d WHERE len(t) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM d) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_low('text')}) AS term FROM benchmark) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM df, total),
m AS (SELECT doc_id, 75 + (25 * n * docs) // terms AS m FROM sizes, total),
scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM items JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""


@query("op12_ranked_search", _SQL)
def op12_ranked_search(spark, sf):
    return search(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"))
