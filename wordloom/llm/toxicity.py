"""Toxicity: logistic regression over hashed word n-grams and skip-grams.

FTRL-proximal learns the weights: every coordinate has a learning rate of its own, and
an L1 term keeps all but a few weights at zero, so that the model is small enough to
go to every task.  Features are counted as present or absent.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from wordloom.llm.common import table, written
from wordloom.llm.registry import query
from wordloom.session import measured

BITS = 20           # features are hashed to 2**BITS coordinates
GAPS = (1, 2, 3)    # pairs of neighbours, and of words with one or two others between them
SAMPLE = 12_000     # labelled documents that the model is learned from, at most; chosen by a hash of doc_id
EPOCHS = 5
ALPHA, BETA = 3.0, 1.0
L1, L2 = 4.0, 0.01
THRESHOLD = 0.3
MEMO = 500_000      # word hashes that a task remembers
_BETWEEN = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_BYTES = bytes.maketrans(_BETWEEN, b" " * len(_BETWEEN))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # odd multipliers that spread bits


class _Words(dict):
    """word -> hash, computed once while it is remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def coordinates(text: str | None, words: _Words, bits: int = BITS) -> np.ndarray:
    """Coordinates of a text's words and word pairs, with repeats.  Words are runs of letters
    and digits, in lower case; a null text has none."""
    split = (text or "").lower().encode("utf-8", "replace").translate(_BYTES).split()
    h = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    parts = [h * _A]
    for gap in GAPS:
        if len(h) > gap:
            both = (h[:-gap] * _B + h[gap:]) * _A + np.uint64(gap) * (_B >> np.uint64(8))
            parts.append((both ^ (both >> np.uint64(29))) * _A)
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int32)


class Ftrl:
    """FTRL-proximal for features that are present or absent; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.size, self.alpha, self.beta, self.l1, self.l2 = size, alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == self.size, 0.0, self.l1)  # the bias is not pulled to zero
        rate = (self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2
        return np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / rate, 0.0)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, self.size)
        w = self.weights(at)
        gradient = sigmoid(w.sum()) - label
        n = self.n[at]
        step = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha
        self.z[at] += gradient - step * w
        self.n[at] = n + gradient * gradient


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass(frozen=True)
class Model:
    """Coordinates with a weight, in order, and the bias."""

    bits: int
    at: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << self.bits)
        out[self.at] = self.weight
        return out


def score_of(text: str | None, weights: np.ndarray, bias: float, words: _Words) -> float:
    bits = len(weights).bit_length() - 1
    at = coordinates(text, words, bits)
    at = np.unique(at[weights[at] != 0])
    return float(sigmoid(weights[at].sum() + bias))


def _features(rows: DataFrame, bits: int) -> DataFrame:
    """order, toxic and the distinct coordinates of each text."""

    def cut(batches: Iterable[pa.RecordBatch]):
        words = _Words()
        for batch in batches:
            lists = [np.unique(coordinates(t.as_py(), words, bits)) for t in batch.column(2)]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.concatenate(lists) if lists else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], ["order", "toxic", "at"])

    return rows.mapInArrow(cut, "order bigint, toxic int, at array<int>")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS, bits: int = BITS) -> Model:
    """Learn from ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text).

    At most ``sample`` labelled documents, chosen by a hash of their id, are learned from:
    their features are computed in parallel, the learning itself is one task over these.
    A null label or id is none; a document labelled twice is toxic if one label says so; of
    rows with one doc_id the smallest text counts.  Without labelled documents every score
    is 0.
    """
    spark = docs.sparkSession
    known = labels.where(labels["toxic"].isNotNull() & labels["doc_id"].isNotNull())
    known = known.groupBy(known["doc_id"].cast("bigint").alias("label_id")).agg(F.max(known["toxic"].cast("int")).alias("toxic"))
    key = F.xxhash64(F.lit("toxicity"), "label_id")
    chosen = measured(known.select("label_id", "toxic", key.alias("order")).orderBy("order", "label_id").limit(sample), sample)
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("label_id"), docs["text"].alias("text"))
    # at most ``sample`` rows of three numbers: texts of other documents are not shuffled
    rows = narrow.join(F.broadcast(chosen), "label_id").groupBy("order", "label_id", "toxic").agg(F.min("text").alias("text"))
    rows = written(_features(rows.select("order", "toxic", "text"), bits), "toxicity-features")
    size = 1 << bits

    def learn(batches: Iterable[pa.RecordBatch]):
        texts, marks = [], []
        for batch in batches:
            marks += batch.column(1).to_pylist()
            texts += [x.values.to_numpy() for x in batch.column(2)]
        model = Ftrl(size)
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(texts)):
                model.learn(texts[k], marks[k])
        w = model.weights(np.arange(size + 1))
        if not len(texts):
            w[size] = -np.inf
        used = np.append(np.flatnonzero(w[:size]), size)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used], pa.float64())], ["at", "weight"])

    # one task, over at most ``sample`` rows
    learned = rows.repartition(1).sortWithinPartitions("order").mapInArrow(learn, "at bigint, weight double").toArrow()
    pairs = sorted(zip(learned.column(0).to_pylist(), learned.column(1).to_pylist()))  # at most 2**bits
    if not pairs:  # no partition, no task
        return Model(bits, np.empty(0, np.int64), np.empty(0), -np.inf)
    at, weight = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    return Model(bits, at[:-1], weight[:-1], float(weight[-1]))


def scores(text: Column, model: Model, spark) -> Column:
    """Scores from 0 to 1; the model goes to the tasks once, at most 2**bits weights."""
    shared = spark.sparkContext.broadcast(model)
    held: dict = {}

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not held:
            held.update(weights=shared.value.dense(), words=_Words())
        bias = shared.value.bias
        if bias == -np.inf:
            return pa.array(np.zeros(len(texts)))
        return pa.array([score_of(t.as_py(), held["weights"], bias, held["words"]) for t in texts], pa.float64())

    return score(text)


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Sets ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on); rows and other columns stay.

    Only the text enters the score, whole; null and empty texts get the score of a
    text without any known word.
    """
    taken = ("score", "predicted")
    own = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in taken]
    out = docs.select(*own, scores(docs["text"], model, docs.sparkSession).alias("score"))
    return out.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))


def fold(doc_id: Column, folds: int = 4) -> Column:
    """The contract's fold of a document."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


@query("op13_toxicity")
def op13_toxicity(spark, sf):
    labels = table(spark, sf, "labels", "doc_id", "toxic")
    docs = table(spark, sf, "documents", "doc_id", "text")
    model = fit(docs, labels.where(fold(F.col("doc_id")) != 2))
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
