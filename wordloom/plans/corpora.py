"""Constrained and unconstrained corpus plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.curate import dedup_spans, featurize_docs, limited_vocab_spans
from wordloom.operators.pack import pack_sequences
from wordloom.operators.sample import quota_per_source, sample_spans_per_doc, split_tail


def constrained_corpus(
    docs: DataFrame, vocab: DataFrame, ages: DataFrame, ids: Sequence[str] = ("doc_id",), source: str = "source",
) -> DataFrame:
    """Spans within the vocabulary, distinct, with lexical features.

    One shuffle: the de-duplication of the surviving spans.
    """
    base = docs.select(*ids, source, "text")
    spans = dedup_spans(limited_vocab_spans(base, vocab, ids), "span", [*ids, "start"])
    return featurize_docs(spans, vocab, ages, [*ids, "start"], "span", source)


def unconstrained_corpus(
    docs: DataFrame, quotas: DataFrame, k: int, n_validation: int, n_test: int,
    ids: Sequence[str] = ("doc_id",), source: str = "source", seed: int | str = 0,
) -> DataFrame:
    """Sampled spans under per-source quotas, packed and split."""
    spans = sample_spans_per_doc(docs.select(*ids, source, "text"), k, ids, seed=seed)
    kept = quota_per_source(spans, quotas, [*ids, "start"], source, seed)
    packed = pack_sequences(kept.withColumnRenamed("span", "text"), [source], [*ids, "start"])
    return split_tail(packed, [source, "seq_no"], n_validation, n_test, seed)
