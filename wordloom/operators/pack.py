"""Greedy next-fit packing of short texts into sequences.

The fold is sequential within a shard.  To run it in parallel even if one shard
holds most rows, the rows are laid out in order over partitions and a partition
is summarised as a function: for every possible word count carried in, the
count carried out and the number of sequences closed.  A carried count below the
limit is one of about a hundred values, so that function is a short array.  The
summaries (one row per partition) are chained, and a second pass assigns
sequence numbers with every partition's true starting state.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from wordloom.functions import text as tx
from wordloom.operators.ordering import ordered_layout


def flush_limit(max_len: int = 128, ratio: float = 1.2) -> int:
    """Smallest word sum that no longer fits: (sum + 1) * ratio >= max_len."""
    n = max(math.floor(max_len / ratio) - 2, 0)
    while (n + 1) * ratio < max_len:
        n += 1
    return n


def _summaries(laid: DataFrame, limit: int) -> DataFrame:
    schema = (
        "part int, first_shard string, last_shard string, one boolean, "
        "ends array<int>, flushes array<bigint>, last_end int, last_flushes bigint"
    )

    def fold(batches):
        import numpy as np
        import pandas as pd

        ends = np.arange(limit + 1)
        flushes = np.zeros(limit + 1, dtype="int64")
        part = first = last = None
        state = closed = 0
        merged = None  # the one state left once all starting states have met, which takes a few rows
        extra = 0      # sequences closed since then
        for pdf in batches:
            for p, shard, n in zip(pdf["_part"], pdf["_shard"], pdf["n_words"]):
                if part is None:
                    part, first, last = p, shard, shard
                if shard != last:
                    last, state, closed = shard, 0, 0
                if shard == first and merged is not None:
                    full = merged > 0 and merged + n >= limit
                    extra += full
                    merged = min(n if full else merged + n, limit)
                elif shard == first:
                    full = (ends > 0) & (ends + n >= limit)
                    flushes += full
                    ends = np.minimum(np.where(full, n, ends + n), limit)
                    if (ends == ends[0]).all():
                        merged = int(ends[0])
                if state > 0 and state + n >= limit:
                    closed += 1
                    state = min(n, limit)
                else:
                    state = min(state + n, limit)
        if part is not None:
            if merged is not None:
                ends = np.full(limit + 1, merged)
                flushes += extra
            yield pd.DataFrame(
                {
                    "part": [part], "first_shard": [first], "last_shard": [last], "one": [first == last],
                    "ends": [ends.tolist()], "flushes": [flushes.tolist()],
                    "last_end": [state], "last_flushes": [closed],
                }
            )

    return laid.select("_part", "_shard", "n_words").mapInPandas(fold, schema)


def _chain(rows) -> dict[int, tuple[int, int]]:
    """Starting (state, sequences closed) of every partition's first shard."""
    starts = {}
    shard, state, closed = None, 0, 0
    for r in sorted(rows, key=lambda r: r["part"]):
        if r["first_shard"] != shard:
            state, closed = 0, 0
        starts[r["part"]] = (state, closed)
        if r["one"]:
            shard = r["first_shard"]
            state, closed = r["ends"][state], closed + r["flushes"][state]
        else:
            shard, state, closed = r["last_shard"], r["last_end"], r["last_flushes"]
    return starts


def pack_assign(
    df: DataFrame, shard: Sequence[str], order: Sequence[str], text: str = "text",
    max_len: int = 128, ratio: float = 1.2,
) -> DataFrame:
    """Adds ``n_words`` and ``seq_no`` (0-based within the shard)."""
    limit = flush_limit(max_len, ratio)
    named = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in shard]) if shard else F.lit("")
    # a NULL text is absent: it joins no sequence
    staged = df.where(F.col(text).isNotNull()).withColumn("_shard", named).withColumn("n_words", tx.count_words(text))
    laid = ordered_layout(staged, ["_shard", *order])
    starts = _chain(_summaries(laid, limit).collect())  # one row per partition
    schema = laid.withColumn("seq_no", F.lit(0).cast("bigint")).schema

    def assign(batches):
        """Reads part, shard and count of a row; all else stays in its Arrow buffers."""
        import pyarrow as pa

        last = None
        state = closed = 0
        for batch in batches:
            out = []
            for p, s, n in zip(*(batch.column(c).to_pylist() for c in ("_part", "_shard", "n_words"))):
                if s != last:
                    state, closed = starts[p] if last is None else (0, 0)
                    last = s
                if state > 0 and state + n >= limit:
                    closed += 1
                    state = n
                else:
                    state += n
                out.append(closed)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int64())], [*batch.schema.names, "seq_no"])

    return laid.mapInArrow(assign, schema).drop("_part", "_local", "_shard")


def pack_sequences(
    df: DataFrame, shard: Sequence[str], order: Sequence[str], text: str = "text", max_len: int = 128,
    ratio: float = 1.2, emit_last: bool = True, skip_empty: bool = True, max_sequences: int | None = None,
) -> DataFrame:
    """shard, seq_no, text, n_words: every text followed by one space.

    By default every text ends up in a sequence.  ``emit_last=False`` drops the
    unfinished last sequence of a shard; ``skip_empty=False`` adds the empty
    sequence that precedes a shard whose first text is too long on its own.
    NULL texts are absent.  ``max_sequences`` bounds the whole output, shards in order.
    """
    limit = flush_limit(max_len, ratio)
    rows = pack_assign(df, shard, order, text, max_len, ratio)
    item = F.struct(*order, F.col(text).alias("_text"))
    # a sequence holds fewer than `limit` words or a single text, so groups are small
    seqs = rows.groupBy(*shard, "seq_no").agg(
        F.sort_array(F.collect_list(item)).alias("_items"), F.sum("n_words").alias("n_words"),
        F.min_by("n_words", F.struct(*order)).alias("_first"),
    )
    seqs = seqs.select(
        *shard, "seq_no",
        F.concat(F.array_join(F.transform("_items", lambda x: x["_text"]), " "), F.lit(" ")).alias("text"),
        "n_words", "_first",
    )
    if not emit_last or not skip_empty:
        edges = seqs.groupBy(*shard).agg(F.max("seq_no").alias("_last"), F.min_by("_first", "seq_no").alias("_lead"))
        if not shard:
            edges = edges.select("_last", "_lead")
            seqs = seqs.withColumn("_last", edges.select("_last").scalar()).withColumn(
                "_lead", edges.select("_lead").scalar()
            )
        else:
            seqs = seqs.join(edges, list(shard))
        empty_lead = F.col("_lead") >= limit
        if not emit_last:
            lone = F.col("seq_no") < F.col("_last")
        else:
            lone = F.lit(True)
        if not skip_empty:
            shifted = seqs.withColumn("seq_no", F.when(empty_lead, F.col("seq_no") + 1).otherwise(F.col("seq_no")))
            empties = seqs.where(empty_lead & (F.col("seq_no") == 0)).withColumn("text", F.lit("")).withColumn(
                "n_words", F.lit(0).cast("bigint")
            )
            keep_last = F.lit(True) if emit_last else (
                F.col("seq_no") < F.col("_last") + F.when(empty_lead, 1).otherwise(0)
            )
            seqs = shifted.where(keep_last).unionByName(empties)
        else:
            seqs = seqs.where(lone)
    if max_sequences is not None:
        seqs = seqs.orderBy(*shard, "seq_no").limit(max_sequences)
    return seqs.select(*shard, "seq_no", "text", "n_words")
