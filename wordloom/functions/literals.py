"""Many literals counted in one pass over a text, by an automaton."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


@lru_cache(maxsize=4)
def _automaton(literals: tuple[str, ...]) -> ahocorasick.Automaton:
    """Built once per worker process."""
    out = ahocorasick.Automaton()
    for k, literal in enumerate(literals):
        out.add_word(literal, (k, len(literal)))
    out.make_automaton()
    return out


def _checked(literals: Sequence[str]) -> tuple[str, ...]:
    found = tuple(literals)
    if not all(found) or len(set(found)) < len(found):
        raise ValueError("literals must be different and not empty")
    return found


def literal_hits(text: str, literals: tuple[str, ...]) -> dict[int, int]:
    """Occurrences by number of the literal.  Those of one literal do not overlap, the leftmost
    ones count; those of different literals may."""
    hits: dict[int, int] = {}
    free: dict[int, int] = {}  # where a literal may begin again
    for end, (k, size) in _automaton(literals).iter(text) if literals else ():
        if end - size + 1 >= free.get(k, 0):
            free[k] = end + 1
            hits[k] = hits.get(k, 0) + 1
    return hits


def count_literals(c: Column | str, literals: Sequence[str]) -> Column:
    """map<string,bigint> of the literals that occur; NULL for a NULL text.

    Each count equals ``count_substring``, but the text is read once, however many literals
    there are.  Matching is case-sensitive and by substring.
    """
    known = _checked(literals)

    @F.arrow_udf("map<string,bigint>")
    def run(texts: pa.Array) -> pa.Array:
        rows = [None if t is None else [(known[k], n) for k, n in sorted(literal_hits(t, known).items())] for t in texts.to_pylist()]
        return pa.array(rows, pa.map_(pa.string(), pa.int64()))

    return run(F.col(c) if isinstance(c, str) else c)


def literal_totals(df: DataFrame, literals: Sequence[str], text: str = "text") -> DataFrame:
    """One row per literal: literal, n_occurrences, n_texts, zeros included.

    A task adds up its rows before anything is shuffled: at most one row per literal and task.
    """
    known = _checked(literals)

    def partial(batches):
        totals = np.zeros((2, len(known)), np.int64)
        for batch in batches:
            for t in batch.column(0):
                for k, n in literal_hits(t.as_py() or "", known).items():
                    totals[0, k] += n
                    totals[1, k] += 1
        at = np.flatnonzero(totals[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array([known[k] for k in at], pa.string()), pa.array(totals[0, at]), pa.array(totals[1, at])],
            ["literal", "n_occurrences", "n_texts"])

    found = df.select(text).mapInArrow(partial, "literal string, n_occurrences bigint, n_texts bigint")
    every = df.sparkSession.createDataFrame([(w, 0, 0) for w in known], "literal string, n_occurrences bigint, n_texts bigint")
    return found.unionByName(every).groupBy("literal").agg(F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_texts").alias("n_texts"))
