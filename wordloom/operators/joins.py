"""Joins of a large table to a lookup table whose keys may be very uneven."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.session import measured

SALTS = 32


def lookup_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "left", spread_by: Sequence[str] = (),
    max_rows: int = 100_000, salts: int = SALTS,
) -> DataFrame:
    """Join ``rows`` to ``table``, which is unique on ``keys``.

    A table of at most ``max_rows`` rows becomes a local relation, so Spark
    knows its size and broadcasts it if that is within its own bound.  A larger
    one is repeated once per salt, and a key's rows are spread over the salts by
    a hash of ``spread_by``: no task gets more than its share of a hot key.
    """
    small = measured(table, max_rows)
    if small is not table:
        return rows.join(small, list(keys), how)
    if not spread_by:
        return rows.join(table, list(keys), how)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")
