"""Hash keys for sampling, shuffling, splitting and masking.

A key depends on the seed and the row's id only, so results do not change with
partitioning, retries or row order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

KEY_BITS = 60


def hash_key(seed: int | str, *ids: Column | str) -> Column:
    """60-bit integer from the md5 of ``seed:id[:id…]``."""
    cols = [F.col(c) if isinstance(c, str) else c for c in ids]
    text = F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols])
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
    # never NULL; saying so spares an inferred not-null filter that would hash again
    return F.coalesce(key, F.lit(0).cast("bigint"))


def hash_bucket(key: Column, bits: int) -> Column:
    """Leading ``bits`` of a hash key: ordered, evenly filled buckets."""
    return F.shiftright(key, KEY_BITS - bits)
