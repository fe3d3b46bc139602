"""A random order without a sort: each position is sent to its place by a keyed permutation.

A Feistel network permutes the numbers of an even count of bits; a number that falls
outside the range is sent on until it falls inside, which permutes the range itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 6
PRIME = 2**31 - 1


def round_keys(seed: int | str) -> list[tuple[int, int]]:
    """Factor and addend of each round, from the md5 of ``seed:round``."""
    found = [hashlib.md5(f"{seed}:{k}".encode()).digest() for k in range(ROUNDS)]
    return [(int.from_bytes(d[:4]) % (PRIME - 1) + 1, int.from_bytes(d[4:8]) % PRIME) for d in found]


def half_bits(n: int) -> int:
    """Bits of each half: both hold 0 to n - 1."""
    return max(1, ((n - 1).bit_length() + 1) // 2)


def permute(values: np.ndarray, n: int, seed: int | str) -> np.ndarray:
    """The places of ``values``, which lie in 0 to n - 1."""
    if n > 2**60:
        raise ValueError("at most 2^60 positions")
    half, keys, out = half_bits(n), round_keys(seed), values.astype(np.int64).copy()
    todo = np.arange(len(out))
    while len(todo):  # a range fills over a quarter of the numbers, so few go round often
        left, right = out[todo] >> half, out[todo] & ((1 << half) - 1)
        for factor, addend in keys:
            left, right = right, left ^ ((right * factor + addend) % PRIME & ((1 << half) - 1))
        out[todo] = left << half | right
        todo = todo[out[todo] >= n]
    return out


def permuted(position: Column | str, n: int, seed: int | str = 0) -> Column:
    """Place of a position among n; NULL for NULL and for positions outside 0 to n - 1."""

    @F.arrow_udf("bigint")
    def run(positions: pa.Array) -> pa.Array:
        values = positions.fill_null(-1).to_numpy(zero_copy_only=False)
        inside = (values >= 0) & (values < n)
        out = np.zeros(len(values), np.int64)
        out[inside] = permute(values[inside], n, seed)
        return pa.array(out, mask=~inside)

    c = F.col(position) if isinstance(position, str) else position
    return run(c.cast("bigint"))


def split_by_place(df: DataFrame, position: str, n: int, n_validation: int, n_test: int, seed: int | str = 0) -> DataFrame:
    """Adds ``place`` and ``split``: the last places are test, those before validation.

    ``position`` numbers the rows from 0 to n - 1.  Nothing is shuffled, and the result does
    not depend on partitions.  Rows without a position have neither place nor split.
    """
    out = df.withColumn("place", permuted(position, n, seed))
    split = F.when(F.col("place") >= n - n_test, "test").when(F.col("place") >= n - n_test - n_validation, "validation")
    return out.withColumn("split", split.when(F.col("place").isNotNull(), "train"))
