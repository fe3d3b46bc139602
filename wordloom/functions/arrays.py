"""Fixed-length array helpers for token ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def pad_array(ids: Column | str, length: int | Column, pad_id: int) -> Column:
    """Right-pad to ``length``; longer arrays are left alone."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    length = F.lit(length) if isinstance(length, int) else length
    missing = F.greatest(length - F.size(ids), F.lit(0))
    return F.concat(ids, F.array_repeat(F.lit(pad_id), missing))


def truncate_array(ids: Column | str, length: int) -> Column:
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.slice(ids, 1, length)


def fit_array(ids: Column | str, length: int, pad_id: int) -> Column:
    """Exactly ``length`` values: cut or right-padded."""
    return truncate_array(pad_array(ids, length, pad_id), length)


def attention_mask(ids: Column | str, length: int) -> Column:
    """1 for real positions, 0 for padding, over the first ``length``."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return fit_array(F.transform(ids, lambda _: F.lit(1)), length, 0)
