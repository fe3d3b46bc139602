"""Deterministic samples, quotas, splits and subsets.

Every choice is by ``hash_key(seed, ids)``: a uniform order that depends on
neither partitioning nor arrival.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions import text as tx
from wordloom.functions.keys import hash_key
from wordloom.operators.curate import SPAN_STRIDE, SPAN_WORDS
from wordloom.operators.ordering import cut_by_hash, global_position
from wordloom.session import measured

# --- fixed values: spans taken per source in the size-matched corpus -----------------
SOURCE_QUOTAS = {
    "CBT": 32_000,
    "WikipediaSimplified": 78_000,
    "Wikipedia": 837_960,
    "BookCorpus": 2_070_000,
    "C4": 7_480_000,
}
# --------------------------------------------------------------------------------------


def sample_n(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 0) -> DataFrame:
    """n rows without replacement (all if fewer)."""
    return cut_by_hash(df, ids, [n], seed, name="_part").where("_part = 0").drop("_part")


def global_limit(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 0) -> DataFrame:
    """Stop at a total of n rows, in hash order rather than arrival order."""
    return sample_n(df, n, ids, seed)


def spans_per_doc(limit_spans: int | None = None, limit_docs: int | None = None) -> int:
    """Spans to draw per document: 3, or enough to reach ``limit_spans``."""
    return 3 if not limit_docs else int(limit_spans / limit_docs) + 1


def sample_spans_per_doc(
    docs: DataFrame, k: int, ids: Sequence[str] = ("doc_id",), text: str = "text", seed: int | str = 0,
    length: int = SPAN_WORDS, stride: int = SPAN_STRIDE,
) -> DataFrame:
    """min(k, spans) random spans of every document, chosen inside its row.

    Only the chosen spans are built as text.  Adds ``start``, ``span``.
    """
    others = [c for c in docs.columns if c != text]
    staged = docs.select(*others, tx.space_words(text).alias("_words"))
    starts = F.sequence(F.lit(0), F.size("_words") - 1, F.lit(stride))
    keyed = F.transform(starts, lambda s: F.struct(hash_key(seed, *ids, s).alias("key"), s.alias("start")))
    picked = F.slice(F.sort_array(keyed), 1, k)
    rows = staged.select(*others, "_words", F.explode(picked).alias("_s"))
    return rows.select(
        *others, F.col("_s.start").alias("start"),
        F.array_join(F.slice("_words", F.col("_s.start") + 1, length), " ").alias("span"),
    )


def quota_per_source(
    df: DataFrame, quotas: DataFrame, ids: Sequence[str], source: str = "source", seed: int | str = 0,
) -> DataFrame:
    """At most ``quota`` rows per source, exactly.  Sources without a quota row
    are dropped.  A source holding most rows is spread over its hash buckets."""
    limits = measured(quotas.select(source, F.col("quota").cast("bigint").alias("_quota")))
    joined = df.join(limits, source)
    cut = cut_by_hash(joined, ids, [F.col("_quota")], seed, by=[source], name="_part")
    return cut.where("_part = 0").select(*df.columns)


def shuffle_rows(df: DataFrame, ids: Sequence[str], seed: int | str = 0, name: str = "position") -> DataFrame:
    """Adds a random 0-based position; writers order by it."""
    keyed = df.withColumn("_key", hash_key(seed, *ids))
    return global_position(keyed, ["_key", *ids], name).drop("_key")


def split_tail(
    df: DataFrame, ids: Sequence[str], n_validation: int, n_test: int, seed: int | str = 0,
) -> DataFrame:
    """Shuffle; the last ``n_test`` rows are test, the ones before validation."""
    cut = cut_by_hash(
        df, ids, [n_test, n_test + n_validation], seed, name="_part", descending=True
    )
    split = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "validation").otherwise("train")
    return cut.withColumn("split", split).drop("_part")


def split_fraction(
    df: DataFrame, ids: Sequence[str], held_out: float, test_share: float = 0.5, seed: int | str = 0,
) -> DataFrame:
    """Hold out a fraction (rounded up), then give a share of it to test."""
    import math

    n = df.count()
    n_held = math.ceil(n * held_out)
    n_test = math.ceil(n_held * test_share)
    return split_tail(df, ids, n_held - n_test, n_test, seed)


def debug_subset(df: DataFrame, n: int, ids: Sequence[str], seed: int | str = 0) -> DataFrame:
    """A small sample that serves as train, validation and test alike."""
    splits = F.array(*[F.lit(s) for s in ("train", "validation", "test")])
    base = df.drop("split") if "split" in df.columns else df
    return sample_n(base, n, ids, seed).withColumn("split", F.explode(splits))


def head_rows(df: DataFrame, n: int, order: Sequence[str | Column], by: Sequence[str] = ()) -> DataFrame:
    """First n rows in a stable order, per ``by`` group if given."""
    if not by:
        return df.orderBy(*order).limit(n)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def select_split(df: DataFrame, name: str, fallbacks: Sequence[str] = ()) -> DataFrame:
    """Rows of one split, or of the first fallback that exists.

    Checks the split names only (a partition column when read from disk).
    """
    for candidate in (name, *fallbacks):
        if not df.where(F.col("split") == candidate).limit(1).isEmpty():
            return df.where(F.col("split") == candidate)
    return df.where(F.col("split") == name)


def dev_split_by_ids(df: DataFrame, dev_ids: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Listed keys become dev, the rest train; one join, both parts."""
    marks = dev_ids.select(*keys).distinct().withColumn("_dev", F.lit(True))
    out = df.join(marks, list(keys), "left")
    split = F.when(F.col("_dev").isNotNull(), "dev").otherwise("train")
    return out.select(*df.columns, split.alias("split"))


def batch_index(df: DataFrame, order: Sequence[str | Column], size: int) -> DataFrame:
    """Consecutive batches of ``size`` rows in the given total order."""
    out = global_position(df, order, "_pos")
    return out.withColumn("batch_no", F.floor(F.col("_pos") / size).cast("bigint")).drop("_pos")
