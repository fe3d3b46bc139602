"""Transcript and book statistics.

Sentence and trigger counts of a joined text equal the sums over its
utterances, since the joining mark is itself a separator.  So nothing is
concatenated to be counted: each statistic is a map-side combined sum.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wordloom.functions import text as tx
from wordloom.operators.ordering import global_running_sum, running_by_group

# --- fixed values: trigger words by group -------------------------------------------
TRIGGERS = {
    "noun_initiator": ("just", "both", "only", "all"),
    "post_modifier": ("who",),
    "to_be": ("to be",),
    "that": ("that",),
}
POST_MODIFIERS = ("who", "when", "while")
VOWEL_GROUP = "[aeiouy]+"
# --------------------------------------------------------------------------------------


def filter_role(df: DataFrame, role: str, column: str = "speaker_role") -> DataFrame:
    return df.where(F.col(column) == role)


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name))


def concat_text(
    df: DataFrame, by: Sequence[str], order: Sequence[str], sep: str = " ", text: str = "gloss", rows_per_part: int | None = None,
) -> DataFrame:
    """Ordered concatenation per group: one row (part_no 0).

    A group is put together from blocks of rows, so that no task gathers all rows
    of a very large one.  ``rows_per_part`` cuts groups into numbered parts of so
    many rows instead; joining the parts with ``sep`` gives the whole.
    """
    placed = running_by_group(df.select(*by, *order, text), by, order, {}, position="_pos")
    block = F.floor(F.col("_pos") / (rows_per_part or 10_000)).cast("bigint")
    items = placed.withColumn("part_no", block).groupBy(*by, "part_no").agg(
        F.sort_array(F.collect_list(F.struct("_pos", F.col(text).alias("_t")))).alias("_i")
    )
    parts = items.select(*by, "part_no", F.array_join(F.transform("_i", lambda x: x["_t"]), sep).alias(text))
    if rows_per_part:
        return parts
    whole = parts.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("part_no", text))).alias("_i"))
    return whole.select(*by, F.lit(0).cast("bigint").alias("part_no"), F.array_join(F.transform("_i", lambda x: x[text]), sep).alias(text))


def cumulative_words(df: DataFrame, age: str = "target_child_age", text: str = "gloss") -> DataFrame:
    """Words per age and their running total by age."""
    per_age = df.groupBy(age).agg(F.sum(tx.count_words(text)).cast("bigint").alias("n_words"))
    return global_running_sum(per_age, [age], {"cum_words": F.col("n_words")})


def _sentence_sum(text: str, size_of) -> Column:
    lengths = F.transform(tx.dot_sentences(text), lambda s: size_of(F.split(s, " ")))
    return F.aggregate(lengths, F.lit(0), lambda a, x: a + x)


def _mean_per_sentence(df: DataFrame, by: str, text: str, size_of, name: str) -> DataFrame:
    total = F.sum(_sentence_sum(text, size_of))
    return df.groupBy(by).agg((total / F.sum(F.size(tx.dot_sentences(text)))).alias(name))


def mean_sentence_length(df: DataFrame, by: str = "target_child_age", text: str = "gloss") -> DataFrame:
    return _mean_per_sentence(df, by, text, F.size, "mean_length")


def mean_unique_sentence_length(df: DataFrame, by: str = "target_child_age", text: str = "gloss") -> DataFrame:
    return _mean_per_sentence(df, by, text, lambda ws: F.size(F.array_distinct(ws)), "mean_unique_length")


def trigger_rate(
    df: DataFrame, by: str = "target_child_age", text: str = "gloss",
    groups: Mapping[str, Sequence[str]] = TRIGGERS, extra: Sequence[str] = POST_MODIFIERS,
) -> DataFrame:
    """Per age: literal counts of every trigger, sentence count, and each
    group's rate per sentence.  Matching is by substring and case-sensitive."""
    words = list(dict.fromkeys([w for ws in groups.values() for w in ws] + list(extra)))
    name = lambda w: "n_" + w.replace(" ", "_")
    sums = [F.sum(tx.count_substring(text, w)).alias(name(w)) for w in words]
    counts = df.groupBy(by).agg(*sums, F.sum(F.size(tx.dot_sentences(text))).alias("n_sentences"))
    rates = [
        (sum(F.col(name(w)) for w in ws) / F.col("n_sentences")).alias(g + "_rate") for g, ws in groups.items()
    ]
    return counts.select("*", *rates)


def book_readability(df: DataFrame, ids: Sequence[str], text: str = "text") -> DataFrame:
    """Counts and a Flesch-style reading ease per book (English, approximate)."""
    words = F.regexp_count(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"))
    sentences = F.greatest(F.regexp_count(F.col(text), F.lit(r"[.!?]+")), F.lit(1))
    vowels = F.regexp_count(F.lower(text), F.lit(VOWEL_GROUP))
    counted = df.select(
        *ids, F.length(text).cast("bigint").alias("n_chars"), words.cast("bigint").alias("n_words"),
        sentences.cast("bigint").alias("n_sentences"), vowels.cast("bigint").alias("n_syllables"),
    )
    ease = (
        206.835 - 1.015 * F.col("n_words") / F.col("n_sentences")
        - 84.6 * F.try_divide(F.col("n_syllables"), F.col("n_words"))
    )
    return counted.withColumn("reading_ease", ease)
