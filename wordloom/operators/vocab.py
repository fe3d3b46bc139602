"""Vocabularies: word tables, lookups, ranks, ages and growth curves.

A vocabulary is a DataFrame with a ``word`` column.  Joins carry no broadcast
hints: Spark broadcasts a vocabulary when its own size check allows it and
otherwise shuffles, with adaptive skew handling for very common words.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wordloom.functions import text as tx
from wordloom.operators.ordering import global_position, global_running_sum

# Vocabularies up to this many words may be placed inside an expression, which
# makes the lookup row-local; larger ones are joined.
INLINE_WORDS = 20_000
SET_WORDS, SET_BYTES = 4_000_000, 128_000_000  # a word list up to this size is sent whole to the Python workers


def bounded_words(vocab: DataFrame, limit: int = INLINE_WORDS, word: str = "word") -> list[str] | None:
    """The distinct words if there are at most ``limit``, else None.

    Reads at most ``limit + 1`` rows to the driver.
    """
    if limit <= 0:
        return None
    rows = vocab.select(word).where(F.col(word).isNotNull()).distinct().limit(limit + 1).collect()
    return None if len(rows) > limit else sorted(r[0] for r in rows)


def word_set(vocab: DataFrame, word: str = "word") -> frozenset[str] | None:
    """The distinct words if they are at most SET_WORDS and SET_BYTES, else None."""
    if SET_WORDS <= 0:
        return None
    rows = vocab.select(word).where(F.col(word).isNotNull()).distinct().limit(SET_WORDS + 1).toArrow()
    return None if rows.num_rows > SET_WORDS or rows.nbytes > SET_BYTES else frozenset(rows.column(0).to_pylist())


def sql_in(variable: str, words: Sequence[str]) -> str:
    """SQL membership test of a lambda variable in a literal set."""
    if not words:
        return "false"
    quoted = ",".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)
    return f"{variable} IN ({quoted})"


# --- counting -------------------------------------------------------------------
def explode_words(df: DataFrame, tokens: Column, keep: Sequence[str] = (), word: str = "word") -> DataFrame:
    return df.select(*keep, F.explode(tokens).alias(word))


def word_frequency(df: DataFrame, tokens: Column | None = None, text: str = "text") -> DataFrame:
    """word, frequency; map-side combined, so common words do not skew."""
    tokens = tx.word_tokens(text) if tokens is None else tokens
    return explode_words(df, tokens).groupBy("word").agg(F.count(F.lit(1)).alias("frequency"))


def top_vocabulary(freq: DataFrame, k: int) -> DataFrame:
    """The k commonest words, ties by word (a per-task top-k, then one merge)."""
    return freq.orderBy(F.desc("frequency"), "word").limit(k)


def doc_term_counts(
    df: DataFrame, ids: Sequence[str], text: str = "text", binary: bool = False,
    english_vocab: DataFrame | None = None,
) -> DataFrame:
    """Long doc-term rows: one row per document and term.

    Terms are counted inside the document's row, so nothing is shuffled.
    """
    tokens = tx.word_tokens(text)
    if binary:
        rows = explode_words(df, F.array_distinct(tokens), ids, "term").withColumn("cnt", F.lit(1).cast("bigint"))
    else:
        rows = df.select(*ids, F.inline(tx.term_counts(tokens)))
    if english_vocab is not None:
        rows = rows.join(english_vocab.select(F.col("word").alias("term")).distinct(), "term", "left_semi")
        rows = rows.select(*ids, "term", "cnt")
    return rows


def dictionary_counts(df: DataFrame, tokens: Column, dictionary: DataFrame) -> DataFrame:
    """word, accepted, frequency; accepted = in the dictionary or by its ending."""
    freq = word_frequency(df, tokens)
    flagged = vocab_membership(freq, dictionary)
    return flagged.select("word", (F.col("in_vocab") | tx.has_word_suffix("word")).alias("accepted"), "frequency")


def rare_words(freq: DataFrame, below: int = 5) -> DataFrame:
    return freq.where(F.col("frequency") < below)


def lookup_word(freq: DataFrame, word: str) -> DataFrame:
    return freq.where(F.col("word") == word)


def words_with_prefix(freq: DataFrame, prefix: str) -> DataFrame:
    return freq.where(F.col("word").startswith(prefix))


def merge_counts(per_document: DataFrame) -> DataFrame:
    """Per-document counts (word, cnt) summed over documents."""
    return per_document.groupBy("word").agg(F.sum("cnt").alias("frequency"))


def distinct_words_per_document(df: DataFrame, tokens: Column, ids: Sequence[str]) -> DataFrame:
    """Row-local: the distinct count needs no shuffle."""
    return df.select(*ids, F.size(F.array_distinct(tokens)).cast("bigint").alias("n_distinct"))


# --- set lookups ----------------------------------------------------------------
def vocab_membership(words: DataFrame, vocab: DataFrame, word: str = "word") -> DataFrame:
    """Left lookup: every input row plus ``in_vocab``."""
    marks = vocab.select(F.col("word").alias(word)).distinct().withColumn("_hit", F.lit(True))
    out = words.join(marks, word, "left").withColumn("in_vocab", F.col("_hit").isNotNull())
    return out.select(*words.columns, "in_vocab")


def vocab_oov(words: DataFrame, vocab: DataFrame) -> DataFrame:
    return words.join(vocab.select("word"), "word", "left_anti")


def vocab_overlap(words: DataFrame, vocab: DataFrame) -> DataFrame:
    return words.join(vocab.select("word"), "word", "left_semi")


def vocab_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("word").intersect(b.select("word"))


def vocab_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("word").subtract(b.select("word"))


def vocab_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("word").union(b.select("word")).distinct()


def percent_missing(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """100 * round(missing / total, 4) over distinct words."""
    flagged = vocab_membership(words.select("word").distinct(), vocab)
    missing = F.count_if(~F.col("in_vocab"))
    total = F.count(F.lit(1))
    return flagged.agg(
        missing.alias("n_missing"),
        total.alias("n_words"),
        (100 * F.round(F.try_divide(missing, total), 4)).alias("pct_missing"),
    )


# --- ranks and cumulative shares --------------------------------------------------
def word_rank(freq: DataFrame) -> DataFrame:
    """Adds the 0-based rank by frequency (descending, then word)."""
    return global_position(freq, [F.desc("frequency"), F.asc("word")], "word_rank")


def cumulative_frequency_pct(freq: DataFrame) -> DataFrame:
    """Adds rank, running frequency and its share of the total."""
    ranked = global_running_sum(
        freq, [F.desc("frequency"), F.asc("word")],
        {"frequency_cum": F.col("frequency")}, position="word_rank",
    )
    total = freq.agg(F.sum("frequency")).scalar()
    return ranked.withColumn("frequency_cum_pct", F.col("frequency_cum") / total)


def word_rank_lookup(words: DataFrame, ranked: DataFrame) -> DataFrame:
    """Adds ``word_rank`` (NULL when missing) and ``word_rank_ref`` (0 when
    missing, which collides with the commonest word)."""
    out = words.join(ranked.select("word", "word_rank"), "word", "left")
    return out.withColumn("word_rank_ref", F.coalesce("word_rank", F.lit(0)))


def rank_between(ranked: DataFrame, low: int, high: int, below_pct: float = 0.99) -> DataFrame:
    return ranked.where(F.col("word_rank").between(low, high) & (F.col("frequency_cum_pct") < below_pct))


# --- ages ---------------------------------------------------------------------------
def vocab_by_age_bin(ages: DataFrame) -> DataFrame:
    """Distinct words per age bin."""
    binned = ages.select(tx.age_bin("age").alias("age_bin"), "word").where("age_bin IS NOT NULL")
    return binned.groupBy("age_bin").agg(F.count_distinct("word").alias("n_words"))


def age_bin_words(ages: DataFrame) -> DataFrame:
    """Bin-to-word table (two columns, any size)."""
    return ages.select(tx.age_bin("age").alias("age_bin"), "word").where("age_bin IS NOT NULL").distinct()


def earliest_bin(ages: DataFrame) -> DataFrame:
    """word, bin: the earliest bin of each word."""
    return (
        ages.select("word", tx.age_bin("age").alias("bin")).where("bin IS NOT NULL")
        .groupBy("word").agg(F.min("bin").alias("bin"))
    )


def age_lookup(words: DataFrame, ages: DataFrame) -> DataFrame:
    """Adds ``age_bin``; a word with no bin counts as 1."""
    out = words.join(earliest_bin(ages), "word", "left")
    return out.select(*words.columns, F.coalesce("bin", F.lit(1)).alias("age_bin"))


def words_by_age(ages: DataFrame) -> DataFrame:
    """Rows per exact age."""
    return ages.groupBy("age").agg(F.count(F.lit(1)).alias("n_words"))


def cumulative_vocab(ages: DataFrame) -> DataFrame:
    """Running vocabulary size by age."""
    return global_running_sum(words_by_age(ages), ["age"], {"cum_count": F.col("n_words")})


def age_windows(ranked_ages: DataFrame, step: int = 144) -> DataFrame:
    """Ranked vocabulary between every ``step``-th distinct age.

    Input: word, age, word_rank (NULL = unranked).  The boundary table has one
    row per ``step`` distinct ages.  Both ends are included, so a boundary age is in two
    windows.  Each row finds its windows by equality: an age's index gives its
    window number, and boundary ages are listed a second time.
    """
    order = global_position(ranked_ages.select("age").distinct(), ["age"], "age_idx")
    bounds = order.where(F.col("age_idx") % step == 0).select(
        (F.col("age_idx") / step).cast("bigint").alias("window_no"), F.col("age").alias("age_to")
    )
    starts = bounds.select((F.col("window_no") + 1).alias("window_no"), F.col("age_to").alias("age_from"))
    bounds = bounds.join(starts, "window_no", "left").withColumn("age_from", F.coalesce("age_from", F.lit(0.0)))
    last = F.ceil(F.col("age_idx") / step).cast("bigint")
    numbers = F.when(F.col("age_idx") % step == 0, F.array(last, last + 1)).otherwise(F.array(last))
    placed = order.select("age", F.explode(numbers).alias("window_no"))
    rows = ranked_ages.where("word_rank IS NOT NULL").join(placed, "age")
    return rows.join(bounds, "window_no").select("window_no", "age_from", "age_to", "word", "age", "word_rank")


def vocab_chunks(ranked_ages: DataFrame, size: int = 1419, chunks: int = 8) -> DataFrame:
    """Consecutive slices by (age, word): ranked words and last age of each."""
    rows = global_position(ranked_ages, ["age", "word"], "_pos")
    rows = rows.withColumn("chunk_no", F.floor(F.col("_pos") / size).cast("bigint")).where(
        (F.col("chunk_no") < chunks) & F.col("word_rank").isNotNull()
    )
    return rows.groupBy("chunk_no").agg(
        F.count(F.lit(1)).alias("n_ranked"), F.max_by("age", "_pos").alias("last_age")
    )


def acquired_vocab_curve(
    utterances: DataFrame, order: Sequence[str], tokens: Column, dictionary: DataFrame,
) -> DataFrame:
    """Size of the dictionary vocabulary met so far, after every utterance.

    First sightings are found with a ``min`` per word; the running total is a
    distributed prefix sum over the ordered utterances.
    """
    where = F.struct(*order)
    words = utterances.select(where.alias("_at"), F.explode(F.array_distinct(tokens)).alias("word"))
    first = words.groupBy("word").agg(F.min("_at").alias("_at"))
    first = vocab_overlap(first, dictionary)
    new = first.groupBy("_at").agg(F.count(F.lit(1)).alias("n_new"))
    rows = utterances.select(*order, where.alias("_at")).join(new, "_at", "left").select(
        *order, F.coalesce("n_new", F.lit(0)).alias("n_new")
    )
    return global_running_sum(rows, list(order), {"vocab_size": F.col("n_new")})


def kl_divergence(p: DataFrame, q: DataFrame) -> DataFrame:
    """Sum of p * ln(p / q) over two weight tables (key, w), each scaled to 1.

    With totals P and Q this equals sum(wp * ln(wp / wq)) / P - ln(P / Q), so one
    pass over the aligned keys is enough.  A key with weight in p and none in q
    makes the sum infinite.
    """
    both = p.select("key", F.col("w").alias("p")).join(q.select("key", F.col("w").alias("q")), "key", "full_outer")
    wp, wq = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    term = (
        F.when(wp == 0, F.lit(0.0))
        .when(wq == 0, F.lit(float("inf")))
        .otherwise(wp * (F.ln(F.when(wp > 0, wp)) - F.ln(F.when(wq > 0, wq))))
    )
    total_p, total_q = F.sum(wp), F.sum(wq)
    return both.agg((F.sum(term) / total_p - F.ln(total_p) + F.ln(total_q)).alias("kl"))
