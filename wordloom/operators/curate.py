"""Spans, the limited-vocabulary filter, duplicates and lexical features."""

from __future__ import annotations

from collections.abc import Sequence
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wordloom.functions import text as tx
from wordloom.operators.joins import lookup_join
from wordloom.operators.vocab import INLINE_WORDS, bounded_words, earliest_bin, sql_in, word_set

SPAN_WORDS = 110
SPAN_STRIDE = 30
MIN_TOKENS = 40
OOV_UNIT = 2**40  # one out-of-vocabulary token, in the packed per-word counts
WORD_END = "\v"  # holds the place of a space while a text is normalised
FULL = 2**60  # where packed counts stop: far beyond one violation, far below an overflow


# --- row generators ---------------------------------------------------------------
def to_spans(
    df: DataFrame, text: str = "text", length: int = SPAN_WORDS, stride: int = SPAN_STRIDE,
) -> DataFrame:
    """Sliding windows of ``length`` space-separated words every ``stride``.

    Adds ``start`` (0-based word position) and ``span``; drops the text column.
    """
    words = tx.space_words(text)
    others = [c for c in df.columns if c != text]
    cut = df.select(*others, words.alias("_words")).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("_words") - 1, F.lit(stride))).alias("start")
    )
    return cut.select(*others, "start", F.array_join(F.slice("_words", F.col("start") + 1, length), " ").alias("span"))


def explode_parts(df: DataFrame, parts: Column, text: str = "text", part: str = "part") -> DataFrame:
    """One row per part with its 0-based number; drops the text column."""
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(parts).alias("part_no", part))


def to_paragraphs(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_parts(df, tx.paragraphs(text), text)


def to_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_parts(df, tx.rule_sentences(text), text)


def to_dot_sentences(df: DataFrame, text: str = "text") -> DataFrame:
    return explode_parts(df, tx.dot_sentences(text), text)


def chunk_by_chars(
    df: DataFrame, text: str = "text", min_doc: int = 50, whole: int = 110, grow: int = 100,
    min_tail: int = 30, drop_boundary_word: bool = False,
) -> DataFrame:
    """Word-aligned chunks just over ``grow`` characters.

    Texts under ``min_doc`` are skipped, up to ``whole`` kept as they are.  With
    ``drop_boundary_word`` the word that closes a chunk is lost.
    """

    @F.pandas_udf("array<string>")
    def cut(texts):
        import pandas as pd

        def one(t):
            if t is None or len(t) < min_doc:
                return []
            if len(t) <= whole:
                return [t]
            chunks, words, size = [], [], 0
            for w in t.split(" "):
                if size > grow:
                    chunks.append(" ".join(words) + " ")
                    words, size = ([], 0) if drop_boundary_word else ([w], len(w) + 1)
                else:
                    words.append(w)
                    size += len(w) + 1
            if words and size >= min_tail:
                chunks.append(" ".join(words) + " ")
            return chunks

        return pd.Series([one(t) for t in texts])

    return explode_parts(df, cut(F.col(text)), text, "chunk")


# --- vocabulary hits ----------------------------------------------------------------
def _word_marks(vocab: DataFrame, english_vocab: DataFrame | None) -> DataFrame:
    """_w, _hit of the words that have a say: the vocabulary (all hits), or the
    reference list with its vocabulary words as hits."""
    hits = vocab.select(F.col("word").alias("_w")).distinct().withColumn("_hit", F.lit(True))
    if english_vocab is None:
        return hits
    listed = english_vocab.select(F.col("word").alias("_w")).distinct()
    return listed.join(hits, "_w", "left").select("_w", F.coalesce("_hit", F.lit(False)).alias("_hit"))


def _inline(words: frozenset[str] | None, inline: int) -> list[str] | None:
    """The words as a list if they are few enough for an SQL expression."""
    return None if words is None or not 0 < inline >= len(words) else sorted(words)


def _ends(column: pa.ListArray) -> np.ndarray:
    """Where each list begins, and the last ends, in the flattened column."""
    return np.append(0, np.cumsum(pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64))


def _with_tokens(df: DataFrame, tokens: Column) -> DataFrame:
    """Adds ``_toks`` by a generator: Spark does not put the expression into a Python function's
    arguments, where lambda functions can keep it from being recognised."""
    return df.select("*", F.explode(F.array(tokens)).alias("_toks"))


class _WordTest:
    """Codes of tokens: 1 in the vocabulary, 2 outside, 0 not listed (no say), 3 WORD_END.  Runs in
    Arrow batches: the word lists are broadcast once, no token is shuffled."""

    def __init__(self, spark: SparkSession, words: frozenset[str], listed: frozenset[str] | None = None):
        self.sets = spark.sparkContext.broadcast((words if listed is None else words & listed, listed))

    def codes(self, column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all rows' tokens in one array, and where each row begins (and the last ends)."""
        words, listed = self.sets.value
        found, ends = column.flatten().dictionary_encode(), _ends(column)
        code = [3 if w == WORD_END else 1 if w in words else 2 if listed is None or w in listed else 0 for w in found.dictionary.to_pylist()]
        at = found.indices.fill_null(-1).to_numpy()  # a NULL element takes the code added last
        return np.array([*code, 0], np.int8)[at], ends

    def counts(self, tokens: Column) -> Column:
        """struct of n_tokens and n_in_vocab."""

        def run(column: pa.Array) -> pa.Array:
            codes, ends = self.codes(column)
            sums = [np.append(0, np.cumsum(hit, dtype=np.int64))[ends] for hit in (codes > 0, codes == 1)]
            return pa.StructArray.from_arrays([pa.array(np.diff(s)) for s in sums], ["n_tokens", "n_in_vocab"])

        return F.arrow_udf(run, "struct<n_tokens:bigint,n_in_vocab:bigint>").asNondeterministic()(tokens)  # never computed twice

    def hits(self, tokens: Column) -> Column:
        """Array of booleans: the token is in the vocabulary."""

        def run(column: pa.Array) -> pa.Array:
            codes, ends = self.codes(column)
            return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes == 1))

        return F.arrow_udf(run, "array<boolean>").asNondeterministic()(tokens)

    def blocks(self, marked: Column, g: int) -> Column:
        """For tokens with WORD_END between the words: the number that count in each block of g
        words, or OOV_UNIT where one is outside."""

        def run(column: pa.Array) -> pa.Array:
            codes, ends = self.codes(column)
            before = np.append(0, np.cumsum(codes == 3))
            sizes = (before[ends[1:]] - before[ends[:-1]]) // g + 1  # blocks of a row
            first = np.append(0, np.cumsum(sizes))
            word = before[:-1] - np.repeat(before[ends[:-1]], np.diff(ends))
            block = np.repeat(first[:-1], np.diff(ends)) + word // g
            count, out = (np.bincount(block[codes == k], minlength=first[-1]) for k in (1, 2))
            return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.where(out > 0, OOV_UNIT, count), pa.int64()))

        return F.arrow_udf(run, "array<bigint>").asNondeterministic()(marked)


def vocab_hits(
    df: DataFrame, ids: Sequence[str], tokens: Column, vocab: DataFrame, inline: int = INLINE_WORDS,
    keep: str = "true", english_vocab: DataFrame | None = None,
) -> DataFrame:
    """Adds ``n_tokens`` and ``n_in_vocab`` per row; keeps the rows for which
    ``keep``, an SQL condition on ``r.n_tokens`` and ``r.n_in_vocab``, holds.
    With ``english_vocab`` tokens outside that list are ignored.

    A vocabulary within the inline bound is tested inside the row: no shuffle.
    There the condition is part of a generator: as a filter on the computed
    columns it would be pushed below them and compute the tokens again.
    A larger vocabulary is broadcast and tested in Arrow batches (``word_set`` says
    how large), also without a shuffle.  One beyond that is joined to the exploded tokens, by ids and
    a hash of the tokens, so repeated ids change nothing.  A NULL text has no tokens.
    """
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    word_list, listed = word_set(vocab), word_set(english_vocab) if english_vocab is not None else frozenset()
    words, english = _inline(word_list, inline), _inline(listed, inline) if english_vocab is not None else []
    if words is not None and english is not None:
        if english_vocab is not None:
            df = df.withColumn("_toks", tokens)
            tokens = F.expr(f"filter(_toks, w -> {sql_in('w', english)})")
        counts = (
            "named_struct('n_tokens', cast(size(_toks) as bigint), "
            f"'n_in_vocab', cast(size(filter(_toks, w -> {sql_in('w', words)})) as bigint))"
        )
        rows = F.expr(f"inline(filter(array({counts}), r -> {keep}))")
        others = [c for c in df.columns if c != "_toks"]
        return df.withColumn("_toks", tokens).select(*others, rows)
    if word_list is not None and listed is not None:
        test = _WordTest(df.sparkSession, word_list, listed if english_vocab is not None else None)
        staged = _with_tokens(df, tokens).withColumn("_counts", test.counts(F.col("_toks")))
        return staged.select(*df.columns, F.expr(f"inline(filter(array(_counts), r -> {keep}))"))
    keys = [*ids, "_row"]
    staged = df.withColumn("_row", F.xxhash64(tokens))
    rows = staged.select(*keys, F.posexplode_outer(tokens).alias("_pos", "_w"))
    rows = lookup_join(rows, _word_marks(vocab, english_vocab), ["_w"], "left", keys)
    counted = F.col("_w").isNotNull() if english_vocab is None else F.col("_hit").isNotNull()
    counts = rows.groupBy(*keys).agg(_per_copy(F.count_if(counted)).alias("n_tokens"), _per_copy(F.count_if(F.col("_hit"))).alias("n_in_vocab"))
    kept = counts.alias("r").where(keep).select("r.*")
    return staged.join(kept, keys).drop("_row")


def _per_copy(total: Column) -> Column:
    """A total over rows exploded with ``_pos``, for one of the equal source rows."""
    return (total / F.count_if(F.coalesce(F.col("_pos"), F.lit(0)) == 0)).cast("bigint")


def restrict_to_english_vocab(
    df: DataFrame, ids: Sequence[str], tokens: Column, english_vocab: DataFrame, inline: int = INLINE_WORDS,
) -> DataFrame:
    """Adds ``tokens``: only those listed in a reference word list, order kept."""
    tokens = F.coalesce(tokens, F.array().cast("array<string>"))
    listed = word_set(english_vocab)
    words = _inline(listed, inline)
    if words is not None:
        return df.withColumn("_toks", tokens).withColumn(
            "tokens", F.expr(f"filter(_toks, w -> {sql_in('w', words)})")
        ).drop("_toks")
    if listed is not None:
        staged = _with_tokens(df, tokens).withColumn("_hits", _WordTest(df.sparkSession, listed).hits(F.col("_toks")))
        return staged.withColumn("tokens", F.expr("filter(_toks, (w, i) -> _hits[i])")).drop("_toks", "_hits")
    keep = english_vocab.select(F.col("word").alias("_w")).distinct()
    keys = [*ids, "_row"]  # equal rows have equal tokens: a set of places counts each once
    staged = df.withColumn("_row", F.xxhash64(tokens))
    rows = lookup_join(staged.select(*keys, F.posexplode(tokens).alias("_pos", "_w")), keep, ["_w"], "left_semi", keys)
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("_pos", "_w"))).alias("_l"))
    out = staged.join(lists, keys, "left")
    kept = F.transform("_l", lambda x: x["_w"])
    return out.withColumn("tokens", F.coalesce(kept, F.array().cast("array<string>"))).drop("_l", "_row")


def filter_limited_vocab(
    spans: DataFrame, ids: Sequence[str], vocab: DataFrame, text: str = "span",
    min_tokens: int = MIN_TOKENS, english_vocab: DataFrame | None = None, inline: int = INLINE_WORDS,
) -> DataFrame:
    """Spans with no token outside the vocabulary and more than ``min_tokens``.

    Numbers and links pass only if ``number`` / ``hlink`` are in the vocabulary.
    Adds ``n_tokens``.
    """
    tokens = tx.word_tokens(tx.preprocess_text(F.lower(text)))
    keep = f"r.n_in_vocab = r.n_tokens AND r.n_tokens > {min_tokens}"
    return vocab_hits(spans, ids, tokens, vocab, inline, keep, english_vocab).drop("n_in_vocab")


def _prepared_text_sql(text: str) -> str:
    """SQL for the normalised words, one per space-separated word, with WORD_END between them.

    No normalisation pattern reaches over a space, so the words are normalised
    in one pass over the text with the spaces held by another white-space mark.
    """
    out = f"replace(replace(lower({text}), '\\u000B', '\\t'), ' ', '\\u000B')"
    out = f"replace({out}, '-', ' ')"
    out = f"regexp_replace({out}, r'{tx.NUMBER_JOINERS}', '{tx.NUMBER_MARK}')"
    out = f"regexp_replace({out}, r'{tx.LEADING_DIGITS}', '$1{tx.NUMBER_MARK} ')"
    out = f"regexp_replace({out}, r'{tx.LINK_PATTERN}', '{tx.LINK_MARK}')"
    return f"lower({out})"


def _prepared_words_sql(text: str) -> str:
    """SQL for the array of normalised words."""
    return f"split({_prepared_text_sql(text)}, '\\u000B')"


def limited_vocab_spans(
    docs: DataFrame, vocab: DataFrame, ids: Sequence[str], text: str = "text",
    length: int = SPAN_WORDS, stride: int = SPAN_STRIDE, min_tokens: int = MIN_TOKENS,
    inline: int = INLINE_WORDS, english_vocab: DataFrame | None = None,
) -> DataFrame:
    """``to_spans`` then ``filter_limited_vocab``, in one pass per document.

    Overlapping windows repeat a word length/stride times.  Token and violation
    counts add up over words, so they are taken once per word, summed over
    blocks of gcd(length, stride) words, and a window adds up its blocks.  Only
    surviving windows are rebuilt as text.

    With a vocabulary (and reference list) within the inline bound, or within that of
    ``word_set``, there is no shuffle at all.  Otherwise the words of a document, not of its
    windows, are joined to the vocabulary and summed by block.
    Adds ``start``, ``n_tokens``, ``span``; drops the text column.
    """
    others = [c for c in docs.columns if c != text]
    g = gcd(length, stride)
    word_list, listed = word_set(vocab), word_set(english_vocab) if english_vocab is not None else frozenset()
    words, english = _inline(word_list, inline), _inline(listed, inline) if english_vocab is not None else []
    if words is not None and english is not None:
        source = docs
        blocks = _inline_blocks_sql(text, words, english if english_vocab is not None else None, g)
    elif word_list is not None and listed is not None:
        test = _WordTest(docs.sparkSession, word_list, listed if english_vocab is not None else None)
        source, blocks = docs.withColumn("_blocks", test.blocks(F.expr(_marked_tokens_sql(text)), g)), "_blocks"
    else:
        keys = [*ids, "_row"]  # repeated ids are told apart by their text
        staged = docs.withColumn("_row", F.xxhash64(text))
        source = staged.join(_joined_blocks(staged, keys, text, vocab, english_vocab, g), keys)
        blocks = "_blocks"
    window = f"aggregate(slice(d.b, cast(s div {g} as int) + 1, {length // g}), 0L, (a, x) -> least(a + x, {FULL}L))"
    hits = (
        f"filter(transform(sequence(0, size(d.w) - 1, {stride}), s -> named_struct('start', s, 'n_tokens', {window})), "
        f"r -> r.n_tokens > {min_tokens} AND r.n_tokens < {OOV_UNIT}L)"
    )
    span = f"array_join(slice(d.w, h.start + 1, {length}), ' ')"
    # transform over a one-element array binds a value that is used repeatedly
    rows = (
        f"transform(array(named_struct('w', split(lower(`{text}`), ' '), 'b', {blocks})), d -> transform({hits}, "
        f"h -> named_struct('start', h.start, 'n_tokens', h.n_tokens, 'span', {span})))[0]"
    )
    # the generator takes the expression itself: over a named column Spark would
    # infer a filter on it and compute the whole expression a second time
    return source.select(*others, F.expr(f"inline({rows})"))


def _inline_blocks_sql(text: str, words: Sequence[str], english: Sequence[str] | None, g: int) -> str:
    """SQL for token and violation counts per block of g words."""
    found = f"regexp_extract_all(p, r'{tx.TOKEN_PATTERN}', 0)"
    outside = f"1L + {OOV_UNIT}L"
    if english is not None:
        listed = set(english)
        words = [w for w in words if w in listed]
        outside = f"IF({sql_in('t', english)}, {outside}, 0L)"
    per_word = (
        f"transform({_prepared_words_sql('`' + text + '`')}, p -> "
        f"aggregate({found}, 0L, (a, t) -> least(a + IF({sql_in('t', words)}, 1L, {outside}), {FULL}L)))"
    )
    return (
        f"transform(array({per_word}), c -> transform(sequence(0, size(c) - 1, {g}), "
        f"s -> aggregate(slice(c, s + 1, {g}), 0L, (a, x) -> least(a + x, {FULL}L))))[0]"
    )


def _marked_tokens_sql(text: str) -> str:
    """SQL for an array of all tokens, with WORD_END between the normalised words."""
    return f"coalesce(regexp_extract_all({_prepared_text_sql('`' + text + '`')}, r'\\u000B|{tx.TOKEN_PATTERN}', 0), array())"


def _joined_blocks(
    docs: DataFrame, ids: Sequence[str], text: str, vocab: DataFrame, english_vocab: DataFrame | None, g: int,
) -> DataFrame:
    """The same counts per document as ``_blocks``, by a join on the words.

    Every block has at least one row, so the list of a document has no gaps;
    its length is that of the document over g.
    """
    words = docs.select(*ids, F.posexplode(F.expr(_prepared_words_sql(f"`{text}`"))).alias("_pos", "_p"))
    tokens = F.regexp_extract_all("_p", F.lit(tx.TOKEN_PATTERN), F.lit(0))
    block = F.floor(F.col("_pos") / g).cast("int").alias("_block")
    rows = words.select(*ids, block, "_pos", F.posexplode_outer(tokens).alias("_t", "_w"))
    rows = lookup_join(rows, _word_marks(vocab, english_vocab), ["_w"], "left", [*ids, "_block"])
    copies = F.count_if((F.col("_pos") == F.col("_block") * g) & (F.coalesce("_t", F.lit(0)) == 0))  # equal rows
    missing = F.lit(1 + OOV_UNIT if english_vocab is None else 0)
    code = (
        F.when(F.col("_w").isNull(), 0).when(F.col("_hit"), 1)
        .when(F.col("_hit").isNull(), missing).otherwise(F.lit(1 + OOV_UNIT))
    )
    total = F.when(F.max(code) > OOV_UNIT, F.lit(OOV_UNIT)).otherwise((F.sum(F.least(code, F.lit(1)).cast("bigint")) / copies).cast("bigint"))
    per_block = rows.groupBy(*ids, "_block").agg(total.alias("_c"))
    lists = per_block.groupBy(*ids).agg(F.sort_array(F.collect_list(F.struct("_block", "_c"))).alias("_l"))
    return lists.select(*ids, F.transform("_l", lambda x: x["_c"]).alias("_blocks"))


def dedup_spans(spans: DataFrame, text: str = "span", ids: Sequence[str] = ("doc_id", "start")) -> DataFrame:
    """One row per exact text, the one with the smallest ids.

    ``min`` over a struct combines map-side, so a text with very many copies
    sends one row per task.
    """
    others = [c for c in spans.columns if c not in ids and c != text]
    best = F.min(F.struct(*ids, *others)).alias("_b")
    return spans.groupBy(text).agg(best).select(
        *[F.col("_b." + c).alias(c) if c != text else F.col(text) for c in spans.columns]
    )


def selection_stats(n_spans: DataFrame, selected: DataFrame, text: str = "span") -> DataFrame:
    """Total, selected and distinct selected spans, and the selected percent.

    ``n_spans`` is a one-row table with the span total in column ``total``.
    """
    picked = selected.groupBy(text).agg(F.count(F.lit(1)).alias("_c")).agg(
        F.coalesce(F.sum("_c"), F.lit(0)).alias("selected"),
        F.count(F.lit(1)).alias("selected_distinct"),
    )
    total = n_spans.select("total").scalar()
    return picked.select(
        total.alias("total"), "selected", "selected_distinct",
        F.round(F.try_divide(100 * F.col("selected"), total), 6).alias("pct_selected"),
    )


def count_spans(docs: DataFrame, text: str = "text", stride: int = SPAN_STRIDE) -> DataFrame:
    """Number of spans without cutting them."""
    per_doc = F.floor((tx.count_words(text) - 1) / stride) + 1
    return docs.agg(F.sum(per_doc).cast("bigint").alias("total"))


# --- features -----------------------------------------------------------------------
def featurize_docs(
    df: DataFrame, vocab: DataFrame, ages: DataFrame, ids: Sequence[str] = ("doc_id",),
    text: str = "text", source: str = "source", inline: int = INLINE_WORDS,
) -> DataFrame:
    """Lexical record per text: distinct terms, age sum and mean, OOV terms.

    The text is not preprocessed.  A vocabulary term without an age bin counts
    1; a term with several takes the earliest.  The mean divides by all terms,
    OOV ones included, and is NULL for a text without terms.
    """
    terms = F.coalesce(F.array_distinct(tx.word_tokens(text)), F.array().cast("array<string>"))
    words = bounded_words(vocab, inline)
    bins = earliest_bin(ages)
    binned = None
    if words is not None:
        in_vocab = bins.join(vocab.select("word").distinct(), "word", "left_semi")
        binned = in_vocab.where("bin > 1").limit(inline + 1).collect()
        if len(binned) > inline:
            binned = None
    if binned is not None:
        by_bin: dict[int, list[str]] = {}
        for row in binned:
            by_bin.setdefault(row["bin"], []).append(row["word"])
        extra = " + ".join(
            f"{b - 1} * size(filter(_iov, w -> {sql_in('w', ws)}))" for b, ws in sorted(by_bin.items())
        )
        staged = df.withColumn("_terms", terms).withColumn(
            "_iov", F.expr(f"filter(_terms, w -> {sql_in('w', words)})")
        )
        scored = staged.select(
            *ids, F.col(text).alias("TEXT"), F.col(source).alias("DATA_SOURCE"),
            F.size("_terms").cast("bigint").alias("SENTENCE_LENGTH"),
            F.expr(f"size(_iov) + {extra or '0'}").cast("bigint").alias("TOTAL_AGE"),
            F.sort_array(F.array_except("_terms", "_iov")).alias("OOV_WORDS"),
        )
    else:
        marks = vocab.select("word").distinct().join(bins, "word", "left").select(
            "word", F.lit(True).alias("_hit"), F.coalesce("bin", F.lit(1)).alias("_age")
        )
        keys = [*ids, "_row"]
        staged = df.withColumn("_row", F.xxhash64(terms))
        rows = lookup_join(staged.select(*keys, F.posexplode_outer(terms).alias("_pos", "word")), marks, ["word"], "left", keys)
        oov = F.col("_hit").isNull() & F.col("word").isNotNull()
        per = rows.groupBy(*keys).agg(
            _per_copy(F.count("word")).alias("SENTENCE_LENGTH"),
            _per_copy(F.coalesce(F.sum("_age"), F.lit(0))).alias("TOTAL_AGE"),
            F.sort_array(F.collect_set(F.when(oov, F.col("word")))).alias("OOV_WORDS"),
        )
        scored = staged.join(per, keys).select(
            *ids, F.col(text).alias("TEXT"), F.col(source).alias("DATA_SOURCE"),
            "SENTENCE_LENGTH", "TOTAL_AGE", "OOV_WORDS",
        )
    return scored.select(
        *ids, "TEXT", "DATA_SOURCE", "SENTENCE_LENGTH", "TOTAL_AGE",
        F.try_divide(F.col("TOTAL_AGE"), F.col("SENTENCE_LENGTH")).alias("AVG_AGE"),
        F.size("OOV_WORDS").cast("bigint").alias("OOV_COUNT"), "OOV_WORDS",
    )


def merge_records(records: DataFrame, key: str, version: str) -> DataFrame:
    """Keyed merge: the record with the highest version wins."""
    others = [c for c in records.columns if c not in (key, version)]
    best = F.max_by(F.struct(version, *others), version).alias("_b")
    return records.groupBy(key).agg(best).select(key, "_b.*")
