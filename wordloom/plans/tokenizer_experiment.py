"""Grid of subword families and vocabulary sizes, scored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from wordloom.operators.tokens import (
    Subwords, cut_to, encode_words, family_of, morph_score, text_pieces, token_splitter, tokenizer_split_ratio, train_tokenizer, unk_rate, word_shares,
)
from wordloom.session import checkpointed, measured, scratch_dir

PRETRAINED = "pretrained"


def score_tokenizer(
    name: str, size: str, model: Subwords, sentences: DataFrame, parts: DataFrame, eval_sets: DataFrame | None = None,
    shares: DataFrame | None = None,
) -> DataFrame:
    """One row of scores; unknown rates per task become columns.  The words of sentences and parts are
    encoded once, and so are the examples; ``shares`` are the sentences' words if they were counted before."""
    shares = word_shares(sentences) if shares is None else shares
    path = scratch_dir(sentences.sparkSession, "encoded-words")
    encode_words(shares.select("word").unionByName(parts.select("word")), model).write.parquet(path)
    encoded = sentences.sparkSession.read.schema("word string, tokens array<string>").parquet(path)
    row = tokenizer_split_ratio(sentences, encoded, shares=shares).select(
        F.lit(name).alias("tokenizer"), F.lit(size).alias("vocab_size"), "*",
        morph_score(encoded, parts).scalar().alias("manual_evaluation"),
    )
    if eval_sets is None:
        return row
    tokens = token_splitter(model)(text_pieces("text", model.family))
    examples = eval_sets.select("task", tokens.alias("tokens"))
    rates = measured(unk_rate(examples, "tokens"))  # a row a task: finding the columns does not encode again
    return row.join(rates.groupBy(F.lit(name).alias("tokenizer")).pivot("task").agg(F.first("unk_rate")), "tokenizer")


def tokenizer_experiment(
    corpus: DataFrame, sentences: DataFrame, parts: DataFrame, families: Sequence[str], sizes: Sequence[int],
    eval_sets: DataFrame | None = None, save=None,
) -> DataFrame:
    """Scores for every (family, size); ``save(name, model, scores)`` is called
    after each, so that a long grid leaves its finished rows behind.  A family of merges is
    trained once, to the largest size; the smaller vocabularies are cut from it."""
    out, parts, shares = None, checkpointed(parts), checkpointed(word_shares(sentences))
    for family in families:
        largest = train_tokenizer(corpus, "text", family, max(sizes))
        for size in sizes:
            if size == max(sizes):
                model = largest
            elif family_of(family) == "unigram":
                model = train_tokenizer(corpus, "text", family, size)
            else:
                model = cut_to(largest, size)
            row = score_tokenizer(family, str(size), model, sentences, parts, eval_sets, shares)
            if save is not None:
                save(f"{family}_{size}", model, row)
            out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    return out
