"""Vocabulary building: frequencies, lookups, ranks, ages, curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import (
    AGES, DICT, FREQ, RANKED, VOCAB, ages, as_bigint, dictionary, documents, frequencies, query, rounded, table, tok, transcripts,
    utt, vocabulary, TRANSCRIPTS,
)
from wordloom.functions import text as tx
from wordloom.operators import vocab as vo

ENDINGS = "(word LIKE '%ion' OR word LIKE '%ing' OR word LIKE '%est' OR word LIKE '%er' OR word LIKE '%ed' OR word LIKE '%s')"


@query("word_frequency", f"WITH {FREQ} SELECT word, frequency FROM freq")
def _(spark, sf):
    return frequencies(spark, sf)


@query("explode_tokens", f"""
SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents) GROUP BY ALL""")
def _(spark, sf):
    return vo.doc_term_counts(documents(spark, sf, "doc_id", "text"), ["doc_id"])


@query("doc_term_counts", f"""
WITH {DICT} SELECT doc_id, term, count(*) AS cnt FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents)
WHERE term IN (SELECT word FROM dict) GROUP BY ALL""")
def _(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return vo.doc_term_counts(docs, ["doc_id"], english_vocab=dictionary(spark, sf))


@query("doc_term_binary", f"""
SELECT DISTINCT doc_id, term, CAST(1 AS BIGINT) AS cnt FROM (SELECT doc_id, unnest({tok('text')}) AS term FROM documents)""")
def _(spark, sf):
    return vo.doc_term_counts(documents(spark, sf, "doc_id", "text"), ["doc_id"], binary=True)


for _variant in "ABC":

    @query(f"utterance_tokens_{_variant.lower()}", f"""
SELECT doc_id, array_to_string({utt('text', _variant)}, '|') AS tokens FROM documents""")
    def _(spark, sf, variant=_variant):
        return documents(spark, sf, "doc_id", F.array_join(tx.utterance_tokens("text", variant), "|").alias("tokens"))


@query("suffix_rule", f"""
WITH {FREQ}, {DICT} SELECT word, {ENDINGS} AS by_suffix, word IN (SELECT word FROM dict) OR {ENDINGS} AS accepted FROM freq""")
def _(spark, sf):
    words = vo.vocab_membership(frequencies(spark, sf).select("word"), dictionary(spark, sf))
    by_suffix = tx.has_word_suffix("word")
    return words.select("word", by_suffix.alias("by_suffix"), (F.col("in_vocab") | by_suffix).alias("accepted"))


@query("accepted_and_rejected_words", f"""
WITH {TRANSCRIPTS}, {DICT}, w AS (SELECT word, count(*) AS frequency FROM (SELECT unnest({utt('gloss', 'A')}) AS word FROM ts) GROUP BY word)
SELECT word, word IN (SELECT word FROM dict) OR {ENDINGS} AS accepted, frequency FROM w""")
def _(spark, sf):
    return vo.dictionary_counts(transcripts(spark, sf), tx.utterance_tokens("gloss", "A"), dictionary(spark, sf))


@query("rare_words", f"WITH {FREQ} SELECT word, frequency FROM freq WHERE frequency < 5")
def _(spark, sf):
    return vo.rare_words(frequencies(spark, sf))


@query("lookup_word", f"WITH {FREQ} SELECT word, frequency FROM freq WHERE word = 'the'")
def _(spark, sf):
    return vo.lookup_word(frequencies(spark, sf), "the")


@query("filter_prefix", f"WITH {FREQ} SELECT word, frequency FROM freq WHERE starts_with(word, 'ther')")
def _(spark, sf):
    return vo.words_with_prefix(frequencies(spark, sf), "ther")


@query("dictionary_words", f"WITH {FREQ}, {DICT} SELECT word, frequency FROM freq WHERE word IN (SELECT word FROM dict)")
def _(spark, sf):
    return vo.vocab_overlap(frequencies(spark, sf), dictionary(spark, sf))


@query("vocab_membership", f"""
WITH {FREQ}, {VOCAB} SELECT word, frequency, word IN (SELECT word FROM vocab) AS in_vocab FROM freq""")
def _(spark, sf):
    return vo.vocab_membership(frequencies(spark, sf), vocabulary(spark, sf))


@query("vocab_oov", f"WITH {FREQ}, {VOCAB} SELECT word, frequency FROM freq WHERE word NOT IN (SELECT word FROM vocab)")
def _(spark, sf):
    return vo.vocab_oov(frequencies(spark, sf), vocabulary(spark, sf))


_TALK = f"talk AS (SELECT DISTINCT unnest({tok('text')}) AS word FROM conversations)"


def _talk(spark, sf):
    return table(spark, sf, "conversations", F.explode(tx.word_tokens("text")).alias("word"))


@query("vocab_overlap", f"WITH {_TALK}, {FREQ} SELECT word, frequency FROM freq WHERE word IN (SELECT word FROM talk)")
def _(spark, sf):
    return vo.vocab_overlap(frequencies(spark, sf), _talk(spark, sf))


@query("vocab_intersect", f"WITH {_TALK}, {VOCAB} SELECT word FROM talk INTERSECT SELECT word FROM vocab")
def _(spark, sf):
    return vo.vocab_intersect(_talk(spark, sf), vocabulary(spark, sf))


@query("vocab_except", f"WITH {_TALK}, {VOCAB} SELECT word FROM talk EXCEPT SELECT word FROM vocab")
def _(spark, sf):
    return vo.vocab_except(_talk(spark, sf), vocabulary(spark, sf))


@query("vocab_union", f"WITH {_TALK}, {VOCAB} SELECT word FROM talk UNION SELECT word FROM vocab")
def _(spark, sf):
    return vo.vocab_union(_talk(spark, sf), vocabulary(spark, sf))


@query("percent_missing", f"""
WITH {DICT}, {VOCAB}, c AS (SELECT count(*) FILTER (WHERE word NOT IN (SELECT word FROM vocab)) AS m, count(*) AS n FROM dict)
SELECT m AS n_missing, n AS n_words, round(100 * round(m / n, 4), 4) AS pct_missing FROM c""")
def _(spark, sf):
    return rounded(vo.percent_missing(dictionary(spark, sf), vocabulary(spark, sf)), "pct_missing", digits=4)


# --- ranks ------------------------------------------------------------------------------
@query("word_rank", f"WITH {RANKED} SELECT word, frequency, word_rank FROM ranked")
def _(spark, sf):
    return vo.word_rank(frequencies(spark, sf))


@query("cumulative_frequency_pct", f"""
WITH {RANKED} SELECT word, frequency, word_rank, frequency_cum, round(frequency_cum_pct, 9) AS frequency_cum_pct FROM ranked""")
def _(spark, sf):
    return rounded(vo.cumulative_frequency_pct(frequencies(spark, sf)), "frequency_cum_pct", digits=9)


@query("filter_between", f"""
WITH {RANKED} SELECT word, word_rank FROM ranked WHERE word_rank BETWEEN 1000 AND 2000 AND frequency_cum_pct < 0.99""")
def _(spark, sf):
    return vo.rank_between(vo.cumulative_frequency_pct(frequencies(spark, sf)), 1000, 2000).select("word", "word_rank")


@query("word_rank_lookup", f"""
WITH {RANKED}, {_TALK} SELECT talk.word, word_rank, coalesce(word_rank, 0) AS word_rank_ref FROM talk LEFT JOIN ranked USING (word)""")
def _(spark, sf):
    return vo.word_rank_lookup(_talk(spark, sf).distinct(), vo.word_rank(frequencies(spark, sf)))


@query("sort_by_frequency", f"WITH {FREQ} SELECT word, frequency FROM freq ORDER BY frequency DESC, word")
def _(spark, sf):
    return frequencies(spark, sf).orderBy(F.desc("frequency"), "word")


@query("sort_by_rank", f"WITH {RANKED} SELECT word, word_rank FROM ranked WHERE word IS NOT NULL ORDER BY word_rank")
def _(spark, sf):
    return vo.word_rank(frequencies(spark, sf)).select("word", "word_rank").dropna().orderBy("word_rank")


# --- books --------------------------------------------------------------------------------
@query("vocab_size_by_book", f"""
SELECT doc_id, CAST(len(list_distinct({utt("replace(text, chr(10), '')", 'A')})) AS BIGINT) AS n_distinct FROM documents""")
def _(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return vo.distinct_words_per_document(docs, tx.utterance_tokens(tx.remove_newlines("text"), "A"), ["doc_id"])


@query("corpus_word_frequency", f"""
SELECT word, count(*) AS frequency FROM (SELECT unnest({utt("replace(text, chr(10), '')", 'A')}) AS word FROM documents) GROUP BY word""")
def _(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    tokens = tx.utterance_tokens(tx.remove_newlines("text"), "A")
    per_book = docs.select("doc_id", F.inline(tx.term_counts(tokens))).withColumnRenamed("term", "word")
    return vo.merge_counts(per_book)


@query("kl_divergence", f"""
WITH d AS (SELECT source, unnest({tok('text')}) AS word FROM documents),
p AS (SELECT word AS key, count(*) + 0.0 AS w FROM d WHERE source = 'src0' GROUP BY 1),
q AS (SELECT word AS key, count(*) + 0.0 AS w FROM d GROUP BY 1)
SELECT round(sum(p.w / tp * ln((p.w / tp) / (q.w / tq))), 6) AS kl
FROM p JOIN q USING (key), (SELECT sum(w)::DOUBLE AS tp FROM p), (SELECT sum(w)::DOUBLE AS tq FROM q)""")
def _(spark, sf):
    docs = documents(spark, sf, "source", "text")
    weights = lambda df: vo.word_frequency(df).select(F.col("word").alias("key"), F.col("frequency").cast("double").alias("w"))
    return rounded(vo.kl_divergence(weights(docs.where("source = 'src0'")), weights(docs)), "kl")


# --- ages -----------------------------------------------------------------------------------
@query("age_bin", f"""
WITH {AGES} SELECT word, round(age, 9) AS age, CASE WHEN age > 0 AND age <= 6 THEN CAST(ceil(age) AS INT) END AS age_bin FROM ages""")
def _(spark, sf):
    return rounded(ages(spark, sf).withColumn("age_bin", tx.age_bin("age")), "age", digits=9)


@query("vocab_by_age_bin", f"""
WITH {AGES} SELECT CAST(ceil(age) AS INT) AS age_bin, count(DISTINCT word) AS n_words FROM ages WHERE age > 0 AND age <= 6 GROUP BY 1""")
def _(spark, sf):
    return vo.vocab_by_age_bin(ages(spark, sf))


@query("age_bin_words", f"""
WITH {AGES} SELECT DISTINCT CAST(ceil(age) AS INT) AS age_bin, word FROM ages WHERE age > 0 AND age <= 6""")
def _(spark, sf):
    return vo.age_bin_words(ages(spark, sf))


@query("age_lookup", f"""
WITH {AGES}, {_TALK} SELECT talk.word, coalesce(CAST(ceil(age) AS INT), 1) AS age_bin FROM talk LEFT JOIN ages USING (word)""")
def _(spark, sf):
    return vo.age_lookup(_talk(spark, sf).distinct(), ages(spark, sf))


@query("words_by_age", f"WITH {AGES} SELECT round(age, 9) AS age, count(*) AS n_words FROM ages GROUP BY 1")
def _(spark, sf):
    return rounded(vo.words_by_age(ages(spark, sf)), "age", digits=9)


@query("cumulative_vocab", f"""
WITH {AGES}, n AS (SELECT age, count(*) AS n_words FROM ages GROUP BY age)
SELECT round(age, 9) AS age, n_words, CAST(sum(n_words) OVER (ORDER BY age) AS BIGINT) AS cum_count FROM n""")
def _(spark, sf):
    return rounded(vo.cumulative_vocab(ages(spark, sf)), "age", digits=9)


def _ranked_ages(spark, sf):
    ranked = vo.word_rank(vo.word_frequency(documents(spark, sf, "text")))
    return vo.word_rank_lookup(ages(spark, sf), ranked).select("word", "age", "word_rank")


_RANKED_AGES = (
    f"{AGES}, {FREQ}, "
    "ranked AS (SELECT word, row_number() OVER (ORDER BY frequency DESC, word) - 1 AS word_rank FROM freq), "
    "ra AS (SELECT a.word, age, word_rank FROM ages a LEFT JOIN ranked USING (word))"
)


@query("age_windows", f"""
WITH {_RANKED_AGES}, idx AS (SELECT age, row_number() OVER (ORDER BY age) - 1 AS i FROM (SELECT DISTINCT age FROM ra)),
b AS (SELECT i // 144 AS window_no, coalesce(lag(age) OVER (ORDER BY age), 0) AS age_from, age AS age_to FROM idx WHERE i % 144 = 0)
SELECT window_no, round(age_from, 9) AS age_from, round(age_to, 9) AS age_to, word, round(age, 9) AS age, word_rank
FROM ra JOIN b ON age BETWEEN age_from AND age_to WHERE word_rank IS NOT NULL""")
def _(spark, sf):
    return rounded(vo.age_windows(_ranked_ages(spark, sf)), "age_from", "age_to", "age", digits=9)


@query("vocab_chunks", f"""
WITH {_RANKED_AGES}, p AS (SELECT *, (row_number() OVER (ORDER BY age, word) - 1) AS pos FROM ra)
SELECT pos // 1419 AS chunk_no, count(*) AS n_ranked, round(max_by(age, pos), 9) AS last_age FROM p
WHERE pos < 8 * 1419 AND word_rank IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    return rounded(vo.vocab_chunks(_ranked_ages(spark, sf)), "last_age", digits=9)


@query("acquired_vocab_curve", f"""
WITH {TRANSCRIPTS}, {DICT}, u AS (SELECT *, row_number() OVER (ORDER BY target_child_age, transcript_id, turn) AS o FROM ts WHERE speaker_role = 'user'),
f AS (SELECT word, min(o) AS o FROM (SELECT o, unnest({utt('gloss', 'B')}) AS word FROM u) WHERE word IN (SELECT word FROM dict) GROUP BY word),
n AS (SELECT o, count(*) AS n_new FROM f GROUP BY o)
SELECT target_child_age, transcript_id, turn, coalesce(n_new, 0) AS n_new,
       CAST(coalesce(sum(n_new) OVER (ORDER BY o), 0) AS BIGINT) AS vocab_size FROM u LEFT JOIN n USING (o)""")
def _(spark, sf):
    said = transcripts(spark, sf).where("speaker_role = 'user'")
    return vo.acquired_vocab_curve(
        said, ["target_child_age", "transcript_id", "turn"], tx.utterance_tokens("gloss", "B"), dictionary(spark, sf)
    )
