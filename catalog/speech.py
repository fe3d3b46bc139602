"""Transcript statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import TRANSCRIPTS, VOCAB, as_bigint, documents, query, rounded, transcripts, vocabulary
from wordloom.functions import literals as li
from wordloom.operators import grammar as gr


@query("filter_role", f"WITH {TRANSCRIPTS} SELECT transcript_id, turn, gloss FROM ts WHERE speaker_role = 'user'")
def _(spark, sf):
    return gr.filter_role(transcripts(spark, sf), "user").select("transcript_id", "turn", "gloss")


@query("utterances_by_role", f"WITH {TRANSCRIPTS} SELECT speaker_role, count(*) AS n FROM ts GROUP BY 1")
def _(spark, sf):
    return gr.count_by(transcripts(spark, sf), "speaker_role")


@query("utterances_by_age", f"WITH {TRANSCRIPTS} SELECT target_child_age, count(*) AS n FROM ts GROUP BY 1")
def _(spark, sf):
    return gr.count_by(transcripts(spark, sf), "target_child_age")


@query("concat_by_transcript", f"""
WITH {TRANSCRIPTS} SELECT transcript_id, CAST(0 AS BIGINT) AS part_no, string_agg(gloss, ' ' ORDER BY turn) AS gloss
FROM ts WHERE speaker_role = 'user' GROUP BY 1""")
def _(spark, sf):
    said = gr.filter_role(transcripts(spark, sf), "user")
    return gr.concat_text(said, ["transcript_id"], ["turn"], " ")


@query("concat_by_age", f"""
WITH {TRANSCRIPTS} SELECT target_child_age, CAST(0 AS BIGINT) AS part_no, string_agg(gloss, '.' ORDER BY transcript_id, turn) AS gloss
FROM ts GROUP BY 1""")
def _(spark, sf):
    return gr.concat_text(transcripts(spark, sf), ["target_child_age"], ["transcript_id", "turn"], ".")


@query("cumulative_words", f"""
WITH {TRANSCRIPTS}, n AS (SELECT target_child_age, CAST(sum(len(string_split(gloss, ' '))) AS BIGINT) AS n_words FROM ts GROUP BY 1)
SELECT target_child_age, n_words, CAST(sum(n_words) OVER (ORDER BY target_child_age) AS BIGINT) AS cum_words FROM n""")
def _(spark, sf):
    return gr.cumulative_words(transcripts(spark, sf))


_JOINED = (
    f"WITH {TRANSCRIPTS}, j AS (SELECT target_child_age, string_agg(gloss, '.' ORDER BY transcript_id, turn) AS gloss FROM ts GROUP BY 1)"
)


@query("mean_sentence_length", f"""
{_JOINED} SELECT target_child_age, round(list_avg(list_transform(string_split(gloss, '.'), lambda s: len(string_split(s, ' ')))), 6)
AS mean_length FROM j""")
def _(spark, sf):
    return rounded(gr.mean_sentence_length(transcripts(spark, sf)), "mean_length")


@query("mean_unique_sentence_length", f"""
{_JOINED} SELECT target_child_age, round(list_avg(list_transform(string_split(gloss, '.'),
lambda s: len(list_distinct(string_split(s, ' '))))), 6) AS mean_unique_length FROM j""")
def _(spark, sf):
    return rounded(gr.mean_unique_sentence_length(transcripts(spark, sf)), "mean_unique_length")


def _n(word: str) -> str:
    return f"CAST((length(gloss) - length(replace(gloss, '{word}', ''))) / {len(word)} AS BIGINT)"


@query("trigger_rate", f"""
{_JOINED}, c AS (SELECT target_child_age, {_n('just')} AS n_just, {_n('both')} AS n_both, {_n('only')} AS n_only, {_n('all')} AS n_all,
{_n('who')} AS n_who, {_n('to be')} AS n_to_be, {_n('that')} AS n_that, {_n('when')} AS n_when, {_n('while')} AS n_while,
CAST(len(string_split(gloss, '.')) AS BIGINT) AS n_sentences FROM j)
SELECT *, round((n_just + n_both + n_only + n_all) / n_sentences, 6) AS noun_initiator_rate,
round(n_who / n_sentences, 6) AS post_modifier_rate, round(n_to_be / n_sentences, 6) AS to_be_rate,
round(n_that / n_sentences, 6) AS that_rate FROM c""")
def _(spark, sf):
    out = gr.trigger_rate(transcripts(spark, sf))
    return rounded(out, "noun_initiator_rate", "post_modifier_rate", "to_be_rate", "that_rate")


@query("book_readability", r"""
WITH c AS (SELECT doc_id, length(text) AS n_chars, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS n_words,
greatest(len(regexp_extract_all(text, '[.!?]+')), 1) AS n_sentences, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS n_syllables FROM documents)
SELECT doc_id, CAST(n_chars AS BIGINT) AS n_chars, CAST(n_words AS BIGINT) AS n_words, CAST(n_sentences AS BIGINT) AS n_sentences,
CAST(n_syllables AS BIGINT) AS n_syllables,
round(206.835::DOUBLE - 1.015::DOUBLE * n_words / n_sentences - 84.6::DOUBLE * (n_syllables / n_words), 6) AS reading_ease FROM c""")
def _(spark, sf):
    return rounded(gr.book_readability(documents(spark, sf, "doc_id", "text"), ["doc_id"]), "reading_ease")


@query("literal_totals", f"""
WITH {VOCAB} SELECT word AS literal,
CAST(sum((length(text) - length(replace(text, word, ''))) // length(word)) AS BIGINT) AS n_occurrences, count(*) FILTER (WHERE contains(text, word)) AS n_texts
FROM vocab, (SELECT coalesce(text, '') AS text FROM documents) GROUP BY word""")
def _(spark, sf):
    """Each word of the target vocabulary as a literal, anywhere in a document."""
    words = [r["word"] for r in vocabulary(spark, sf).collect()]  # VOCAB_SIZE at most
    return li.literal_totals(documents(spark, sf, "text"), words)
