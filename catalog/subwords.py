"""Subword training, encoding, masking and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import VOCAB, documents, hkey, query, rounded, table, tok, vocabulary
from catalog.evaluation import IDS, _joined, token_ids, turn_pairs
from wordloom.functions import arrays as ar, text as tx
from wordloom.operators import metrics as me, tokens as tk, vocab as vo
from wordloom.session import scratch_dir
from wordloom.sources import models

_PRE = r"regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+')"
PIECES = f"pieces AS (SELECT piece, count(*) AS frequency FROM (SELECT unnest({_PRE}) AS piece FROM documents) GROUP BY piece)"


@query("bpe_pretokenize", f"WITH {PIECES} SELECT piece, frequency FROM pieces")
def _(spark, sf):
    return tk.pretokenize(documents(spark, sf, "text"))


@query("bpe_pair_counts", f"""
WITH {PIECES}, s AS (SELECT string_split(piece, '') AS c, frequency FROM pieces),
p AS (SELECT c, frequency, unnest(range(1, len(c))) AS i FROM s)
SELECT c[i] AS "left", c[i + 1] AS "right", CAST(sum(frequency) AS BIGINT) AS "count" FROM p GROUP BY ALL""")
def _(spark, sf):
    words = tk.pretokenize(documents(spark, sf, "text"))
    return tk.pair_counts(words.withColumn("symbols", tk.start_symbols("piece", "bpe")))


@query("wordpiece_pair_scores", f"""
WITH {PIECES}, s AS (SELECT list_transform(string_split(piece, ''), lambda x, i: CASE WHEN i = 1 THEN x ELSE '##' || x END) AS c, frequency FROM pieces),
o AS (SELECT s, sum(frequency) AS n FROM (SELECT unnest(c) AS s, frequency FROM s) GROUP BY s),
p AS (SELECT c[i] AS l, c[i + 1] AS r, sum(frequency) AS n FROM (SELECT c, frequency, unnest(range(1, len(c))) AS i FROM s) GROUP BY ALL)
SELECT l AS "left", r AS "right", CAST(p.n AS BIGINT) AS "count", round(p.n::DOUBLE / (a.n::DOUBLE * b.n::DOUBLE), 12) AS score
FROM p JOIN o a ON l = a.s JOIN o b ON r = b.s""")
def _(spark, sf):
    words = tk.pretokenize(documents(spark, sf, "text")).withColumn("symbols", tk.start_symbols("piece", "wordpiece"))
    return rounded(tk.pair_scores(words), "score", digits=12)


# Entries of the trained vocabularies.
VOCAB_ENTRIES = 30_000
# The oracle writes every merge out, so it follows only small vocabularies; the queries
# named ..._small train these: 106 reserved tokens, the alphabet, and merges.
SIZES = {"BPE": 230, "WordPiece": 318, "SentencePiece": 230, "ByteLevelBPE": 386, "bert-base-uncased": 245}
_STEPS = 40  # merges written out in the oracle; the sizes leave room for fewer
_CHARS = "string_split(piece, '')"
_MARKED = f"list_transform({_CHARS}, lambda x, i: CASE WHEN i = 1 THEN x ELSE '##' || x END)"
# \s+(?!\S) has no RE2 form: a mark is put before the last blank of a run that a word follows
_HELD = r"regexp_replace(text, '(\s+)(\s\S)', '\1' || chr(4) || '\2', 'g')"
_BYTES = (
    f"regexp_extract_all({_HELD}, "
    + r"'''s|''t|''re|''ve|''m|''ll|''d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}\x04]+|\s+')"
)
_BLANK_SPLIT = r"list_transform(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''), lambda w: '▁' || w)"
_LOWER_PRE = _PRE.replace("(text,", "(lower(text),")
# family: pieces of a text, symbols of a piece, size of a fixed alphabet
_FORMS = {
    "BPE": (_PRE, _CHARS, None), "WordPiece": (_PRE, _MARKED, None), "SentencePiece": (_BLANK_SPLIT, _CHARS, None),
    "ByteLevelBPE": (_BYTES, "regexp_extract_all(hex(piece), '..')", 256), "bert-base-uncased": (_LOWER_PRE, _MARKED, None),
}


def _training_sql(family: str, likelihood: bool = False) -> str:
    """Greedy training as one CTE per merge: the best pair of the pieces, then the pieces with it merged."""
    cut, symbols, fixed = _FORMS[family]
    alphabet = f"SELECT {fixed} AS n" if fixed else "SELECT count(DISTINCT x) AS n FROM (SELECT unnest(c) AS x FROM s0)"
    out = f"""WITH pieces AS (SELECT piece, count(*) AS f FROM (SELECT unnest({cut}) AS piece FROM documents) GROUP BY piece),
s0 AS MATERIALIZED (SELECT {symbols} AS c, f FROM pieces),
room AS MATERIALIZED (SELECT {SIZES[family]} - 106 - n AS n FROM ({alphabet})),
w0 AS MATERIALIZED (SELECT array_to_string(list_transform(c, lambda x: chr(2) || x || chr(3)), '') AS t, f FROM s0)"""
    merged = "l || CASE WHEN starts_with(r, '##') THEN substr(r, 3) ELSE r END" if symbols == _MARKED else "l || r"
    for k in range(_STEPS):
        lists = f"(SELECT string_split(substr(t, 2, length(t) - 2), chr(3) || chr(2)) AS c, f FROM w{k})"
        order, single, joined = "n DESC, l, r", "", ""
        if likelihood:
            single = f", o{k} AS (SELECT x, sum(f) AS m FROM (SELECT unnest(c) AS x, f FROM {lists}) GROUP BY x)"
            joined = f"JOIN o{k} a ON a.x = l JOIN o{k} b ON b.x = r"
            order = "n::DOUBLE / (a.m::DOUBLE * b.m::DOUBLE) DESC, l, r"
        out += f"""{single}, b{k} AS MATERIALIZED (SELECT l, r, {merged} AS m FROM (SELECT l, r, sum(f) AS n FROM
  (SELECT unnest(c[1 : len(c) - 1]) AS l, unnest(c[2 :]) AS r, f FROM {lists} WHERE len(c) > 1) GROUP BY l, r) {joined}
  WHERE {k} < (SELECT n FROM room) ORDER BY {order} LIMIT 1),
w{k + 1} AS MATERIALIZED (SELECT coalesce(replace(t, chr(2) || l || chr(3) || chr(2) || r || chr(3), chr(2) || m || chr(3)), t) AS t, f
  FROM w{k} LEFT JOIN b{k} ON true)"""
    rows = " UNION ALL ".join(f"SELECT {k} AS rank, l, r, m FROM b{k}" for k in range(_STEPS))
    return out + f', merges AS (SELECT CAST(rank AS BIGINT) AS rank, l AS "left", r AS "right", m AS merged FROM ({rows})) '


def _train(spark, sf, family, score=None, size=VOCAB_ENTRIES):
    return tk.train_tokenizer(documents(spark, sf, "text"), "text", family, vocab_size=size, score=score)


for _key, _family, _score in (
    ("train_bpe", "BPE", None), ("train_wordpiece", "WordPiece", None), ("train_wordpiece_likelihood", "WordPiece", "likelihood"),
    ("train_sentencepiece_bpe", "SentencePiece", None), ("train_byte_bpe", "ByteLevelBPE", None), ("retrain_like", "bert-base-uncased", None),
):

    @query(_key)
    def _(spark, sf, family=_family, score=_score):
        return _train(spark, sf, family, score).merges

    @query(f"{_key}_small", _training_sql(_family, _score == "likelihood") + "SELECT * FROM merges")
    def _(spark, sf, family=_family, score=_score):
        return _train(spark, sf, family, score, SIZES[family]).merges


@query("special_tokens")
def _(spark, sf):
    """A trained vocabulary: reserved tokens first, then the alphabet, then the merges."""
    return _train(spark, sf, "BPE").vocab.select("token", "id")


def _special_sql() -> str:
    return _training_sql("BPE") + """
SELECT token, min(id) AS id FROM (
  SELECT unnest(['<s>', '</s>', '<mask>', '<pad>', '<unk>', '<cls>']) AS token, unnest(range(0, 6)) AS id UNION ALL
  SELECT '<extra_id_' || i || '>', i + 6 FROM range(0, 100) t(i) UNION ALL
  SELECT x, row_number() OVER (ORDER BY x) + 105 FROM (SELECT DISTINCT unnest(c) AS x FROM s0) UNION ALL
  SELECT merged, 106 + (SELECT count(DISTINCT x) FROM (SELECT unnest(c) AS x FROM s0)) + row_number() OVER (ORDER BY rank) - 1
  FROM (SELECT merged, min(rank) AS rank FROM merges GROUP BY merged)) GROUP BY token"""


@query("special_tokens_small", _special_sql())
def _(spark, sf):
    return _train(spark, sf, "BPE", size=SIZES["BPE"]).vocab.select("token", "id")


# --- trained once, saved, read again -----------------------------------------------------
_SAVED: dict[tuple, str] = {}


def trained(spark, sf, family, size=VOCAB_ENTRIES):
    """The vocabulary of these tables, read from where it was saved; the first use in a session trains and saves it."""
    key = (spark.sparkContext.applicationId, sf, family, size)
    if key not in _SAVED:
        path = scratch_dir(spark, "subword-models")
        models.write_subwords(_train(spark, sf, family, size=size), path)
        _SAVED[key] = path
    return models.read_subwords(spark, _SAVED[key])


@query("saved_vocabulary_small", _special_sql())
def _(spark, sf):
    return trained(spark, sf, "BPE", SIZES["BPE"]).vocab.select("token", "id")


@query("saved_merges_small", _training_sql("WordPiece") + "SELECT * FROM merges")
def _(spark, sf):
    return trained(spark, sf, "WordPiece", SIZES["WordPiece"]).merges


@query("retrain_like_unigram")
def _(spark, sf):
    """Unigram vocabulary: token, id, score."""
    return trained(spark, sf, "t5-base").vocab.select("token", "id", "score")


@query("encode_unigram")
def _(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return _joined(tk.encode_text(docs, trained(spark, sf, "t5-base")), "input_ids", "attention_mask").drop("text")


@query("encode_text")
def _(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return _joined(tk.encode_text(docs, trained(spark, sf, "BPE")), "input_ids", "attention_mask").drop("text")


@query("encode_pair")
def _(spark, sf):
    out = tk.encode_pair(turn_pairs(spark, sf), trained(spark, sf, "WordPiece"), "s1", "s2")
    return _joined(out, "input_ids", "attention_mask").drop("s1", "s2")


# --- masking ------------------------------------------------------------------------------
_MASK = f"""{IDS},
padded AS (SELECT doc_id, len(ids) AS n, list_concat(ids, list_transform(range(0, greatest(128 - len(ids), 0)), lambda x: 3)) AS ids FROM ids),
pos AS (SELECT doc_id, n, unnest(range(0, len(ids))) AS i, unnest(ids) AS x FROM padded),
key AS (SELECT *, {hkey('0:0', 'doc_id', 'i')} AS u, {hkey('0:0:id', 'doc_id', 'i')} AS v FROM pos),
masked AS (SELECT *, i < n AND u <= {int(0.15 * 2**60)} AS hit FROM key)"""


def _padded(spark, sf):
    return token_ids(spark, sf).select("doc_id", ar.pad_array("ids", 128, 3).alias("input_ids"))


@query("mask_tokens", f"""
WITH {_MASK} SELECT doc_id, string_agg(CASE WHEN hit THEN 2 ELSE x END, ' ' ORDER BY i) AS input_ids,
string_agg(CASE WHEN hit THEN x ELSE -100 END, ' ' ORDER BY i) AS labels FROM masked GROUP BY doc_id""")
def _(spark, sf):
    return _joined(tk.mask_tokens(_padded(spark, sf), ["doc_id"]), "input_ids", "labels")


@query("mask_tokens_bert", f"""
WITH {_MASK} SELECT doc_id, string_agg(CASE WHEN hit AND u <= {int(0.8 * 0.15 * 2**60)} THEN 2
WHEN hit AND u <= {int(0.9 * 0.15 * 2**60)} THEN v % 19010 ELSE x END, ' ' ORDER BY i) AS input_ids,
string_agg(CASE WHEN hit THEN x ELSE -100 END, ' ' ORDER BY i) AS labels FROM masked GROUP BY doc_id""")
def _(spark, sf):
    return _joined(tk.mask_tokens_bert(_padded(spark, sf), ["doc_id"], 19010), "input_ids", "labels")


@query("mask_check", f"""
WITH {_MASK} SELECT doc_id, count(*) FILTER (WHERE hit) AS n_masked, count(*) FILTER (WHERE hit OR i >= n) AS n_predicted,
count(*) FILTER (WHERE i >= n) > 0 AS differs FROM masked GROUP BY doc_id""")
def _(spark, sf):
    """With pad positions kept as labels, as the parity option does."""
    rows = tk.mask_tokens(_padded(spark, sf), ["doc_id"], pad_label=3)
    return tk.mask_check(rows).select("doc_id", "n_masked", "n_predicted", "differs")


@query("position_accuracy", f"""
WITH {_MASK} SELECT round(count(*) FILTER (WHERE NOT hit OR x = 2) / count(*), 9) AS accuracy FROM masked""")
def _(spark, sf):
    """Equal positions of masked and unmasked ids."""
    rows = _padded(spark, sf).withColumn("gold", F.col("input_ids"))
    return rounded(me.position_accuracy(tk.mask_tokens(rows, ["doc_id"]), "input_ids", "gold"), "accuracy", digits=9)


# The same operators on the ids of a trained vocabulary; tests hold them against brute force.
def _encoded(spark, sf):
    docs = documents(spark, sf, "doc_id", "text")
    return tk.encode_text(docs, trained(spark, sf, "BPE")).select("doc_id", "input_ids")


@query("mask_tokens_trained")
def _(spark, sf):
    return _joined(tk.mask_tokens(_encoded(spark, sf), ["doc_id"]), "input_ids", "labels")


@query("mask_tokens_bert_trained")
def _(spark, sf):
    return _joined(tk.mask_tokens_bert(_encoded(spark, sf), ["doc_id"], VOCAB_ENTRIES), "input_ids", "labels")


@query("mask_check_trained")
def _(spark, sf):
    rows = tk.mask_tokens(_encoded(spark, sf), ["doc_id"], pad_label=3)
    return tk.mask_check(rows).select("doc_id", "n_masked", "n_predicted", "differs")


@query("tokenizer_split_ratio_trained")
def _(spark, sf):
    docs = documents(spark, sf, "text")
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    out = tk.tokenizer_split_ratio(docs, tk.encode_words(words, trained(spark, sf, "BPE")))
    return rounded(out, "sentence_length", "sentence_split_ratio", "word_split_ratio")


@query("morph_score_trained")
def _(spark, sf):
    _, parts = _morph_tables(spark, sf)
    return rounded(tk.morph_score(tk.encode_words(parts, trained(spark, sf, "WordPiece")), parts), "morph_score")


# --- scores -----------------------------------------------------------------------------------
def _thirds(words):
    """A fixed encoding: pieces of three characters."""
    return words.select("word", F.regexp_extract_all("word", F.lit("(?s).{1,3}"), F.lit(0)).alias("tokens"))


@query("tokenizer_split_ratio", """
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
x AS (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM w), t AS (SELECT doc_id, n, ceil(length(word) / 3) AS t FROM x),
s AS (SELECT doc_id, sum(t) AS total, sum(t) / any_value(n) AS ratio FROM t GROUP BY doc_id)
SELECT round((SELECT avg(total) FROM s), 6) AS sentence_length, round((SELECT avg(ratio) FROM s), 6) AS sentence_split_ratio,
round((SELECT avg(t) FROM t), 6) AS word_split_ratio""")
def _(spark, sf):
    docs = documents(spark, sf, "text")
    words = docs.select(F.explode(F.split("text", " ")).alias("word")).distinct()
    out = tk.tokenizer_split_ratio(docs, _thirds(words))
    return rounded(out, "sentence_length", "sentence_split_ratio", "word_split_ratio")


@query("unk_rate", f"""
WITH {VOCAB}, t AS (SELECT doc_id, source AS task, unnest({tok('text')}) AS w FROM documents WHERE len({tok('text')}) > 0),
b AS (SELECT DISTINCT doc_id FROM t WHERE w NOT IN (SELECT word FROM vocab))
SELECT source AS task, round(avg(CASE WHEN doc_id IN (SELECT doc_id FROM b) THEN 1.0 ELSE 0 END), 6) AS unk_rate FROM documents GROUP BY source""")
def _(spark, sf):
    words = vo.bounded_words(vocabulary(spark, sf))
    docs = documents(spark, sf, F.col("source").alias("task"), tx.word_tokens("text").alias("_t"))
    known = F.expr(f"transform(_t, w -> IF({vo.sql_in('w', words)}, w, '<unk>'))")
    return rounded(tk.unk_rate(docs.select("task", known.alias("tokens")), "tokens"), "unk_rate")


_MORPH = f"""w AS (SELECT DISTINCT unnest({tok('text')}) AS word FROM documents),
parts AS (SELECT word, [word[1:3], word[4:]] AS parts FROM w),
enc AS (SELECT word, regexp_extract_all(word, '.{{1,3}}') AS tokens FROM w),
hits AS (SELECT word, replace(t, '_', '') AS token, list_contains(parts, replace(t, '_', '')) AS hit FROM (
SELECT word, unnest(tokens) AS t FROM enc WHERE len(tokens) <> 1 AND len(tokens) <> length(word)) JOIN parts USING (word))"""


def _morph_tables(spark, sf):
    words = documents(spark, sf, F.explode(tx.word_tokens("text")).alias("word")).distinct()
    parts = words.select("word", F.array(F.substring("word", 1, 3), F.expr("substring(word, 4)")).alias("parts"))
    return _thirds(words), parts


@query("morph_parts", f"WITH {_MORPH} SELECT word, token, hit FROM hits")
def _(spark, sf):
    return tk.morph_parts(*_morph_tables(spark, sf))


@query("morph_score", f"WITH {_MORPH} SELECT round((SELECT count(*) FILTER (WHERE hit) FROM hits) / (SELECT 2 * count(*) FROM parts), 6) AS morph_score")
def _(spark, sf):
    return rounded(tk.morph_score(*_morph_tables(spark, sf)), "morph_score")
