"""Both sides of every size switch, and goldens of repaired behaviour."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import curate as cu, evalset as ev, grammar as gr, pack as pk, runs as ru, vocab as vo
from wordloom.sources import readers as rd

ROWS = [(1, "the cat sat"), (1, "the dog"), (2, None), (3, ""), (4, "the cat sat"), (4, "the cat sat"), (None, "cat")]
INLINE = [20_000, 0]  # inside the row, by a join


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id bigint, text string, source string").where("doc_id is not null")


@pytest.fixture
def vocab(spark):
    return spark.createDataFrame([("the",), ("cat",)], "word string")


@pytest.mark.parametrize("inline", INLINE)
def test_hits(docs, vocab, inline):
    out = cu.vocab_hits(docs, ["doc_id"], tx.word_tokens("text"), vocab, inline)
    got = sorted((r["doc_id"], r["text"] or "", r["n_tokens"], r["n_in_vocab"]) for r in out.collect())
    assert got == [(1, "the cat sat", 3, 2), (1, "the dog", 2, 1), (2, "", 0, 0), (3, "", 0, 0), (4, "the cat sat", 3, 2), (4, "the cat sat", 3, 2)]


@pytest.mark.parametrize("inline", INLINE)
def test_restrict_features_and_coverage(spark, docs, vocab, inline):
    out = cu.restrict_to_english_vocab(docs, ["doc_id"], tx.word_tokens("text"), vocab, inline)
    assert sorted((r["doc_id"], r["tokens"]) for r in out.collect()) == [(1, ["the"]), (1, ["the", "cat"]), (2, []), (3, []), (4, ["the", "cat"]), (4, ["the", "cat"])]
    ages = spark.createDataFrame([("cat", 3.5)], "word string, age double")
    out = cu.featurize_docs(docs, vocab, ages, inline=inline)
    got = sorted((r["doc_id"], r["SENTENCE_LENGTH"], r["TOTAL_AGE"], r["OOV_COUNT"]) for r in out.collect())
    assert got == [(1, 2, 1, 1), (1, 3, 5, 1), (2, 0, 0, 0), (3, 0, 0, 0), (4, 3, 5, 1), (4, 3, 5, 1)]
    cover = ev.eval_coverage(docs.withColumn("task", F.lit("t")), vocab, ["doc_id"], tx.word_tokens("text"), inline=inline).first()
    assert cover["complete"] == pytest.approx(2 / 6)


@pytest.mark.parametrize("inline", INLINE)
def test_spans_of_repeated_ids_and_null_text(spark, inline):
    text = " ".join(["the cat"] * 60)
    rows = [(1, text), (1, text), (1, text + " dog"), (2, None), (3, "dog " * 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = cu.limited_vocab_spans(docs, spark.createDataFrame([("the",), ("cat",)], "word string"), ["doc_id"], inline=inline)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"]) for r in out.collect())
    assert got == sorted([(1, 0, 110), (1, 30, 90), (1, 60, 60)] * 2 + [(1, 0, 110)])


def test_counts_do_not_overflow(spark):
    junk = "-".join(["zz"] * 30)
    docs = spark.createDataFrame([(1, junk)], "doc_id bigint, text string")
    old = cu.OOV_UNIT
    try:
        cu.OOV_UNIT = 2**59  # as many violations as would have overflowed
        assert cu.limited_vocab_spans(docs, spark.createDataFrame([("the",)], "word string"), ["doc_id"]).count() == 0
    finally:
        cu.OOV_UNIT = old


def test_patterns(col):
    assert col(tx.strip_non_alphanumeric("text"), "snake_case a\n\n b, é!") == "snakecase a\n\n b é"
    assert col(tx.collapse_spaces("text"), "a  b \t c\n\n  d e") == "a b c\n\n d e"
    assert col(tx.plain_words("text"), "snake_case, é 12") == ["snake_case", "é", "12"]


def test_null_texts_are_absent_from_sequences(spark):
    rows = [("s", i, None if i == 3 else "w " * 59 + "w") for i in range(8)]
    df = spark.createDataFrame(rows, "shard string, i bigint, text string")
    out = pk.pack_sequences(df, ["shard"], ["i"]).orderBy("seq_no").collect()
    assert [r["n_words"] for r in out] == [60] * 7
    two = df.unionByName(df.withColumn("shard", F.lit("t")))
    out = pk.pack_sequences(two, ["shard"], ["i"], max_sequences=9).collect()
    assert sorted((r["shard"], r["seq_no"]) for r in out) == [("s", k) for k in range(7)] + [("t", 0), ("t", 1)]


def test_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "run_name string, h bigint")
    new = spark.createDataFrame([("b", 9, 1), ("b", 3, 2), ("c", 5, 1)], "run_name string, h bigint, at int")
    assert sorted(map(tuple, ru.upsert_run_map(old, new, order=["at"]).collect())) == [("a", 1), ("b", 3), ("c", 5)]


def test_one_row_per_group(spark):
    df = spark.range(25_000).select(F.lit("g").alias("g"), F.col("id").alias("i"), F.col("id").cast("string").alias("gloss"))
    out = gr.concat_text(df, ["g"], ["i"], ".").collect()
    assert len(out) == 1 and out[0]["gloss"] == ".".join(map(str, range(25_000))) and out[0]["part_no"] == 0


def test_repeated_vocabulary_words(spark, tmp_path):
    (tmp_path / "v.csv").write_text("word,frequency\ncat,1\ncat,7\ndog,2\n")
    got = rd.read_vocab(spark, str(tmp_path / "v.csv"), schema="word string, frequency bigint").collect()
    assert sorted(map(tuple, got)) == [("cat", 7), ("dog", 2)]


@pytest.mark.parametrize("most", [4_000_000, 0])
def test_word_lists_beyond_the_inline_bound(spark, monkeypatch, most):
    """Broadcast or joined: the same rows; a broadcast list sends no token through a shuffle."""
    monkeypatch.setattr(vo, "SET_WORDS", most)
    texts = ["The cat sat-on http://x/1 the 12 cats", None, "", "dog  the\tcat\ncat", "the cat the", "the cat the", " ".join(["the cat emu"] * 70)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(4, "the cat the")], "doc_id bigint, text string")
    vocab = spark.createDataFrame([("the",), ("cat",), ("cat",), (None,)], "word string")
    english = spark.createDataFrame([("the",), ("cat",), ("sat",), ("dog",)], "word string")
    lower = docs.select("doc_id", F.lower("text").alias("text"))
    for listed in (None, english):
        want, got = ([
            sorted(map(str, cu.vocab_hits(docs, ["doc_id"], tx.word_tokens("text"), vocab, inline, english_vocab=listed).collect())),
            sorted(map(str, cu.filter_limited_vocab(cu.to_spans(lower), ["doc_id", "start"], vocab, min_tokens=2, english_vocab=listed, inline=inline).collect())),
            sorted(map(str, cu.limited_vocab_spans(docs, vocab, ["doc_id"], min_tokens=2, english_vocab=listed, inline=inline).collect())),
            sorted(map(str, cu.restrict_to_english_vocab(docs, ["doc_id"], tx.word_tokens("text"), english, inline).collect())),
        ] for inline in ((20_000, 0) if most else (0, 0)))
        assert got == want and all(want)
    plan = cu.filter_limited_vocab(cu.to_spans(lower), ["doc_id", "start"], vocab, english_vocab=english, inline=0)._jdf.queryExecution().executedPlan().toString()
    assert ("Exchange" in plan) == (most == 0)
