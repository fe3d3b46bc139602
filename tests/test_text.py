import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from wordloom.functions import arrays as ar, scaling as sc, text as tx


@pytest.mark.parametrize("given_text, want", [
    ("x-y 2nd v12", "x y #NUMBER nd v12"),
    ("a 1@,@2", "a #NUMBER #NUMBER2"),
    ("see http://a.b/1 now", "see #HLINK  now"),
    ("", ""),
    ("12 34-56", "#NUMBER  #NUMBER  #NUMBER "),
])
def test_preprocess(col, given_text, want):
    assert col(tx.preprocess_text("text"), given_text) == want


def test_word_tokens(col):
    assert col(tx.word_tokens("text"), "Don't a_b café 12 x") == ["don", "a_b", "café", "12"]
    assert col(tx.word_tokens("text"), "") == []


def test_eval_tokens(col):
    assert col(tx.eval_tokens("text"), "The cat (Tom) don't run 24/7") == ["the", "cat", "dont", "run", "/"]
    assert col(tx.eval_tokens("text"), "1999 !") == []
    assert col(tx.eval_tokens("text", drop_proper=False), "a Tom") == ["a", "tom"]
    assert col(tx.eval_tokens("text"), "it 's `x` “q”") == ["it", "`x`", "q"]


def test_utterance_variants(col):
    assert col(tx.utterance_tokens("text", "A"), "A(b) c:d 12 x") == ["ab", "cd", "", "x"]
    assert col(tx.utterance_tokens("text", "B"), "A,b 'c' .") == ["a,b", "c", ""]
    assert col(tx.utterance_tokens("text", "C"), "A,b (c)") == ["ab", "(c)"]
    assert col(tx.utterance_tokens("text", "C", drop_empty=True), "a . b") == ["a", "b"]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="aB1 -,.'`\"(\n", max_size=30))
def test_variant_a_agrees_with_plain_regex(col, t):
    want = [re.sub("[,!@#$?;.'-`\"]", "", w.lower()) for w in t.split(" ")]
    assert col(tx.utterance_tokens("text", "A"), t) == want


def test_counts_and_suffixes(col):
    assert col(tx.count_words("text"), "a  b ") == 4
    assert col(tx.count_substring("text", "aa"), "aaa aa") == 2
    assert col(tx.has_word_suffix("text"), "nation") and not col(tx.has_word_suffix("text"), "cat")
    assert col(tx.remove_newlines("text"), "a\nb") == "ab"


def test_age_bin(spark):
    rows = spark.createDataFrame([(0.2,), (1.0,), (1.01,), (6.0,), (6.01,), (0.0,)], "a double")
    assert [r[0] for r in rows.select(tx.age_bin("a")).collect()] == [1, 1, 2, 6, None, None]


def test_flops_and_bands(spark):
    row = spark.range(1).select(
        sc.flops_hoffman(32, 32, 128, 2, 2).alias("f"), sc.flops_kaplan(10).alias("k"),
        sc.size_bucket(F.lit(3125122)).alias("b"), sc.config_bucket(F.lit(256)).alias("c"),
        sc.perplexity(F.lit(0.0)).alias("p"), sc.perplexity(F.lit(710.0)).alias("inf"),
    ).first()
    assert row["f"] == 959_348_736 and row["k"] == 7680 and row["b"] == "q1" and row["c"] == "q4"
    assert row["p"] == 1.0 and row["inf"] == float("inf")


def test_array_helpers(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([],)], "ids array<int>")
    got = df.select(ar.fit_array("ids", 2, 0).alias("f"), ar.pad_array("ids", 4, 9).alias("p"), ar.attention_mask("ids", 4).alias("m")).collect()
    assert got[0]["f"] == [5, 6] and got[0]["p"] == [5, 6, 7, 9] and got[0]["m"] == [1, 1, 1, 0]
    assert got[1]["f"] == [0, 0] and got[1]["m"] == [0, 0, 0, 0]


def test_instance_text(spark):
    df = spark.createDataFrame([("a", "x", "b")], "question string, other string, sentence string")
    assert df.select(tx.instance_text(df.columns, ("sentence", "question"))).first()[0] == "a b "


def test_term_counts(col):
    got = col(tx.term_counts(tx.word_tokens("text")), "dog cat dog emu cat dog")
    assert [(r["term"], r["cnt"]) for r in got] == [("cat", 2), ("dog", 3), ("emu", 1)]
    assert col(tx.term_counts(tx.word_tokens("text")), "") == []
