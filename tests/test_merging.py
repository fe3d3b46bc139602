"""Merging on the driver against exact greedy merges and against rounds of jobs; the size of trained vocabularies."""

import os
import random
from collections import Counter

import pytest

from test_tokens import TEXTS, corpus, greedy, train
from wordloom.operators.merging import FlatPieces, replayer

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("family,likelihood", [("bpe", False), ("wordpiece", False), ("wordpiece", True)])
def test_flat_pieces_match_greedy(family, likelihood):
    start = list if family == "bpe" else lambda w: [w[0]] + ["##" + c for c in w[1:]]
    merge = lambda left, right: left + right.removeprefix("##")
    for seed in range(20):
        rng = random.Random(seed)
        words = Counter()
        for _ in range(50):
            words["".join(rng.choices("abc" if seed % 2 else "aaab", k=rng.randint(1, 14)))] += rng.randint(1, 4)
        want, table = greedy(words, start, 60, likelihood)
        got = FlatPieces([(start(w), n) for w, n in words.items()], likelihood).train(10**6, merge)[: len(want)]
        assert [m[1:3] for m in got] == want
        assert all(replayer(got)(start(w)) == table[w] for w in words)


@pytest.mark.parametrize("family", ["BPE", "ByteLevelBPE"])
def test_driver_and_jobs_give_the_same(spark, family):
    one, other = (train(corpus(spark), family, 5, local_symbols=n) for n in (10**6, 0))
    assert sorted(one.merges.collect()) == sorted(other.merges.collect())
    assert sorted(one.words.collect()) == sorted(other.words.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")
def test_queries_train_far_beyond_the_alphabet(spark):
    from __spark_entry__ import queries

    assert queries()["train_bpe"](spark, SF).count() > 5_000


def test_experiment_query_has_both_families_at_full_size(monkeypatch, spark):
    from catalog import QUERIES, storage

    seen = []
    monkeypatch.setattr(storage, "tokenizer_experiment", lambda *args: seen.append(args))
    monkeypatch.setattr(storage, "documents", lambda *args: spark.createDataFrame([("a b",)], "text string"))
    QUERIES["tokenizer_experiment"](spark, SF)
    assert {"BPE", "WordPiece"} <= set(seen[0][3]) and min(seen[0][4]) >= 30_000
