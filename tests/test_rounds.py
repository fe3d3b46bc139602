import random

import numpy as np
import pytest

from wordloom.operators import rounds, tokens as tk
from wordloom.operators.merging import FlatPieces, replayer


def local(words, room, least=1):
    merges = FlatPieces([(list(w), n) for w, n in words], False, least).train(room, lambda a, b: a + b)
    replay = replayer(merges)
    return merges, {w: replay(list(w)) for w, _ in words}


def spread(spark, words, room, **options):
    rows = [(w, n, "".join(f"{c}\x01" for c in w)) for w, n in words]
    df = spark.createDataFrame(rows, "piece string, frequency bigint, symbols string").repartition(3)
    names = sorted({c for w, _ in words for c in w})
    pieces = rounds.numbered(df, tk._split_symbols, {s: k for k, s in enumerate(names)})
    pieces, merges = rounds.train(pieces, names, room, lambda a, b: a + b, **options)
    return merges, {r["piece"]: r["tokens"] for r in rounds.named(pieces, names).collect()}


def invented(rng, letters, n, longest):
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, longest))): rng.randrange(1, 60) for _ in range(n)}.items())


@pytest.mark.parametrize("options", [{}, {"hot": 4}, {"regions": 6}, {"hot": 7, "regions": 20}, {"hot": 60, "regions": 400}])
def test_greedy_order_with_any_bounds(spark, options):
    rng = random.Random(len(options) + sum(options.values()))
    words = invented(rng, "abc", 150, 14) + [("z" * 9, 3), ("zzzzza", 2), ("q", 1000)]
    assert spread(spark, words, 40, **options) == local(words, 40)


def test_until_no_pair_is_left_and_least_frequency(spark):
    words = invented(random.Random(3), "ab", 30, 9)
    assert spread(spark, words, 10_000, hot=5) == local(words, 10_000)
    want = local(words, 10_000, 25)
    got = spread(spark, words, 10_000, min_frequency=25)
    assert got == want and 0 < len(got[0]) < 40


def test_merging_a_batch_equals_replaying_each_piece():
    """Also where a later merge makes a pair appear again, which waits for its next turn."""
    rng = random.Random(9)
    words = invented(rng, "ab", 300, 30)
    merges = [(0, "a", "b", "x"), (1, "b", "b", "a"), (2, "a", "b", "x"), (3, "x", "a", "y"), (4, "a", "a", "b"), (5, "x", "x", "z"), (6, "b", "b", "a"), (7, "a", "b", "x")]
    replay = replayer(merges)
    names = ["a", "b", "x", "y", "z"]
    steps = [tuple(names.index(s) for s in m[1:]) for m in merges]
    merger = rounds.Merger(steps)
    assert len(merger.parts) == 3
    ends = np.cumsum([0] + [len(w) for w, _ in words])
    sym = np.array([names.index(c) for w, _ in words for c in w], np.int32)
    out, ends = merger.apply(sym, ends)
    for (w, _), a, b in zip(words, ends, ends[1:]):
        assert [names[s] for s in out[a:b]] == replay(list(w))


def test_training_spread_or_on_the_driver_is_the_same(spark):
    rng = random.Random(2)
    texts = [(" ".join(rng.choice("the then there hat that chat at a née 漢字 x,y").split(" ")[0] + rng.choice(["", "s", "ed"]) for _ in range(40)),) for _ in range(50)]
    texts += [(" ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 9))) for _ in range(50)),) for _ in range(30)] + [(None,), ("",)]
    df = spark.createDataFrame(texts, "text string")
    for family in ("bpe", "wordpiece", "sentencepiece", "bytes"):
        size = 106 + (256 if family == "bytes" else 30) + 60
        near, far = (tk.train_tokenizer(df, "text", family, size, local_symbols=k) for k in (10**9, 0))
        rows = lambda d: sorted(tuple(map(str, r)) for r in d.collect())
        assert rows(near.merges) == rows(far.merges) and near.merges.count() > 10
        assert rows(near.vocab) == rows(far.vocab) and rows(near.words) == rows(far.words)


@pytest.mark.parametrize("options", [{}, {"segments": 0}, {"segments": 400}, {"segments": 1500, "hot": 12}, {"hot": 4}])
def test_stages_make_the_same_merges(spark, options):
    rng = random.Random(4)
    words = [(w, n * n) for w, n in invented(rng, "abcd", 250, 12)] + [("z" * 9, 3), ("zzzzza", 2), ("q", 1000)]
    assert spread(spark, words, 60, **options) == local(words, 60)


def test_few_jobs_where_segments_fit(spark, monkeypatch):
    calls = []
    old = rounds._regions
    monkeypatch.setattr(rounds, "_regions", lambda *a: calls.append(1) or old(*a))
    words = invented(random.Random(6), "abcde", 200, 12)
    assert spread(spark, words, 50) == local(words, 50)
    assert not calls


def test_segments_are_cut_at_rare_pairs_only():
    ends = np.array([0, 5, 5, 6, 8])
    sym = np.array([1, 2, 3, 1, 2, 1, 2, 3], np.int32)
    key = lambda a, b: a << 32 | b
    cut = rounds._Cut({key(1, 2): 9, key(2, 3): 5, key(3, 1): 2})
    found = cut.frequencies(sym, ends)
    assert found.tolist() == [9, 5, 2, 9, 0, 0, 5, 0]
    segments = lambda least: [sym[a:b].tolist() for a, b in zip(*cut.segments(found, least))]
    assert segments(2) == [[1, 2, 3, 1, 2], [2, 3]]
    assert segments(5) == [[1, 2, 3], [1, 2], [2, 3]]
    assert segments(9) == [[1, 2], [1, 2]]


@pytest.mark.parametrize("options", [{}, {"regions": 6}, {"regions": 40, "rewrite_every": 2}])
def test_likelihood_order_with_any_bounds(spark, options, monkeypatch):
    words = invented(random.Random(5), "abcde", 160, 12) + [("z" * 9, 3), ("zzzzza", 2), ("q", 1000), ("xy", 1)]
    want = FlatPieces([(list(w), n) for w, n in words], True, 1).train(60, lambda a, b: a + b)
    rows = [(w, n, "".join(f"{c}\x01" for c in w)) for w, n in words]
    df = spark.createDataFrame(rows, "piece string, frequency bigint, symbols string").repartition(3)
    names = sorted({c for w, _ in words for c in w})
    pieces = rounds.numbered(df, tk._split_symbols, {s: k for k, s in enumerate(names)})
    calls = []
    old = rounds._regions
    monkeypatch.setattr(rounds, "_regions", lambda *a: calls.append(1) or old(*a))
    pieces, merges = rounds.train_likelihood(pieces, names, 60, lambda a, b: a + b, **options)
    replay = replayer(want)
    assert merges == want and {r["piece"]: r["tokens"] for r in rounds.named(pieces, names).collect()} == {w: replay(list(w)) for w, _ in words}
    assert options or len(calls) < 10  # not a job for every merge
