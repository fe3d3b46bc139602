import itertools
import math
import random

import pytest

from wordloom.operators import tokens as tk, unigram as un
from wordloom.sources import models


def cuts(piece, scores, unknown):
    """Every cut of the piece with its log-probability."""
    n = len(piece)
    for bars in itertools.product((0, 1), repeat=max(0, n - 1)):
        ends = [i + 1 for i, b in enumerate(bars) if b] + [n]
        parts = [piece[a:b] for a, b in zip([0, *ends], ends)] if n else []
        if all(p in scores or len(p) == 1 for p in parts):
            yield parts, sum(scores.get(p, unknown) for p in parts)


SCORES = {"a": -2.0, "b": -2.5, "ab": -2.2, "ba": -3.0, "aba": -3.3, "bb": -4.0, "abab": -9.0}


def test_expected_counts_and_best_cut_equal_all_cuts():
    rng = random.Random(1)
    unknown = un.penalty(SCORES)
    for piece in [""] + ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(60)]:
        every = list(cuts(piece, SCORES, unknown))
        total = math.log(sum(math.exp(s) for _, s in every))
        want = {}
        for parts, s in every:
            for p in parts:
                if p in SCORES:
                    want[p] = want.get(p, 0) + math.exp(s - total)
        got_total, got = un.expected(piece, SCORES, unknown)
        assert math.isclose(got_total, total, abs_tol=1e-9)
        assert got.keys() == want.keys() and all(math.isclose(got[t], want[t], rel_tol=1e-9) for t in want)
        score, cut = un.best_cut(piece, SCORES, unknown)
        assert math.isclose(score, max(s for _, s in every), abs_tol=1e-9)
        assert "".join(t or "?" for t in cut) == "".join(c if c in "ab" else "?" for c in piece)


def test_long_piece_and_forbidden_token():
    score, cut = un.best_cut("ab" * 5000, SCORES, un.penalty(SCORES))
    assert "".join(cut) == "ab" * 5000 and math.isfinite(un.expected("ab" * 5000, SCORES, -20.0)[0])
    assert un.best_cut("aba", SCORES, -20.0, without="aba")[1] in (["a", "ba"], ["ab", "a"])


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    stems, ends = ["walk", "talk", "jump", "read", "play"], ["", "ed", "ing", "er", "s"]
    texts = [" ".join(rng.choice(stems) + rng.choice(ends) for _ in range(30)) for _ in range(60)] + [None, "", "é漢"]
    return spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)


def test_likelihood_never_falls_and_equals_all_cuts(spark, corpus):
    pieces = tk.pretokenize(corpus, "text", "unigram")
    single, longer = un.seeds(pieces, 60)
    rows = pieces.collect()
    brute = {}
    for r in rows:
        for a in range(len(r["piece"])):
            for b in range(a + 1, min(len(r["piece"]), a + un.LONGEST) + 1):
                brute[r["piece"][a:b]] = brute.get(r["piece"][a:b], 0) + r["frequency"]
    assert dict(single) == {t: n for t, n in brute.items() if len(t) == 1}
    want = sorted(((t, n) for t, n in brute.items() if len(t) > 1 and n > 1), key=lambda x: (-x[1] * len(x[0]), x[0]))
    assert longer == want[:60]
    total = sum(n for _, n in single + longer)
    scores = {t: math.log(n / total) for t, n in single + longer}
    seen = []
    for _ in range(4):
        now = sum(r["frequency"] * math.log(sum(math.exp(s) for _, s in cuts(r["piece"], scores, un.penalty(scores)))) for r in rows)
        scores, before = un.maximise(pieces, scores)
        assert math.isclose(now, before, rel_tol=1e-9)
        seen.append(before)
    assert seen == sorted(seen)


def test_train_save_read_encode(spark, corpus, tmp_path):
    model = tk.train_tokenizer(corpus, "text", "t5-base", 106 + 40)
    assert model.family == "unigram" and model.vocab.count() == 106 + 40
    tokens = {r["piece"]: r["tokens"] for r in model.words.collect()}
    assert all("".join(t) == p for p, t in tokens.items())
    assert sum(len(tokens["▁" + w]) for w in ("walking", "jumped", "reads", "talker")) <= 9
    path = str(tmp_path / "models")
    assert models.write_subwords(model, path) == 1
    again = models.read_subwords(spark, path)
    df = spark.createDataFrame([("walking jumped xyz",), (None,), ("",)], "text string")
    ids = lambda m: [r["input_ids"] for r in tk.encode_text(df, m, max_len=24).collect()]
    assert ids(model) == ids(again)
    assert 4 in ids(again)[0]  # an unknown character


def test_versions_of_saved_vocabularies(spark, corpus, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(LookupError):
        models.read_subwords(spark, path)
    big = tk.train_tokenizer(corpus, "text", "bpe", 106 + 60)
    small = tk.train_tokenizer(corpus, "text", "bpe", 106 + 35)
    assert (models.write_subwords(small, path), models.write_subwords(big, path)) == (1, 2)
    # a writer that failed: tables, but no commit
    big.vocab.write.parquet(f"{path}/left-behind/vocab")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(models.read_subwords(spark, path).merges) == rows(big.merges)
    first = models.read_subwords(spark, path, 1)
    assert rows(first.merges) == rows(small.merges) and rows(first.vocab.select("token", "id")) == rows(small.vocab.select("token", "id"))
    assert [r["version"] for r in models.versions(spark, path).orderBy("version").collect()] == [1, 2]
    with pytest.raises(LookupError):
        models.read_subwords(spark, path, 3)
    cut = tk.cut_to(big, 106 + 35)
    assert rows(cut.merges) == rows(small.merges) and rows(cut.vocab) == rows(small.vocab)
    assert {r["piece"]: r["tokens"] for r in cut.words.collect()} == {r["piece"]: r["tokens"] for r in small.words.collect()}


def test_empty_corpus(spark):
    model = tk.train_tokenizer(spark.createDataFrame([], "text string"), "text", "unigram", 200)
    assert model.vocab.count() == 106 and model.words.count() == 0


def test_pieces_side_by_side_equal_each_alone():
    rng = random.Random(2)
    scores = {**SCORES, "é漢": -3.0, "😀": -4.0}
    unknown, lattice = un.penalty(scores), un.Lattice(scores)
    pieces = ["".join(rng.choice("abcé漢😀") for _ in range(rng.randrange(40))) for _ in range(500)] + ["ab" * 400, ""]
    assert lattice.cut(pieces) == [un.best_cut(p, scores, unknown)[1] for p in pieces]
    total, piece, token, value = lattice.expected(pieces)
    found = [{} for _ in pieces]
    for k, t, v in zip(piece.tolist(), token.tolist(), value.tolist()):
        found[k][lattice.tokens[t]] = v
    assert list(zip(total.tolist(), found)) == [un.expected(p, scores, unknown) for p in pieces]  # to the last bit
    longer = [t for t in scores if len(t) > 1]
    assert lattice.best(longer, whole=False)[0].tolist() == [un.best_cut(t, scores, unknown, without=t)[0] for t in longer]


def test_sums_with_very_long_pieces_between_short_ones(spark):
    rows = [("ab" * 3, 2), ("abba" * 40, 3), ("", 1), ("bca", 5), ("b" * 70, 1), ("a", 4)]
    pieces = spark.createDataFrame(rows, "piece string, frequency bigint").coalesce(1)
    sums = un._over_pieces(pieces, SCORES, un._expectations)
    every = [(n, un.expected(p, SCORES, un.penalty(SCORES))) for p, n in rows]
    assert math.isclose(sums.pop(None), sum(n * total for n, (total, _) in every), rel_tol=1e-12)
    assert sums.keys() == {t for _, (_, counts) in every for t in counts}
    assert all(math.isclose(v, sum(n * c.get(t, 0.0) for n, (_, c) in every), rel_tol=1e-12) for t, v in sums.items())


@pytest.mark.parametrize("most", [1, 7, 40, 300, 5_000])
def test_seeds_of_all_lengths_equal_all_substrings(spark, most):
    rng = random.Random(most)
    parts = ["ab", "cde", "fgh漢", "😀x", "longerpart", "z"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(150)] + ["q" * 30, ""]
    rows = [(w, rng.randrange(1, 9)) for w in sorted(set(words))]
    brute = {}
    for w, n in rows:
        for a in range(len(w)):
            for b in range(a + 1, min(len(w), a + un.LONGEST) + 1):
                brute[w[a:b]] = brute.get(w[a:b], 0) + n
    single, longer = un.seeds(spark.createDataFrame(rows, "piece string, frequency bigint").repartition(3), most)
    assert dict(single) == {t: n for t, n in brute.items() if len(t) == 1}
    assert longer == sorted(((t, n) for t, n in brute.items() if len(t) > 1 and n > 1), key=lambda x: (-x[1] * len(x[0]), x[0]))[:most]


def test_seeds_make_only_frequent_parts_longer(spark, monkeypatch):
    sizes = []
    grams = un._grams
    monkeypatch.setattr(un, "_grams", lambda pieces, parts, longest: sizes.append((longest, len(parts))) or grams(pieces, parts, longest))
    rng = random.Random(5)
    rows = [("common" * 3, 10_000)] + [("".join(rng.choice("abcdefgh") for _ in range(18)), 1) for _ in range(400)]
    un.seeds(spark.createDataFrame(rows, "piece string, frequency bigint"), 10)
    assert [k for k, _ in sizes] == [3, 6, 12, 16] and all(n <= 6 for k, n in sizes[1:])


def test_encoding_splits_no_piece_that_has_no_room(spark, corpus):
    model = tk.train_tokenizer(corpus, "text", "unigram", 106 + 40)
    text = " ".join(["walking", "jumps", "xé"] * 200)
    df = spark.createDataFrame([(text,), ("talks",), (None,)], "text string").coalesce(1)
    want = tk._splitter("unigram", *(lambda r, i: (r, set(i)))(*tk._tables(model)))
    ids = {r["token"]: r["id"] for r in model.vocab.collect()}
    all_ids = [ids[t] for w in text.split() for t in want("▁" + w)]
    assert tk.encode_text(df, model, max_len=20).collect()[0]["input_ids"] == [0, *all_ids[:18], 1]
    plan = tk.encode_text(df, model, max_len=20)._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan[plan.index("encode("):]
