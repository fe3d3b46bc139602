import random

import pytest
from pyspark.sql import functions as F

from wordloom.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def texts():
    rng = random.Random(1)
    out = [None, "", "  \n", "a", "<|endoftext|>hi<|startoftext|>", "<|ENDOFTEXT|> <|endoftext|", "ΑΣ ΟΔΟΣ İstanbul ǅ", "été \x1c x\x85y z", "it's I'LL don't 'S 'ſ",
           "123 ４５ ⅷ ²", "x" * 5000, "ab" * 3000, "🙂🙂 日本語 ‍\x00", "antidisestablishmentarianism", "http://www.example.com/a?b=c&d=%20", "ﬁ ŉ K Å Ω"]
    letters = "abcdefghijklmnopqrstuvwxyz'0123 .éß\x1d"
    return out + ["".join(rng.choices(letters, k=300)) for _ in range(60)]


def test_ids_and_text_are_those_of_the_library(spark):
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    rows = [(i, t, "e") for i, t in enumerate(texts())] + [(1, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, IDS string").repartition(3)
    out = bpe.encode_documents(docs, bpe.default_path())
    assert sorted(out.columns) == ["decoded", "doc_id", "ids", "text"]
    got = out.withColumn("again", bpe.decode(F.col("ids"), bpe.default_path())).collect()
    assert len(got) == len(rows)
    for r in got:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want, r["text"]
        assert r["decoded"] == r["again"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_documents(docs.limit(0), bpe.default_path()).count() == 0


def test_long_word_heap_and_matrix_agree():
    own = bpe.vocabulary(bpe.default_path())
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdethin", k=rng.randint(1, 48))) for _ in range(300)]
    import numpy as np

    symbols = [np.array([*w.encode()[:-1], w.encode()[-1] + 256]) for w in words]
    assert own.exact_all(symbols) == [own.exact(s.tolist()) for s in symbols] == own.tokens(words)


def test_small_cache_forgets_nothing_needed(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    own = bpe.Speculative(bpe.default_path())
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    for t in ["one two three four", "two five", "six two seven eight nine", "one"]:
        assert own.encode([t])[0][0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_every_code_point_as_in_the_library():
    """Each code point between letters, also those newer than Python's tables."""
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    own = bpe.Speculative(bpe.default_path())
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 100_000):
        cases = [f"aB{chr(c)}Ce\u0301" for c in points[at : at + 100_000]]
        want = library.encode_batch(cases, add_special_tokens=False)
        got, _ = own.encode(cases)
        wrong = [case for case, ids, w in zip(cases, got, want) if ids.tolist() != w.ids]
        assert not wrong, (len(wrong), wrong[:5])


def test_texts_with_newer_code_points():
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    own = bpe.Speculative(bpe.default_path())
    rng = random.Random(3)
    letters = "aBz '\u0301.9\u1c89\ua7cb\u0c5c\U00010940\U0001e5ee"
    for t in ("".join(rng.choices(letters, k=40)) for _ in range(500)):
        ids, decoded = own.encode([t])
        want = library.encode(t, add_special_tokens=False).ids
        assert ids[0].tolist() == want, t
        assert decoded[0] == library.decode(want, skip_special_tokens=False)
