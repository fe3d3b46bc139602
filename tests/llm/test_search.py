import math
import random
import re
from collections import Counter

import pytest

from wordloom.llm import search as se

DOCS, ITEMS = "doc_id bigint, text string", "item_id string, text string"


def cut(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, top):
    counts = [(d, Counter(cut(t))) for d, t in docs]
    full = [c for _, c in counts if c]
    n_docs, n_terms = len(full), sum(sum(c.values()) for c in full)
    df = Counter(t for c in full for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            n = sum(c.values())
            if not n:
                continue
            m = 75 + (25 * n * n_docs) // n_terms
            score = 0
            for t in cut(text):
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        scored.sort()
        out += [(item, rank, d, -s) for rank, (s, _, _, d) in enumerate(scored[:top], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **options):
    df = spark.createDataFrame(docs, DOCS).repartition(5).selectExpr("*", "1 AS term", "'x' AS n", "2 AS score")
    asked = spark.createDataFrame(items, ITEMS).selectExpr("*", "3 AS item", "4 AS rank")
    return sorted((tuple(r) for r in se.search(df, asked, **options).select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("postings", [500_000, 12])
def test_equal_to_brute_force(spark, postings):
    rng = random.Random(3)
    words = ["the", "The", "é1", "x" * 30, "rare", "a9"] + [f"w{k}" for k in range(60)]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", "-", "\n", "\x00", "_")) for _ in range(n))
    docs = [(k, text(rng.randrange(40))) for k in range(300)]
    docs += [(1000 + k, "the rare w1 w2") for k in range(60)]  # a group of copies: ties
    docs += [(7, None), (8, ""), (None, "rare w3"), (None, "rare w3"), (5, "w4 " * 50_000), (1001, "the rare w1 w2")]
    items = [(f"i{k}", text(rng.randrange(1, 12))) for k in range(9)] + [("i0", "rare rare W1"), ("none", None), ("empty", " - "), (None, "w3"), ("new", "unseen")]
    assert found(spark, docs, items, top=7, postings=postings) == brute(docs, items, 7)


def test_heaps_and_ties(spark):
    docs = [(k, f"w{k % 5} w{k % 3} w1") for k in range(200)]
    items = [(f"i{k}", f"w{k} w1 w{k + 1}") for k in range(6)]
    assert found(spark, docs, items, top=20) == brute(docs, items, 20)
    index = se._Index([t.encode() for _, t in items])
    heaps = se._Heaps(index.items, 3)
    import numpy as np

    for k in range(50):
        heaps.offer([k], np.array([[k % 7] * index.items], float))
    assert all(sorted(h, reverse=True) == [(6, -6), (6, -13), (6, -20)] for h in heaps.heaps)


def test_empty_tables(spark):
    assert found(spark, [], [("a", "b")]) == []
    assert found(spark, [(1, "b")], []) == []
    assert found(spark, [(1, None), (2, "")], [("a", "b")]) == []
