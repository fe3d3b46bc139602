import re

import pytest
from pyspark.sql import functions as F

from wordloom.llm import decontam as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, bench):
    items = [(i, WORD.findall(low(t))) for i, t in bench]
    wins = {(i, tuple(w[k : k + min(13, len(w))])) for i, w in items if w for k in range(len(w) - min(13, len(w)) + 1)}
    out = []
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, found = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
        out.append((d, len(w), len(hit), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


PASSAGE = " ".join(f"w{k}" for k in range(30))
BENCH = [(1, PASSAGE), (2, "short item here"), (3, None), (4, ""), (5, "..."), (12, "Short, ITEM here"), (7, "É été " + PASSAGE[:40])]
DOCS = [
    (1, "intro " + PASSAGE.upper() + " end"), (2, " ".join(f"w{k}" for k in range(12))), (3, None), (4, ""), (5, "...!"),
    (6, "a short-item\nhere; short item here " + "x " * 500), (6, "a short-item\nhere; short item here " + "x " * 500),
    (8, "W3 " + " ".join(f"w{k}" for k in range(3, 17)) + " W3"), (9, "y " * 30000 + PASSAGE), (None, "Short item here"), (11, "é été " + PASSAGE),
]


@pytest.mark.parametrize("most", [dc.MAX_WINDOWS, 3])
def test_both_ways_match_brute_force(spark, most):
    docs = spark.createDataFrame([(d, t, "extra", 1) for d, t in DOCS], "doc_id bigint, text string, n_hit string, SPANS int")
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    scanned = dc.scan(docs, bench, max_windows=most)
    assert sorted(c.lower() for c in scanned.columns) == sorted(["doc_id", "text", "n_words", "n_hit", "spans", "contaminated"])
    got = dc.items_of(scanned, bench).select("doc_id", "n_words", "n_hit", F.array_join("items", ","), "contaminated").collect()
    assert sorted(map(tuple, got), key=repr) == brute(DOCS, BENCH)


def test_removal_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a, b short item here! c", "x"), (2, "clean text", "y"), (3, None, "z")], "doc_id bigint, text string, w string")
    bench = spark.createDataFrame(BENCH, "item_id bigint, text string")
    assert [tuple(r) for r in dc.without_spans(docs, bench).orderBy("doc_id").collect()] == [(1, "a, b! c", "x"), (2, "clean text", "y"), (3, None, "z")]
    assert dc.without_spans(docs, bench).columns == docs.columns == dc.without_documents(docs, bench).columns
    assert [r[0] for r in dc.without_documents(docs, bench).orderBy("doc_id").collect()] == [2, 3]
    assert dc.without_documents(docs, bench.limit(0)).count() == 3
    assert dc.items_of(dc.scan(docs.limit(0), bench), bench).count() == 0
