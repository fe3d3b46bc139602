import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import simhash as sh


def brute_print(t):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate({9: 32, 10: 32, 11: 32, 12: 32, 13: 32}).split(" ")
    w = [x for x in w if x]
    s = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(x.encode(), 42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(values):
    label = list(range(len(values)))
    a = np.array(values, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 2):
            x, y = label[i], label[j]
            if x != y:
                label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_trie_join_finds_all_pairs():
    rng = random.Random(2)
    for n, bits in ((0, 64), (1, 64), (200, 10), (300, 64), (400, 12)):
        spread = rng.sample(range(64), min(bits, 64))
        seen = sorted({(g, sum(rng.getrandbits(1) << b for b in spread)) for g in range(3) for _ in range(n // 3 + (n == 1))})
        groups, values = np.array([g for g, _ in seen], np.int64), np.array([v for _, v in seen], np.uint64)
        i, j = sh.trie_pairs(groups, values)
        want = {(x, y) for x in range(len(seen)) for y in range(x + 1, len(seen)) if groups[x] == groups[y] and (int(values[x]) ^ int(values[y])).bit_count() <= 2}
        assert len(i) == len(want) and set(zip(i.tolist(), j.tolist())) == want


def test_hot_sets_are_dealt_out_again(spark):
    rng = random.Random(6)
    base = rng.getrandbits(64)
    near = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(400)}
    far = {rng.getrandbits(64) for _ in range(300)}
    values = sorted(near | far | {0, 3, (1 << 63) | 1, 2**64 - 1})
    signed = np.array(values, np.uint64).view(np.int64).tolist()
    links = sh.near_links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), bucket=16)
    rows = [tuple(r) for r in links.collect()]
    index = {v: k for k, v in enumerate(signed)}
    label = sh.first_of_class(len(values), np.array([index[a] for a, _ in rows]), np.array([index[b] for _, b in rows]))
    assert label.tolist() == brute_classes(values)


def test_documents_match_brute_force(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta"]
    texts = [None, "", " \t\n", "one", "One two", "a b\x0bc\x1cd", "w " * 30_000]
    for _ in range(25):
        w = rng.choices(words, k=rng.randint(3, 400))
        texts += [" ".join(w), " ".join(w).upper(), " ".join(w + ["tail"])]
    rows = [(k, t, 1) for k, t in enumerate(texts)] + [(None, "one", 1), (0, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Fp int").repartition(3)
    got = [(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in sh.near_duplicates(docs).collect()]
    values = [brute_print(t) for _, t, _ in rows]
    label = brute_classes(values)
    first = {}
    for (d, *_), lb in zip(rows, label):
        first[lb] = d if first.get(lb) is None else min(first[lb], d if d is not None else first[lb])
    assert sorted(got, key=repr) == sorted([(d, v, first[lb]) for (d, *_), v, lb in zip(rows, values, label)], key=repr)
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted([*set(first.values()), 0])
    assert sh.near_duplicates(docs.limit(0)).count() == 0 == sh.keep_one(docs.limit(0)).count()
    assert kept.agg(F.count("*")).first()[0] == len(set(first.values())) + 1
