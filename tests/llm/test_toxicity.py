import math
import random

import numpy as np
import pytest

from wordloom.llm import toxicity as tox

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, toxic int"


def slow_ftrl(rows, size, epochs):
    """One coordinate at a time."""
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        l1 = 0 if i == size else tox.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((tox.BETA + math.sqrt(n[i])) / tox.ALPHA + tox.L2)

    for epoch in range(epochs):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            at, label = [*rows[k][0], size], rows[k][1]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for i, wi in zip(at, w):
                step = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / tox.ALPHA
                z[i] += g - step * wi
                n[i] += g * g
    return [weight(i) for i in range(size + 1)]


def test_equal_to_one_coordinate_at_a_time():
    rng = random.Random(1)
    rows = [(sorted(rng.sample(range(32), rng.randrange(9))), rng.randrange(2)) for _ in range(60)]
    fast = tox.Ftrl(32)
    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            fast.learn(np.array(rows[k][0], np.int64), rows[k][1])
    assert np.allclose(fast.weights(np.arange(33)), slow_ftrl(rows, 32, 4))


def test_coordinates():
    words = tox._Words()
    assert len(tox.coordinates(None, words)) == len(tox.coordinates("", words)) == len(tox.coordinates(" .\n", words)) == 0
    same = [sorted(tox.coordinates(t, words).tolist()) for t in ("You, CLOWN!", "you clown", " you\nclown")]
    assert same[0] == same[1] == same[2] and len(same[0]) == 3
    assert len(set(tox.coordinates("a b c d", words).tolist())) == 4 + 3 + 2 + 1
    pair = set(tox.coordinates("a b", words).tolist())
    assert pair - set(tox.coordinates("b a", words).tolist())  # order counts


def planted(rng, n):
    common = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(common) for _ in range(rng.randrange(5, 120))]
        kind = rng.randrange(6)
        if kind == 0:
            words.insert(rng.randrange(len(words)), rng.choice(("scum", "idiot")))
        elif kind == 1:  # two words that are harmless alone
            at = rng.randrange(len(words))
            words[at:at] = ["get", rng.choice(common), "lost"]
        elif kind == 2:
            words += ["get", *words[:9], "here"]
            words.insert(0, "lost")
        docs.append((k, " ".join(words)))
        labels.append((k, int(kind < 2)))
    return docs, labels


def test_held_out_accuracy_on_planted_words_and_pairs(spark):
    docs, labels = planted(random.Random(5), 3000)
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    out = tox.scored(df, tox.fit(df, marks.where("doc_id % 4 <> 2"))).where("doc_id % 4 = 2").join(marks, "doc_id").collect()
    right = {t: np.mean([r["predicted"] == t for r in out if r["toxic"] == t]) for t in (0, 1)}
    assert right[0] > 0.97 and right[1] > 0.95


def test_held_out_accuracy_on_the_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = tox.op13_toxicity(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    marks = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = out.where("held_out").join(marks, "doc_id").collect()
    assert np.mean([r["predicted"] == 0 for r in rows if r["toxic"] == 0]) > 0.99
    assert np.mean([r["predicted"] for r in rows if r["toxic"] == 1]) > 0.7


def test_nulls_repeats_clashes_and_long_texts(spark):
    docs, labels = planted(random.Random(6), 600)
    docs += [(9000, None), (9001, ""), (None, "scum"), (9002, "w1 " * 300_000 + "scum"), (9003, "w1 w2 w3"), (9003, "w1 w2 w3"), (3, "zz zz")]
    labels += [(9000, 0), (9001, None), (None, 1), (5, None), (9003, 0), (9003, 0), (77777, 1)]
    df = spark.createDataFrame([(*d, "kept", 5) for d in docs], DOCS + ", Score string, order int")
    marks = spark.createDataFrame([(*m, "x") for m in labels], LABELS + ", text string")
    out = tox.scored(df, tox.fit(df, marks))
    assert out.columns == ["doc_id", "text", "order", "score", "predicted"]
    rows = out.collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[9000][0]["score"] == by[9001][0]["score"] < 0.3
    assert by[None][0]["predicted"] == 1 and by[9002][0]["predicted"] == 1
    assert len(by[9003]) == 2 and by[9003][0]["score"] == by[9003][1]["score"]


def test_bounded_sample_and_empty_tables(spark):
    docs, labels = planted(random.Random(7), 300)
    df, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert 0 < len(tox.fit(df, marks, sample=200).at) < 2000
    nothing = tox.fit(df, spark.createDataFrame([], LABELS))
    assert [r["score"] for r in tox.scored(df, nothing).collect()] == [0.0] * 300
    model = tox.fit(df, marks, sample=200)
    assert tox.scored(spark.createDataFrame([], DOCS), model).count() == 0
    assert tox.fit(spark.createDataFrame([], DOCS), marks).bias == -math.inf


@pytest.mark.parametrize("partitions", [1, 7])
def test_same_model_over_any_partitions(spark, partitions):
    docs, labels = planted(random.Random(8), 200)
    df, marks = spark.createDataFrame(docs, DOCS).repartition(partitions), spark.createDataFrame(labels, LABELS)
    model = tox.fit(df, marks)
    want = tox.fit(spark.createDataFrame(docs, DOCS).repartition(3), marks)
    assert model.at.tolist() == want.at.tolist() and np.allclose(model.weight, want.weight)
