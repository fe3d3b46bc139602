import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import literals as li, permute as pe, text as tx
from wordloom.operators import curves as cv
from wordloom.streaming import corpus as st
from wordloom.sources import readers as rd
from wordloom.operators.sample import sample_n, sample_spans_per_doc


def fit(spark, x, y):
    rows = [(float(a), None if b is None else float(b)) for a, b in zip(x, y)]
    return cv.power_fit(spark.createDataFrame(rows, "x double, y double").repartition(3), "x", "y").first()


@pytest.mark.parametrize("a, b, c", [(400.0, -0.34, 1.7), (2e-3, 1.8, -4.0), (-3.0, 0.5, 100.0)])
def test_planted_curve_is_found(spark, a, b, c):
    x = np.exp(np.linspace(1, 14, 60))
    got = fit(spark, [*x, 0, -1, 5, math.nan], [*(a * x**b + c), 1, 1, None, 1])
    assert got["n"] == 60
    assert got["factor"] == pytest.approx(a, rel=1e-4)
    assert got["exponent"] == pytest.approx(b, rel=1e-4)
    assert got["offset"] == pytest.approx(c, rel=1e-3)


def test_noisy_curve_is_the_least_squares(spark):
    """No exponent of a fine local grid, with its best factor and offset, has fewer squares."""
    rng = np.random.default_rng(3)
    x = np.exp(rng.uniform(0, 9, 200))
    y = 50 * x**-0.4 + 3 + rng.normal(0, 0.5, 200)
    got = fit(spark, x, y)
    best = (math.inf, None)
    for b in np.linspace(-2, 2, 8001):
        if abs(b) > 1e-6:
            m = np.stack([x**b, np.ones(200)], 1)
            best = min(best, (((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2).sum(), b))
    assert got["rss"] <= best[0] * (1 + 1e-9)
    assert got["exponent"] == pytest.approx(best[1], abs=1e-3)
    assert got["rss"] == pytest.approx(((y - got["factor"] * x ** got["exponent"] - got["offset"]) ** 2).sum())


def test_undetermined_curves(spark):
    assert tuple(fit(spark, [], [])) == (None, None, None, None, 0)
    assert tuple(fit(spark, [1, 1, 2, 2], [1, 2, 3, 4])) == (None, None, None, None, 4)
    assert tuple(fit(spark, [1, 2, 3], [7, 7, 7])) == (0.0, 0.0, 7.0, 0.0, 3)


def test_literals_are_counted_as_one_by_one(spark):
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab é🙂"), rng.integers(0, 60))) for _ in range(80)] + [None, "", "aaaa", "who whoever Who"]
    literals = ["a", "aa", "aba", "b a", "é", "🙂b", "who", "zz", "ab ab"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    one = [tx.count_substring("text", w).alias(f"c{i}") for i, w in enumerate(literals)]
    for r in df.select("text", li.count_literals("text", literals).alias("m"), *one).collect():
        if r["text"] is None:
            assert r["m"] is None
        else:
            assert r["m"] == {w: r[f"c{i}"] for i, w in enumerate(literals) if r[f"c{i}"]}
    want = df.agg(*[F.sum(F.coalesce(tx.count_substring("text", w), F.lit(0))).alias(f"c{i}") for i, w in enumerate(literals)]).first()
    got = {r["literal"]: (r["n_occurrences"], r["n_texts"]) for r in li.literal_totals(df, literals).collect()}
    assert {w: n for w, (n, _) in got.items()} == {w: want[f"c{i}"] for i, w in enumerate(literals)}
    assert got["zz"] == (0, 0) and got["aa"][1] == sum("aa" in (t or "") for t in texts)
    assert {tuple(r) for r in li.literal_totals(df.limit(0), ["x"]).collect()} == {("x", 0, 0)}
    assert li.literal_totals(df, []).count() == 0
    for bad in (["a", "a"], [""]):
        with pytest.raises(ValueError):
            li.count_literals("text", bad)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_places_are_a_permutation(n):
    places = pe.permute(np.arange(n), n, 4)
    assert sorted(places.tolist()) == list(range(n))
    if n > 60:
        assert (places != pe.permute(np.arange(n), n, 5)).any()
        assert np.abs(np.corrcoef(places, np.arange(n))[0, 1]) < 0.3
    assert pe.permute(np.arange(2**60 - 50, 2**60), 2**60, 1).max() < 2**60


def test_split_by_place_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumn("id", F.when(F.col("id") != 499, F.col("id")))
    runs = [sorted(map(str, pe.split_by_place(df.repartition(p), "id", 499, 50, 20, 3).collect())) for p in (1, 7)]
    assert runs[0] == runs[1]
    counts = {r["split"]: r["count"] for r in pe.split_by_place(df, "id", 499, 50, 20, 3).groupBy("split").count().collect()}
    assert counts == {"test": 20, "validation": 50, "train": 429, None: 1}
    assert "Exchange" not in pe.split_by_place(spark.range(10), "id", 10, 1, 1)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("files", [1, 3])
def test_reservoir_equals_the_sample_of_all(spark, tmp_path, files):
    src, sink, marks = (str(tmp_path / n) for n in ("src", "sink", "marks"))
    schema = "doc_id bigint, source string, text string"
    for start in (0, 40):  # started again on the same checkpoint with new files
        rows = [(i, "s", "w%d " % i * (i % 7) * 40) for i in range(start, start + 40)]
        spark.createDataFrame(rows, schema).repartition(4).write.mode("append").parquet(src)
        stream = rd.stream_corpus(spark, src, schema, files_per_batch=files)
        st.stream_reservoir(stream, 3, 25, sink, marks, seed=2, total_seed=6).awaitTermination()
    want = sample_n(sample_spans_per_doc(spark.read.parquet(src), 3, seed=2), 25, ["doc_id", "start"], 6)
    key = ["doc_id", "start", "span"]
    got = st.read_reservoir(spark, sink)
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert got.count() == 25 and len(list((tmp_path / "sink").glob("version=*"))) <= 2
