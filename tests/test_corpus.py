import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import curate as cu, pack as pk, sample as sa
from wordloom.plans.corpora import unconstrained_corpus


def words(spark, *ws):
    return spark.createDataFrame([(w,) for w in ws], "word string")


def docs(spark, *texts):
    return spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")


def test_spans(spark):
    out = cu.to_spans(docs(spark, " ".join(f"w{i}" for i in range(100)), "")).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["start"], len(r["span"].split(" "))) for r in out] == [
        (0, 0, 100), (0, 30, 70), (0, 60, 40), (0, 90, 10), (1, 0, 1),
    ]
    assert out[-1]["span"] == ""


@pytest.mark.parametrize("inline", [20_000, 0])
def test_limited_vocab_bounds(spark, inline):
    texts = ["cat " * 40, "cat " * 41, "cat " * 40 + "12 dog", "cat " * 41 + "x y", "cat " * 41 + "emu"]
    out = cu.filter_limited_vocab(
        docs(spark, *texts).withColumnRenamed("text", "span"), ["doc_id"], words(spark, "cat", "dog"), inline=inline
    )
    assert {r["doc_id"]: r["n_tokens"] for r in out.collect()} == {1: 41, 3: 41}
    number = cu.filter_limited_vocab(
        docs(spark, *texts).withColumnRenamed("text", "span"), ["doc_id"], words(spark, "cat", "dog", "number"), inline=inline
    )
    assert {r["doc_id"] for r in number.collect()} == {1, 2, 3}


@pytest.mark.parametrize("listed", [None, ("cat", "dog", "emu", "well", "number")])
def test_fused_filter_equals_plain_operators(spark, listed):
    rnd = random.Random(3)
    pool = ["cat", "dog", "the", "x", "a-b", "12", "v1", "http://q.r/1", "", "a\nb", "well,", "emu", "co\u000bdo"]
    weights = [30, 30, 30, 5, 2, 1, 1, 1, 3, 2, 3, 1, 1]
    texts = [" ".join(rnd.choices(pool, weights, k=rnd.randint(0, 400))) for _ in range(60)]
    vocab = words(spark, "cat", "dog", "the", "number", "well", "hlink", "v1", "co", "do")
    english = words(spark, *listed) if listed else None
    d = docs(spark, *texts)
    spans = cu.to_spans(d.withColumn("text", F.lower("text")))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "start", "n_tokens", "span").collect()))
    want = rows(cu.filter_limited_vocab(spans, ["doc_id", "start"], vocab, english_vocab=english))
    assert want and rows(cu.limited_vocab_spans(d, vocab, ["doc_id"], english_vocab=english)) == want
    assert rows(cu.limited_vocab_spans(d, vocab, ["doc_id"], inline=0, english_vocab=english)) == want
    assert rows(cu.filter_limited_vocab(spans, ["doc_id", "start"], vocab, english_vocab=english, inline=0)) == want


def test_english_restriction_drops_tokens(spark):
    d = docs(spark, "cat " * 41 + "zzz", "cat " * 30 + "zzz " * 20).withColumnRenamed("text", "span")
    for inline in (20_000, 0):
        out = cu.filter_limited_vocab(
            d, ["doc_id"], words(spark, "cat"), english_vocab=words(spark, "cat", "emu"), inline=inline
        )
        assert [(r["doc_id"], r["n_tokens"]) for r in out.collect()] == [(0, 41)]


def test_flagship_plan_has_no_shuffle_and_no_python(spark, tmp_path):
    docs(spark, "cat dog").write.parquet(str(tmp_path / "d"))
    plan = cu.limited_vocab_spans(spark.read.parquet(str(tmp_path / "d")), words(spark, "cat"), ["doc_id"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Python" not in text and "Join" not in text


def test_dedup_keeps_smallest_id(spark):
    rows = [(i, 0, "same" if i % 3 else f"t{i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id bigint, start int, span string")
    out = {r["span"]: r["doc_id"] for r in cu.dedup_spans(df).collect()}
    assert out["same"] == 1 and len(out) == 11


@pytest.mark.parametrize("inline", [20_000, 0])
def test_features(spark, inline):
    ages = spark.createDataFrame([("cat", 1.5), ("dog", 2.5), ("dog", 3.5), ("old", 9.0)], "word string, age double")
    d = docs(spark, "cat cat dog zyx", "", "old cat")
    out = cu.featurize_docs(d, words(spark, "cat", "dog", "old"), ages, inline=inline).orderBy("doc_id").collect()
    assert tuple(out[0])[3:] == (3, 5, 5 / 3, 1, ["zyx"])
    assert tuple(out[1])[3:] == (0, 0, None, 0, [])
    assert tuple(out[2])[3:] == (2, 3, 1.5, 0, [])


def chunks_by_loop(t, drop):
    if len(t) < 50:
        return []
    if len(t) <= 110:
        return [t]
    out, cur = [], ""
    for w in t.split(" "):
        if len(cur) <= 100:
            cur += w + " "
        else:
            out.append(cur)
            cur = "" if drop else w + " "
    return out + ([cur] if cur and len(cur) >= 30 else [])


@pytest.mark.parametrize("drop", [True, False])
def test_chunk_by_chars(spark, drop):
    rnd = random.Random(1)
    texts = [" ".join("w" * rnd.randint(0, 9) for _ in range(n)) for n in (0, 5, 12, 20, 30, 200)]
    out = cu.chunk_by_chars(docs(spark, *texts), drop_boundary_word=drop).orderBy("doc_id", "part_no").collect()
    got = {}
    for r in out:
        got.setdefault(r["doc_id"], []).append(r["chunk"])
    assert got == {i: c for i, t in enumerate(texts) if (c := chunks_by_loop(t, drop))}


def test_sentences_and_paragraphs(spark):
    d = docs(spark, "One. Two! Three?  Four", "p\n\nq")
    assert [r["part"] for r in cu.to_sentences(d).where("doc_id = 0").orderBy("part_no").collect()] == ["One.", "Two!", "Three?", "Four"]
    assert [r["part"] for r in cu.to_paragraphs(d).where("doc_id = 1").orderBy("part_no").collect()] == ["p", "q"]


# --- packing -----------------------------------------------------------------------------
def pack_by_loop(counts, emit_last, skip_empty):
    out, cur, n = [], [], 0
    for i, c in enumerate(counts):
        if (n + c + 1) * 1.2 >= 128:
            out.append(cur)
            cur, n = [i], c
        else:
            cur, n = cur + [i], n + c
    if emit_last:
        out.append(cur)
    return [s for s in out if s or not skip_empty]


def pack(spark, counts, parts=3, **kw):
    rows = [(i, " ".join([f"t{i}"] * c)) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "i bigint, text string").repartition(parts)
    out = pk.pack_sequences(df, [], ["i"], **kw).orderBy("seq_no").collect()
    assert [r["seq_no"] for r in out] == list(range(len(out)))
    return [list(dict.fromkeys(int(w[1:]) for w in r["text"].split())) for r in out]


@pytest.mark.parametrize("counts", [[50, 50, 20, 110], [105, 1], [104, 1], [110, 110, 110], [1] * 300, [106], [200, 1, 1]])
def test_pack_modes(spark, counts):
    for emit_last in (True, False):
        for skip_empty in (True, False):
            want = pack_by_loop(counts, emit_last, skip_empty)
            assert pack(spark, counts, emit_last=emit_last, skip_empty=skip_empty) == want


def test_pack_one_large_shard_over_many_partitions(spark):
    rnd = random.Random(5)
    counts = [rnd.choice([1, 3, 20, 50, 104, 130]) for _ in range(3000)]
    assert pack(spark, counts, parts=8) == pack_by_loop(counts, True, True)


def test_pack_keeps_every_text(spark):
    rows = [(s, i, f"a{s}_{i} b c") for s in range(4) for i in range(400 if s == 1 else 7)]
    df = spark.createDataFrame(rows, "shard int, i int, text string")
    out = pk.pack_sequences(df, ["shard"], ["i"]).orderBy("shard", "seq_no").collect()
    assert "".join(r["text"] for r in out) == "".join(t + " " for _, _, t in sorted(rows))
    assert max(r["n_words"] for r in out) <= 105


# --- samples ----------------------------------------------------------------------------------
def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "doc_id")


def test_sample_is_exact_and_independent_of_partitions(spark):
    a = {r[0] for r in sa.sample_n(ids(spark, 5000), 777, ["doc_id"], 1).collect()}
    b = {r[0] for r in sa.sample_n(ids(spark, 5000).repartition(13), 777, ["doc_id"], 1).collect()}
    assert len(a) == 777 and a == b
    assert sa.sample_n(ids(spark, 5), 10, ["doc_id"]).count() == 5
    assert sa.sample_n(ids(spark, 5), 0, ["doc_id"]).count() == 0


def test_quota_with_one_hot_source(spark):
    df = ids(spark, 6000).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))))
    quotas = spark.createDataFrame([("hot", 1500), ("s1", 10), ("s2", 10_000), ("s3", 0)], "source string, quota int")
    out = {r["source"]: r["count"] for r in sa.quota_per_source(df, quotas, ["doc_id"]).groupBy("source").count().collect()}
    total = {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    assert out == {"hot": 1500, "s1": 10, "s2": total["s2"]}


def test_split_is_a_partition(spark):
    out = {r["split"]: r["count"] for r in sa.split_tail(ids(spark, 3000), ["doc_id"], 300, 200).groupBy("split").count().collect()}
    assert out == {"train": 2500, "validation": 300, "test": 200}
    frac = {r["split"]: r["count"] for r in sa.split_fraction(ids(spark, 1000), ["doc_id"], 0.04).groupBy("split").count().collect()}
    assert frac == {"train": 960, "validation": 20, "test": 20}


def test_sample_spans_per_doc(spark):
    d = docs(spark, " ".join(f"w{i}" for i in range(500)), "one two", "")
    out = sa.sample_spans_per_doc(d, 4).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in out} == {0: 4, 1: 1, 2: 1}
    assert sa.spans_per_doc() == 3 and sa.spans_per_doc(30_000_000, 9_000_000) == 4


def test_dev_split_and_select_split(spark):
    df = spark.createDataFrame([("1", "2"), ("3", "4")], "id1 string, id2 string")
    out = sa.dev_split_by_ids(df, df.where("id1 = '3'"), ["id1", "id2"])
    assert {(r["id1"], r["split"]) for r in out.collect()} == {("1", "train"), ("3", "dev")}
    assert sa.select_split(out, "validation", ["dev"]).first()["id1"] == "3"


def test_debug_subset_repeats_the_sample(spark):
    out = sa.debug_subset(ids(spark, 50), 5, ["doc_id"]).collect()
    by = {s: {r["doc_id"] for r in out if r["split"] == s} for s in ("train", "validation", "test")}
    assert len(by["train"]) == 5 and by["train"] == by["validation"] == by["test"]


def test_unconstrained_plan(spark):
    d = docs(spark, *[" ".join(f"d{i}w{j}" for j in range(60)) for i in range(40)])
    quotas = spark.createDataFrame([("s", 50)], "source string, quota int")
    out = unconstrained_corpus(d, quotas, 3, 5, 4)
    got = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert got["validation"] == 5 and got["test"] == 4 and got["train"] > 10
