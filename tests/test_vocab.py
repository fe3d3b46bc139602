import random

import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators import evalset as ev, grammar as gr, joins, metrics as me, ordering as od, runs as ru, vocab as vo


def test_global_position_and_running_sum_with_ties_and_a_hot_value(spark):
    rnd = random.Random(2)
    rows = [(i, 7 if i % 2 else rnd.randint(0, 50), rnd.randint(0, 9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "id bigint, k int, v bigint").repartition(7)
    assert od.ordered_layout(df, ["k", "id"]).select("_part").distinct().count() > 1
    out = od.global_running_sum(df, ["k", "id"], {"s": F.col("v")}, position="p").orderBy("p").collect()
    want, s = [], 0
    for p, (i, k, v) in enumerate(sorted(rows, key=lambda r: (r[1], r[0]))):
        s += v
        want.append((i, p, s))
    assert [(r["id"], r["p"], r["s"]) for r in out] == want


def test_running_values_against_brute_force(spark):
    """NULLs, many small groups, groups over several partitions and Arrow batches."""
    import random

    rng = random.Random(8)
    rows = [(rng.choice(["hot", "hot", *map(str, range(40))]), i, rng.choice([None, rng.randint(-9, 9)]), rng.random()) for i in range(700)]
    df = spark.createDataFrame(rows, "g string, i bigint, n int, x double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {r["i"]: r for r in od.running_by_group(df, ["g"], ["i"], {"s": ("sum", F.col("n")), "lo": ("min", F.col("x")), "hi": ("max", F.col("n"))}, position="p").collect()}
        total = {r["i"]: r["s"] for r in od.global_running_sum(df, ["i"], {"s": F.coalesce("n", F.lit(0))}).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(got) == 700
    for g in {r[0] for r in rows}:
        own = sorted(r[1:] for r in rows if r[0] == g)
        for k, (i, *_) in enumerate(own):
            ns = [n for _, n, _ in own[: k + 1] if n is not None]
            want = (k, sum(ns) if ns else None, min(x for *_, x in own[: k + 1]), max(ns) if ns else None)
            assert (got[i]["p"], got[i]["s"] if ns else None, got[i]["lo"], got[i]["hi"]) == want
    run = 0
    for _, i, n, _ in rows:
        run += n or 0
        assert total[i] == run


def test_running_values_shuffle_rows_once(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("g"))
    for out in (od.global_running_sum(df, ["id"], {"s": F.col("id")}), od.running_by_group(df, ["g"], ["id"], {"s": ("sum", F.col("id"))})):
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = plan[: plan.index("BroadcastExchange")] if "BroadcastExchange" in plan else plan
        assert "Window" not in rows and "MapInArrow" in plan and "Exchange hashpartitioning(_part" not in rows


def test_running_by_group_with_a_hot_group(spark):
    rnd = random.Random(4)
    rows = [(0 if i % 3 else i % 11, i, rnd.random()) for i in range(3000)]
    df = spark.createDataFrame(rows, "g int, i int, v double").repartition(6)
    out = od.running_by_group(df, ["g"], ["i"], {"m": ("min", F.col("v")), "s": ("sum", F.lit(1))}, position="p").collect()
    state = {}
    want = {}
    for g, i, v in sorted(rows):
        m, n = state.get(g, (2.0, 0))
        state[g] = (min(m, v), n + 1)
        want[i] = (min(m, v), n + 1, n)
    assert {r["i"]: (r["m"], r["s"], r["p"]) for r in out} == want


def test_percentiles(spark):
    row = ru.param_percentiles(spark.createDataFrame([(1,), (2,), (4,)], "v bigint"), "v").first()
    assert (row["p25"], row["p50"], row["p100"]) == (1.5, 2.0, 4.0)


def test_lookup_join_salted_equals_plain(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    table = spark.createDataFrame([("hot", 1), ("5", 2), ("zz", 3)], "k string, v int")
    for how in ("left", "inner", "left_semi"):
        plain = sorted(map(str, rows.join(table, "k", how).collect()))
        assert sorted(map(str, joins.lookup_join(rows, table, ["k"], how, ["id"], max_rows=1).collect())) == plain


def test_small_lookup_is_broadcast(spark):
    plan = joins.lookup_join(spark.range(10).withColumnRenamed("id", "k"), spark.range(3).withColumnRenamed("id", "k"), ["k"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text


def test_percent_missing(spark):
    words = spark.range(3731).select(F.col("id").cast("string").alias("word"))
    out = vo.percent_missing(words, words.where("cast(word as int) >= 561")).first()
    assert (out["n_missing"], out["n_words"]) == (561, 3731) and round(out["pct_missing"], 2) == 15.04


def test_rank_lookup(spark):
    freq = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5)], "word string, frequency bigint")
    ranked = vo.word_rank(freq)
    assert {r["word"]: r["word_rank"] for r in ranked.collect()} == {"b": 0, "a": 1, "c": 2}
    out = vo.word_rank_lookup(spark.createDataFrame([("a",), ("z",)], "word string"), ranked)
    assert {r["word"]: (r["word_rank"], r["word_rank_ref"]) for r in out.collect()} == {"a": (1, 1), "z": (None, 0)}


def test_age_windows_share_boundaries(spark):
    rows = [(f"w{i}", float(i), i) for i in range(7)]
    out = vo.age_windows(spark.createDataFrame(rows, "word string, age double, word_rank int"), step=3)
    got = {}
    for r in out.collect():
        got.setdefault((r["age_from"], r["age_to"]), set()).add(r["age"])
    assert got == {(0.0, 0.0): {0.0}, (0.0, 3.0): {0.0, 1.0, 2.0, 3.0}, (3.0, 6.0): {3.0, 4.0, 5.0, 6.0}}


def test_kl(spark):
    import math

    p = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "key string, w double")
    q = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 4.0)], "key string, w double")
    want = 0.25 * math.log(0.25 / 0.25) + 0.75 * math.log(0.75 / 0.25)
    assert abs(vo.kl_divergence(p, q).first()[0] - want) < 1e-12
    assert vo.kl_divergence(q, p).first()[0] == float("inf")


def test_trigger_rate_and_sentence_lengths(spark):
    df = spark.createDataFrame([(365, "ball all. just.")], "target_child_age int, gloss string")
    row = gr.trigger_rate(df).first()
    assert row["n_all"] == 2 and row["n_just"] == 1 and row["n_sentences"] == 3 and row["noun_initiator_rate"] == 1.0
    two = spark.createDataFrame([(1, "a b a. c"), (1, "d")], "target_child_age int, gloss string")
    assert gr.mean_sentence_length(two).first()[1] == (3 + 2 + 1) / 3
    assert gr.mean_unique_sentence_length(two).first()[1] == (2 + 2 + 1) / 3


def test_concat_in_parts(spark):
    rows = [(0 if i % 3 else 1, i, f"u{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "g int, i int, gloss string").repartition(5)
    out = gr.concat_text(df, ["g"], ["i"], ".", rows_per_part=10).orderBy("g", "part_no").collect()
    for g in (0, 1):
        assert ".".join(r["gloss"] for r in out if r["g"] == g) == ".".join(t for h, _, t in rows if h == g)


# --- evaluation sets ----------------------------------------------------------------------
def test_eval_filter_keeps_empty_examples(spark):
    df = spark.createDataFrame([(1, "1999 !"), (2, "the cat"), (3, "the emu")], "idx int, sentence string")
    vocab = spark.createDataFrame([("the",), ("cat",)], "word string")
    for inline in (20_000, 0):
        out = ev.filter_eval_examples(df, vocab, ev.TaskSpec("cola"), ["idx"], inline=inline)
        assert {r["idx"] for r in out.collect()} == {1, 2}


def test_coverage(spark):
    df = spark.createDataFrame([(1, "t", "a b c"), (2, "t", "a z c"), (3, "t", "a b c a z")], "id int, task string, text string")
    vocab = spark.createDataFrame([("a",), ("b",), ("c",)], "word string")
    row = ev.eval_coverage(df, vocab, ["id"], tx.eval_tokens("text")).first()
    assert row["complete"] == pytest.approx(1 / 3) and row["complete_or_1_missing"] == 1.0
    assert row["mostly"] == pytest.approx(2 / 3)


def test_text_columns():
    pick = lambda cols, name: ev.text_columns(cols, ev.TaskSpec(name))
    assert pick(["question", "sentence", "label"], "qnli") == ["sentence"]
    assert pick(["idx", "inputs"], "x") == ["inputs"]
    assert pick(["sentence1", "sentence2"], "rte") == ["sentence1", "sentence2"]
    assert pick(list("abcdefghijk"), "swag") == ["c", "g", "h", "i", "j"]
    assert pick(list("abcd"), "squad") == ["c", "d"] and pick(list("abc"), "copa") == ["a", "b", "c"]
    assert pick(list("abc"), "race") == ["b"] and pick(list("abc"), "other") == ["a", "b"]
    assert ev.input_columns(["premise", "hypothesis"], "mnli") == ("premise", "hypothesis")
    assert ev.input_columns(["label", "x"]) == ("x", None)


def test_strip_predictions(spark):
    df = spark.createDataFrame([(" a\n", "\tb ")], "prediction string, label string")
    assert tuple(ev.strip_predictions(df).first()) == ("a", ["b"])


def test_pad_to_batch_max(spark):
    df = spark.createDataFrame([(1, [1, 2]), (1, [3]), (2, [])], "batch int, ids array<int>")
    got = sorted((r["batch"], r["ids"]) for r in ev.pad_to_batch_max(df, "ids", "batch", 0).collect())
    assert got == [(1, [1, 2]), (1, [3, 0]), (2, [0])]


# --- metrics ----------------------------------------------------------------------------------
def test_metrics_zero_denominators(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "prediction int, label int")
    assert me.classification_metrics(df, task="cola").first()[0] == 0.0
    assert tuple(me.classification_metrics(df, task="qqp").first()) == (1.0, 0.0, 0.5)


def test_spearman_with_ties(spark):
    import pandas as pd

    rows = [(1.0, 2.0), (1.0, 3.0), (2.0, 3.0), (5.0, 1.0), (5.0, 9.0), (0.0, 9.0)]
    df = spark.createDataFrame(rows, "prediction double, label double")
    pdf = pd.DataFrame(rows, columns=["a", "b"]).rank()
    assert me.spearman(df, "prediction", "label").first()[0] == pytest.approx(pdf["a"].corr(pdf["b"]))


def test_best_checkpoint_takes_the_first(spark):
    df = spark.createDataFrame([("r", 1, 5.0), ("r", 2, 4.0), ("r", 3, 4.0)], "run_name string, step int, perplexity double")
    assert me.best_checkpoint(df).first()["step"] == 2


def test_labels(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("-1",)], "label string")
    labels = me.label_list(df.where("label <> '-1'"))
    assert {r["label"]: r["label_id"] for r in labels.collect()} == {"a": 0, "b": 1}
    assert sorted(r["label_id"] for r in me.encode_labels(df, labels).collect()) == [-1, 0, 1, 1]


def test_loss_is_a_mean_of_batch_means(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 8.0)], "batch int, loss double")
    row = me.mlm_eval_loss(df, ["batch"]).first()
    assert row["loss"] == 5.0 and row["weighted_loss"] == 4.0


def test_prediction_format(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 2.0)], "i int, p double")
    assert [tuple(r) for r in me.format_predictions(df, "i", "p", True).orderBy("index").collect()] == [(0, "2.000"), (1, "0.500")]
    logits = spark.createDataFrame([([0.1, 0.9, 0.9],)], "l array<double>")
    assert me.predict_argmax(logits, "l").first()["prediction"] == 1


def test_runs(spark):
    base = {"embedding_size": 32, "hidden_size": 32}
    grid = ru.config_grid(spark, base, {"hidden_size": [128, 64], "embedding_size": [16]}).orderBy("run_number").collect()
    assert [(r["embedding_size"], r["hidden_size"]) for r in grid] == [(32, 128), (32, 64), (16, 32)]
    old = spark.createDataFrame([("a", 1), ("b", 2)], "run_name string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 3)], "run_name string, v int")
    assert sorted(map(tuple, ru.upsert_run_map(old, new).collect())) == [("a", 1), ("b", 9), ("c", 3)]
    labels = ru.bucket_labels(spark.createDataFrame([(2_500_000,), (7_600_000,)], "v bigint"), "v").orderBy("band").collect()
    assert labels[3]["label"] == "6 < Num. par. <= 8 Mil." and labels[0]["label"].startswith("0 < ")


def test_windows_and_chunks_leave_out_null_ranks(spark):
    rows = [(f"w{k:02d}", float(k // 2), None if k % 3 == 0 else k) for k in range(20)]
    df = spark.createDataFrame(rows, "word string, age double, word_rank bigint")
    got = vo.age_windows(df, step=4)
    assert {r["word"] for r in got.collect()} == {w for w, a, k in rows if k is not None and a <= 8}
    chunks = {r["chunk_no"]: r["n_ranked"] for r in vo.vocab_chunks(df, size=5, chunks=3).collect()}
    assert chunks == {c: sum(rows[k][2] is not None for k in range(5 * c, 5 * c + 5)) for c in range(3)}
