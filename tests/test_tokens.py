import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import tokens as tk
from wordloom.plans.tokenizer_experiment import tokenizer_experiment

TEXTS = ["low lower lowest", "new newer newest, new!", "wide wider widest widest aaaa", "the low tide"] * 3


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def merge(symbols, pair, joined):
    out, i = [], 0
    while i < len(symbols):
        if tuple(symbols[i : i + 2]) == pair:
            out.append(joined)
            i += 2
        else:
            out.append(symbols[i])
            i += 1
    return out


def greedy(words: Counter, start, n, likelihood):
    """Exact greedy merges over a word counter."""
    table = {w: start(w) for w in words}
    merges = []
    for _ in range(n):
        pairs, single = Counter(), Counter()
        for w, s in table.items():
            for a, b in zip(s, s[1:]):
                pairs[a, b] += words[w]
            for a in s:
                single[a] += words[w]
        if not pairs:
            break
        score = lambda p: pairs[p] / (float(single[p[0]]) * single[p[1]]) if likelihood else pairs[p]
        best = min(pairs, key=lambda p: (-score(p), p))
        joined = best[0] + (best[1].removeprefix("##"))
        merges.append(best)
        table = {w: merge(s, best, joined) for w, s in table.items()}
    return merges, table


def train(df, family, merges, **more):
    """A vocabulary with room for exactly so many merges."""
    own = tk.family_of(family)
    words = tk.pretokenize(df, "text", own)
    alphabet = 256 if own == "bytes" else words.select(F.explode(tk.symbol_array(tk.start_symbols("piece", own)))).distinct().count()
    return tk.train_tokenizer(df, "text", family, 106 + alphabet + merges, **more)


def pieces(texts):
    import re

    return Counter(p for t in texts for p in re.findall(r"\w+|[^\w\s]+", t))


def test_bpe_matches_greedy(spark):
    model = train(corpus(spark), "BPE", 9, cut_every=4)
    merges, table = greedy(pieces(TEXTS), list, 9, False)
    assert [(r["left"], r["right"]) for r in model.merges.orderBy("rank").collect()] == merges
    assert {r["piece"]: r["tokens"] for r in model.words.collect()} == table


@pytest.mark.parametrize("score", [None, "likelihood"])
def test_wordpiece_matches_greedy(spark, score):
    model = train(corpus(spark), "WordPiece", 6, score=score)
    start = lambda w: [w[0]] + ["##" + c for c in w[1:]]
    merges, table = greedy(pieces(TEXTS), start, 6, score is not None)
    assert [(r["left"], r["right"]) for r in model.merges.orderBy("rank").collect()] == merges
    assert {r["piece"]: r["tokens"] for r in model.words.collect()} == table


def test_vocabulary_ids_and_size(spark):
    alphabet = {c for w in pieces(TEXTS) for c in w}
    model = tk.train_tokenizer(corpus(spark), "text", "BPE", 106 + len(alphabet) + 5)
    rows = model.vocab.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows)))
    assert rows[0]["token"] == "<s>" and rows[6]["token"] == "<extra_id_0>" and rows[105]["token"] == "<extra_id_99>"
    assert len(rows) == 106 + len(alphabet) + 5


@pytest.mark.parametrize("family", ["BPE", "SentencePiece", "ByteLevelBPE", "WordPiece"])
def test_encoding_agrees_with_training(spark, family):
    texts = TEXTS + ["naïve café wide 12"]
    model = train(corpus(spark, texts), family, 6)
    if family == "WordPiece":  # longest match first need not follow the merges
        words = tk.encode_words(spark.createDataFrame([("zzz",), ("low",)], "word string"), model)
        got = {r["word"]: r["tokens"] for r in words.collect()}
        assert got["zzz"] == ["<unk>"] and "".join(t.removeprefix("##") for t in got["low"]) == "low"
        return
    split = tk.token_splitter(model)
    got = model.words.select("piece", "tokens", split(F.array("piece")).alias("again")).collect()
    assert got and all(r["tokens"] == r["again"] for r in got)


def test_special_characters_survive_merging(spark):
    texts = ["$1 $1 $1 a\\b a\\b (x) (x) [.] [.] ^^ ||"] * 2
    model = train(corpus(spark, texts), "BPE", 8)
    assert all("".join(r["tokens"]) == r["piece"] for r in model.words.collect())


def test_rounds_of_several_merges_keep_the_order(spark):
    """Pairs far apart in count and without common symbols are merged in one round."""
    text = "ab " * 90 + "cd " * 70 + "ef " * 50 + "abcd " * 3 + "aab bab " * 5 + "gggg " * 20
    model = train(corpus(spark, [text]), "BPE", 7)
    merges, table = greedy(pieces([text]), list, 7, False)
    assert [(r["left"], r["right"]) for r in model.merges.orderBy("rank").collect()] == merges
    assert {r["piece"]: r["tokens"] for r in model.words.collect()} == table


def test_byte_family_knows_every_byte(spark):
    model = train(corpus(spark, ["low lower lowest"]), "ByteLevelBPE", 2)
    tokens = tk.encode_words(spark.createDataFrame([("zebra",)], "word string"), model).first()["tokens"]
    assert "<unk>" not in tokens and bytes.fromhex("".join(tokens)) == b"zebra"


def test_a_long_piece_is_encoded_quickly(spark):
    import time

    model = train(corpus(spark), "BPE", 4)
    ranks, ids = tk._tables(model)
    for family in ("bpe", "wordpiece"):
        start = time.time()
        tk._splitter(family, ranks, set(ids) | {"l", "##o", "##w", "##l"})("low" * 34_000)
        assert time.time() - start < 2


def test_encode_text_and_pair(spark):
    df = corpus(spark)
    model = train(df, "BPE", 5)
    out = tk.encode_text(df, model, max_len=8).collect()
    for r in out:
        ids, mask = r["input_ids"], r["attention_mask"]
        assert len(ids) == len(mask) == 8 and ids[0] == 0
        n = sum(mask)
        assert ids[n - 1] == 1 and all(i == 3 for i in ids[n:])
    pair = tk.encode_pair(df.withColumn("b", F.lit("low")), model, "text", "b", max_len=9).first()
    assert len(pair["input_ids"]) == 9 and pair["input_ids"].count(1) == 2
    loose = tk.encode_pair(df, model, "text", max_len=500, pad=None).first()
    assert len(loose["input_ids"]) == len(loose["attention_mask"]) and loose["input_ids"][-1] == 1


def test_pair_truncation_takes_from_the_longer(spark):
    df = spark.createDataFrame([("a b c d e f", "x y"), ("a b", "u v w x y z"), ("a b c d e", "u v w x y")], "p string, q string")
    model = train(df.select(F.concat_ws(" ", "p", "q").alias("text")), "BPE", 0)
    ids = {r["token"]: r["id"] for r in model.vocab.collect()}
    want = [("abcde", "xy"), ("ab", "uvwxy"), ("abc", "uvwx")]
    for r, (a, b) in zip(tk.encode_pair(df, model, "p", "q", max_len=10).collect(), want):
        assert r["input_ids"] == [0, *[ids[c] for c in a], 1, *[ids[c] for c in b], 1]


def test_masking(spark):
    df = spark.createDataFrame([(i, [5] * 60 + [3] * 4) for i in range(300)], "k int, input_ids array<int>")
    out = tk.mask_tokens(df, ["k"], p=0.15).collect()
    masked = sum(x == 2 for r in out for x in r["input_ids"])
    assert 0.12 < masked / (300 * 60) < 0.18
    for r in out:
        assert all((x == 2) == (lab == 5) for x, lab in zip(r["input_ids"][:60], r["labels"][:60]))
        assert r["input_ids"][60:] == [3] * 4 and r["labels"][60:] == [-100] * 4
    again = tk.mask_tokens(df.repartition(7), ["k"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    other = tk.mask_tokens(df, ["k"], epoch=1).collect()
    assert sorted(map(str, out)) != sorted(map(str, other))
    parity = tk.mask_tokens(df, ["k"], pad_label=3).first()
    assert parity["labels"][60:] == [3] * 4


def test_bert_masking_bands(spark):
    df = spark.createDataFrame([(i, [50_000] * 100) for i in range(300)], "k int, input_ids array<int>")
    out = tk.mask_tokens_bert(df, ["k"], vocab_size=1000, p=0.3).collect()
    hit = [(x, lab) for r in out for x, lab in zip(r["input_ids"], r["labels"]) if lab != -100]
    share = lambda cond: sum(map(cond, hit)) / len(hit)
    assert abs(share(lambda h: h[0] == 2) - 0.8) < 0.03
    assert abs(share(lambda h: h[0] == 50_000) - 0.1) < 0.03


def test_split_ratio(spark):
    encoded = spark.createDataFrame([("ab", ["a", "b"]), ("c", ["c"])], "word string, tokens array<string>")
    row = tk.tokenizer_split_ratio(spark.createDataFrame([("ab c",)], "text string"), encoded).first()
    assert tuple(row) == (3.0, 1.5, 1.5)


def test_morph_score(spark):
    parts = spark.createDataFrame([("redoing", ["re", "do", "ing"])], "word string, parts array<string>")
    enc = lambda *t: spark.createDataFrame([("redoing", list(t))], "word string, tokens array<string>")
    assert tk.morph_score(enc("re", "##do", "##ing"), parts).first()[0] == 1.0
    assert tk.morph_score(enc("redoing"), parts).first()[0] == 0.0
    assert tk.morph_score(enc(*"redoing"), parts).first()[0] == 0.0
    assert tk.morph_score(enc("▁re", "doing"), parts, strip_marks=False).first()[0] == 0.0
    assert tk.morph_score(enc("▁re", "doing"), parts).first()[0] == pytest.approx(1 / 3)


def test_experiment_rows(spark):
    df = corpus(spark)
    parts = spark.createDataFrame([("lower", ["low", "er"])], "word string, parts array<string>")
    tasks = df.select(F.lit("cola").alias("task"), "text")
    saved = []
    out = tokenizer_experiment(
        df, df, parts, ["BPE", "WordPiece"], [128], tasks, save=lambda n, m, r: saved.append(n)
    ).collect()
    assert [(r["tokenizer"], r["vocab_size"]) for r in out] == [("BPE", "128"), ("WordPiece", "128")]
    assert saved == ["BPE_128", "WordPiece_128"] and all(r["cola"] == 0.0 for r in out)


def test_a_piece_is_split_once_for_all_batches():
    import pyarrow as pa

    calls = []
    split = lambda p: calls.append(p) or list(p)
    memo = {}
    rows = pa.array([["ab", "c", "ab"], None, [], ["", "c"], ["ab"]], pa.list_(pa.string()))
    want = [["a", "b", "c", "a", "b"], [], [], ["c"], ["a", "b"]]
    assert tk._split_batch(rows, split, memo, pa.string()).to_pylist() == want
    assert tk._split_batch(rows.slice(2), split, memo, pa.string()).to_pylist() == want[2:]
    assert sorted(calls) == ["", "ab", "c"]
    assert tk._split_batch(rows.slice(1, 2), split, memo, pa.string()).to_pylist() == [[], []]


def test_experiment_encodes_examples_once_and_deals_words_out(spark):
    df = corpus(spark)
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        calls.add(1)
        return text

    parts = spark.createDataFrame([("lower", ["low", "er"]), ("unseen", ["un", "seen"])], "word string, parts array<string>")
    tasks = df.select((F.length("text") % 2).cast("string").alias("task"), counted.asNondeterministic()("text").alias("text"))
    out = tokenizer_experiment(df, df, parts, ["BPE"], [128], tasks).collect()
    assert calls.value == df.count() and len(out) == 1
    # the shared words hold those of the parts too, and the scores are those of each table alone
    model = tk.train_tokenizer(df, "text", "BPE", 128)
    words = df.select(F.explode(F.split("text", " ")).alias("word"))
    assert out[0]["manual_evaluation"] == tk.morph_score(tk.encode_words(parts, model), parts).first()[0]
    want = tk.tokenizer_split_ratio(df, tk.encode_words(words, model)).first()
    assert all(out[0][c] == pytest.approx(want[c]) for c in want.asDict())
    encoded = tk.encode_words(words, model)
    assert encoded.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_merging_side_by_side_equals_each_piece_alone():
    rng = random.Random(3)
    for family, base in (("bpe", list("abcé漢")), ("bytes", ["61", "62", "63", "C3", "A9"])):
        for _ in range(20):
            symbols, ranks = list(base), {}
            for rank in range(60):  # some symbols are made in several ways
                left, right = rng.choice(symbols), rng.choice(symbols)
                ranks.setdefault((left, right), rank)
                symbols.append(left + right)
            split = tk._splitter(family, ranks, set(symbols) - {rng.choice(symbols)})
            pieces = ["".join(rng.choice("abcé漢") for _ in range(rng.randrange(30))) for _ in range(200)] + ["abc" * 100, "a" * 50]
            assert split.many(pieces) == [split(p) for p in pieces]
    assert tk._splitter("bpe", {}, {"a"}).many(["ab", ""]) == [["a", "<unk>"], []]
