import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wordloom.operators import curate as cu
from wordloom.sources import manifest as mf, readers as rd, writers as wr
from wordloom.streaming import corpus as st


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_markup_docs(spark, tmp_path):
    write(tmp_path / "AA" / "w", '<doc id="1" title="x">\nfirst "a">\nbody\n</doc>\n<doc id="2">\nsecond</doc>\n\n')
    out = rd.read_markup_docs(spark, str(tmp_path / "AA" / "*")).orderBy("doc_no").collect()
    assert [r["text"] for r in out] == ["body\n", "second"]
    assert rd.read_markup_docs(spark, str(tmp_path / "AA" / "*"), keep_blank=True).count() == 3


def test_string_lists_and_record_maps(spark, tmp_path):
    write(tmp_path / "l" / "a.json", json.dumps(["x", "y \"q\""]))
    write(tmp_path / "l" / "b.json", json.dumps(["z"]))
    out = rd.read_string_lists(spark, str(tmp_path / "l" / "*.json")).collect()
    assert sorted((r["path"][-6:], r["position"], r["text"]) for r in out) == [
        ("a.json", 0, "x"), ("a.json", 1, 'y "q"'), ("b.json", 0, "z"),
    ]
    rec = {"C4_0_1": {"TEXT": "t", "DATA_SOURCE": "C4", "SENTENCE_LENGTH": 3, "TOTAL_AGE": 5, "AVG_AGE": 1.5, "OOV_COUNT": 1, "OOV_WORDS": ["z"]}}
    write(tmp_path / "m.json", json.dumps(rec))
    row = rd.read_record_map(spark, str(tmp_path / "m.json")).first()
    assert row["record_id"] == "C4_0_1" and row["OOV_WORDS"] == ["z"] and row["AVG_AGE"] == 1.5
    write(tmp_path / "p.json", json.dumps({"redo": {"parts": ["re", "do"]}}))
    assert tuple(rd.read_record_map(spark, str(tmp_path / "p.json"), "parts array<string>").first()) == ("redo", ["re", "do"])


def test_vocab_keeps_null_like_words(spark, tmp_path):
    path = write(tmp_path / "v.csv", "word,frequency\nnull,3\nnan,2\n,1\ncat,9\ncat,8\n")
    assert {r["word"] for r in rd.read_vocab(spark, path).collect()} == {"null", "nan", "cat"}


def test_age_lines(spark, tmp_path):
    path = write(tmp_path / "a.txt", "365.0:\n['cat', 'do']\n730:\n['emu']\n")
    out = {r["word"]: (r["age"], r["raw_age"]) for r in rd.read_age_lines(spark, path).collect()}
    assert out == {"cat": (1.0, "365.0"), "do": (1.0, "365.0"), "emu": (2.0, "730")}


def test_age_lines_are_split(spark, tmp_path):
    """Files are read in parts, with the rows of whole files: lines pair up across parts."""
    for name, last in (("a", ""), ("b", "9:"), ("c", "9:\n"), ("d", "9:\n['z']")):
        write(tmp_path / "ages" / name, "".join(f"{k}:\n['{name}{k}', 'x']\n" for k in range(40)) + last)
    path = str(tmp_path / "ages")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        out = rd.read_age_lines(spark, path)
        assert rd.read_age_lines(spark, path + "/a").rdd.getNumPartitions() > 1
        want = rd.parse_age_lines(spark.read.text(path, wholetext=True))
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_eval_files(spark, tmp_path):
    a, b = write(tmp_path / "a.csv", "s,label\nx,1\n"), write(tmp_path / "b.csv", "s,label\ny,0\n")
    assert {(r["s"], r["split"]) for r in rd.read_eval_files(spark, a, b).collect()} == {("x", "train"), ("y", "validation")}
    with pytest.raises(ValueError):
        rd.read_eval_files(spark, a, write(tmp_path / "c.json", "{}"))
    with pytest.raises(ValueError):
        rd.read_eval_files(spark, a, b, predict=True)
    with pytest.raises(ValueError):
        rd.read_eval_files(spark, "x.txt", "y.txt")


def test_pair_tsv_keeps_quotes(spark, tmp_path):
    path = write(tmp_path / "p.tsv", 'Quality\t#1\t#2\ta\tb\n1\t10\t20\tsay "hi\tthere"\n')
    assert tuple(rd.read_pair_tsv(spark, path).first()) == ("1", "10", "20", 'say "hi', 'there"')


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t{i}", "test" if i % 5 == 0 else "train") for i in range(20)], "i int, text string, split string")
    wr.write_splits(df, str(tmp_path / "s"))
    back = rd.read_splits(spark, str(tmp_path / "s"))
    assert back.where("split = 'test'").count() == 4 and (tmp_path / "s" / "split=test").is_dir()
    wr.write_chunks(df.coalesce(1), str(tmp_path / "c"), 6)
    assert len(list((tmp_path / "c").glob("*.parquet"))) == 4
    wr.write_predictions(df.withColumn("p", F.col("i") / 3), str(tmp_path / "p"), "i", "p", regression=True)
    lines = [l for f in sorted((tmp_path / "p").glob("part-*")) for l in f.read_text().splitlines() if not l.startswith("index")]
    assert lines[:2] == ["0\t0.000", "1\t0.333"] and len(lines) == 20
    wr.write_indexed_pairs(df.select("i", "text"), str(tmp_path / "x"), ["i"])
    got = spark.read.option("header", True).csv(str(tmp_path / "x"), sep="\t")
    assert got.columns == ["index", "i", "text"] and got.count() == 20


def test_read_corpus(spark, tmp_path):
    for split in ("train", "test"):
        spark.createDataFrame([("T", f"{split} text")], "title string, content string").write.parquet(str(tmp_path / split))
    out = rd.read_corpus(spark, "cbt", {s: str(tmp_path / s) for s in ("train", "test")})
    assert {tuple(r) for r in out.collect()} == {("cbt", "train", "train text"), ("cbt", "test", "test text")}
    with pytest.raises(ValueError):
        rd.read_corpus(spark, "cbt", {"other": "x"})


def test_manifest(spark):
    rows = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0)], "file string, row_no bigint")
    done = spark.createDataFrame([("a", 3)], "file string, end_row bigint")
    left = mf.pending(rows, done)
    assert sorted(map(tuple, left.select("file", "row_no").collect())) == [("a", 3), ("a", 4), ("b", 0)]
    assert {r["file"]: r["end_row"] for r in mf.advance(done, left).collect()} == {"a": 5, "b": 1}
    assert mf.advance(done, left.where("false")).first()["end_row"] == 3


SCHEMA = "doc_id bigint, source string, text string"


def add_docs(spark, path, start, n):
    rows = [(i, "s", "cat " * (45 + i % 5) if i % 2 else "cat emu " * 30) for i in range(start, start + n)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("append").parquet(path)


def test_stream_filter_resumes_and_equals_batch(spark, tmp_path):
    src, sink, marks = (str(tmp_path / n) for n in ("src", "sink", "marks"))
    vocab = spark.createDataFrame([("cat",)], "word string")
    for start in (0, 30):
        add_docs(spark, src, start, 30)
        stream = rd.stream_corpus(spark, src, SCHEMA, files_per_batch=1)
        st.stream_filter(stream, vocab, sink, marks).awaitTermination()
    want = cu.limited_vocab_spans(spark.read.parquet(src), vocab, ["doc_id"])
    key = ["doc_id", "start", "n_tokens", "span"]
    assert sorted(map(tuple, spark.read.parquet(sink).select(key).collect())) == sorted(map(tuple, want.select(key).collect()))
    assert want.count() > 0


def test_stream_dedup_across_batches(spark, tmp_path):
    src, sink, marks = (str(tmp_path / n) for n in ("src", "sink", "marks"))
    add_docs(spark, src, 0, 20)
    add_docs(spark, src, 20, 20)
    stream = rd.stream_corpus(spark, src, SCHEMA, files_per_batch=2)
    st.stream_dedup(stream, sink, marks, "text", ["doc_id"], across_batches=True).awaitTermination()
    out = [r["text"] for r in spark.read.parquet(sink).collect()]
    want = {r["text"] for r in spark.read.parquet(src).select("text").distinct().collect()}
    assert len(out) == len(set(out)) and set(out) == want


def test_stream_sample(spark, tmp_path):
    src, sink, marks = (str(tmp_path / n) for n in ("src", "sink", "marks"))
    add_docs(spark, src, 0, 30)
    st.stream_sample(rd.stream_corpus(spark, src, SCHEMA), 2, sink, marks).awaitTermination()
    got = spark.read.parquet(sink)
    assert got.groupBy("doc_id").count().agg(F.max("count")).first()[0] == 2
    assert st.read_sample(got, 10).count() == 10


def test_markup_docs_on_lines(spark, tmp_path):
    lines = ['<p class="a">one</p><p>two</p>\t', "", '<p>three</p><p> </p>tail']
    write(tmp_path / "L" / "w", "\n".join(lines) + "\n")
    rows = rd.read_markup_docs(spark, str(tmp_path / "L"), end="</p>", head_end=">", lines=True)
    assert sorted((r["doc_no"], r["text"]) for r in rows.collect()) == [(0, "one"), (0, "three"), (1, "two"), (2, "tail")]
    assert rows.schema["doc_no"].dataType.typeName() == "long"
    # a source is a line of a file, not a file of its own
    spark.createDataFrame([(f"<p>{i}</p><p>x</p>",) for i in range(300)], "html string").coalesce(2).write.parquet(str(tmp_path / "sf" / "pages.parquet"))
    seen = []
    import catalog.corpus as cc
    from catalog.common import QUERIES
    known = cc.scratch_dir
    cc.scratch_dir = lambda s, name: seen.append(str(tmp_path / name)) or seen[-1]
    try:
        found = QUERIES["read_markup_docs"](spark, str(tmp_path / "sf")).collect()
    finally:
        cc.scratch_dir = known
    assert sorted(tuple(r) for r in found) == sorted([(0, str(i)) for i in range(300)] + [(1, "x")] * 300)
    assert len(list((tmp_path / "markup").glob("part-*"))) <= 4


def test_resumed_stream_has_work_for_every_core(spark, tmp_path, monkeypatch):
    import catalog
    text = " ".join(["the red fox and the dog ran home"] * 12)
    spark.createDataFrame([(i, "s", "en", text) for i in range(80)], "doc_id bigint, source string, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    batches = []
    known = st.limited_vocab_spans
    monkeypatch.setattr(st, "limited_vocab_spans", lambda batch, *a, **k: batches.append(batch.select(F.input_file_name()).distinct().count()) or known(batch, *a, **k))
    rows = catalog.QUERIES["stream_resume"](spark, str(tmp_path)).collect()
    want = cu.limited_vocab_spans(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.createDataFrame([(w,) for w in set(text.split())], "word string"), ["doc_id"])
    assert Counter((r["doc_id"], r["start"]) for r in rows) == Counter((r["doc_id"], r["start"]) for r in want.collect())
    assert rows and len(batches) == 4 and max(batches) >= spark.sparkContext.defaultParallelism
