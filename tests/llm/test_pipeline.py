import hashlib
import os

import pytest

import corpus_pipeline
from tests.llm import test_decontam, test_linededup, test_simhash
from wordloom.llm import bpe, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")


def test_run_matches_brute_force(spark):
    """Quality verdicts are the operator's (tests of its own); all later stages are brute force."""
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r["doc_id"] for r in quality.judge(docs, labels=labels).where("kept").collect()}
    texts = sorted((r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept)
    texts = sorted((d, t[0]) for d, t in test_linededup.brute(texts).items())
    label = test_simhash.brute_classes([test_simhash.brute_print(t) for _, t in texts])
    texts = [x for k, x in enumerate(texts) if label[k] == k]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in test_decontam.brute(texts, bench) if r[4]}
    texts = [(d, t) for d, t in texts if d not in bad]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {d for d, _ in texts} and len(bad) > 0
    for d, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert got[d]["ids"] == ids and got[d]["n_tokens"] == len(ids)
        assert got[d]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_stages_keep_columns_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None)], docs.schema))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, rows.limit(0), SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() == rows.count()
