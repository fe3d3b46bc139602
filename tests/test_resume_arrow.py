import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wordloom.sources import arrowfolders as af, intervals as iv


def rows_of(ranges):
    return {(f, r) for f, a, b in ranges for r in range(a, b)}


def test_merged_ranges_match_brute_force(spark):
    rng = random.Random(5)
    ranges = [(rng.choice("abc"), a := rng.randint(0, 300), a + rng.randint(-2, 12)) for _ in range(120)]
    given = spark.createDataFrame(ranges + [(None, 1, 2), ("a", None, 3)], iv.SCHEMA)
    got = sorted(map(tuple, iv.merged(given).collect()))
    assert rows_of(got) == rows_of(ranges)
    assert all(a[0] != b[0] or a[2] < b[1] for a, b in zip(got, got[1:]))  # neither overlapping nor touching
    rows = spark.createDataFrame(sorted(rows_of(ranges)) + [("a", None), (None, 7)], "file string, row_no bigint")
    assert sorted(map(tuple, iv.covered(rows.union(rows), block=16).collect())) == got
    everything = spark.createDataFrame([(f, r) for f in "abcd" for r in range(320)] + [(None, 1), ("a", None)], "file string, row_no bigint")
    want = {(f, r) for f in "abcd" for r in range(320)} - rows_of(ranges) | {(None, 1), ("a", None)}
    for most in (256, 3):
        assert set(map(tuple, iv.pending(everything, given, max_ranges=most).collect())) == want


def test_writers_out_of_order_lose_no_row(spark, tmp_path):
    path = str(tmp_path / "done")
    rows = spark.createDataFrame([("f", r) for r in range(100)], "file string, row_no bigint")
    assert iv.read(spark, path).count() == 0 and iv.pending(rows, iv.read(spark, path)).count() == 100
    later, earlier = rows.where("row_no >= 60"), rows.where("row_no < 20")
    iv.commit(iv.covered(later), path)  # the later range finishes first
    assert {r["row_no"] for r in iv.pending(rows, iv.read(spark, path)).collect()} == set(range(60))
    iv.commit(iv.covered(earlier), path)
    iv.commit(iv.covered(earlier), path)  # a retry changes nothing
    failed = iv.commit(iv.covered(rows), path)
    os.remove(f"{failed}/_SUCCESS")  # a writer that died before its marker
    assert {r["row_no"] for r in iv.pending(rows, iv.read(spark, path)).collect()} == set(range(20, 60))
    before = sorted(map(tuple, iv.read(spark, path).collect()))
    iv.compact(spark, path)
    assert len(iv.commits(spark, path)) == 1 and sorted(map(tuple, iv.read(spark, path).collect())) == before == [("f", 0, 20), ("f", 60, 100)]


def test_arrow_folders_round_trip(spark, tmp_path):
    path = str(tmp_path / "set")
    rows = [(k, ("train", "test")[k % 5 == 0], None if k % 7 == 0 else f"t{k} é", [k, k + 1], {"a": float(k)}) for k in range(200)]
    schema = "id bigint, split string, text string, ids array<int>, more map<string,double>"
    docs = spark.createDataFrame(rows, schema).repartition(5)
    af.write_arrow_splits(docs, path)
    back = af.read_arrow_splits(spark, path)
    assert sorted(back.select(docs.columns).collect()) == sorted(docs.collect())
    assert back.where("split = 'validation'").count() == 0 and dict(back.dtypes) == dict(docs.dtypes)
    with pa.OSFile(f"{path}/test/{af._load(path + '/test', af.STATE)['_data_files'][0]['filename']}") as f:
        assert pa.ipc.open_stream(f).read_all().num_rows > 0  # any Arrow reader can open the files
    af.write_folder(docs.drop("split"), f"{path}/train", mode="append")
    assert af.read_folder(spark, f"{path}/train").count() == 160 + 200
    assert af.read_arrow_splits(spark, f"{path}/test").where("split = 'train'").count() == 40
    for bad in (docs, docs.withColumn("split", F.lit(None).cast("string"))):
        with pytest.raises(Exception, match="no such split"):
            af.write_arrow_splits(bad, path, splits=("train",))
    assert af.read_arrow_splits(spark, path).count() == 360 + 40
    af.write_arrow_splits(docs.limit(0), path)
    assert af.read_arrow_splits(spark, path).count() == 0 and len(os.listdir(f"{path}/train")) == 1


def test_failed_task_leaves_nothing_that_is_read(spark, tmp_path):
    path = str(tmp_path / "set")
    docs = spark.range(0, 40, 1, 4)
    af.write_folder(docs, path)
    bad = docs.withColumn("id", F.when(F.col("id") == 39, F.raise_error(F.lit("boom")).cast("bigint")).otherwise(F.col("id")))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="boom"):
            af.write_folder(bad, path, mode)
        assert sorted(r["id"] for r in af.read_folder(spark, path).collect()) == list(range(40))
