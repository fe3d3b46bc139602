"""Registered queries against their oracle SQL: a sample, or all with ``-m oracle``."""

import os

import pytest

from __spark_entry__ import oracle_sql, queries

SF = "/root/testdata/sf0.001"
SAMPLE = (
    "filter_limited_vocab", "dedup_spans", "featurize_docs", "eval_coverage", "quota_per_source", "split_tail",
    "pack_sequences", "unconstrained_corpus", "mask_tokens", "cumulative_frequency_pct", "running_best",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver tables")


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def compare(spark, key):
    import duckdb

    from check import TABLES, table_of

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[key](spark, SF)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(oracle_sql()[key])
    assert got == table_of([d[0] for d in res.description], res.fetchall())


@pytest.mark.parametrize("key", SAMPLE)
def test_matches_oracle(spark, key):
    compare(spark, key)


@pytest.mark.oracle
@pytest.mark.parametrize("key", sorted(set(oracle_sql()) - set(SAMPLE)))
def test_all_match_oracle(spark, key):
    compare(spark, key)
