"""The entry module, and a few registered queries against DuckDB on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("macro_metrics", "paired_summary", "pairs_weak_hash_mode", "ledger_chain_check", "oracle_strata", "key_set_hash")


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda r: tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in r)
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(text, got.collect())) == sorted(text([r[i] for i in order]) for r in want.fetchall())
