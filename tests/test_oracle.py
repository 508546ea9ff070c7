"""Every registered query against its DuckDB oracle at sf0.01 (the same check as tools/oracle_check.py)."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import TABLES, compare

SF = "/root/testdata/sf0.01"
KEYS = list(entry._core_queries())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(entry._core_queries()) == set(entry._core_oracles())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    n, _, problems = compare(spark, con, SF, key, entry.queries()[key], entry.oracle_sql()[key])
    assert not problems, problems
    assert n > 0


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["job_uid", "person_uid", "score"]
    assert df.count() > 0
