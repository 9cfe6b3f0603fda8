"""The corpus queries that SQL can express, against it; what the entry registers."""

import duckdb
import pytest

import __spark_entry__ as contract
import check
from marginalia.llm import catalog

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.sql(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    good, note = check.compare(spark, con, SF_DIR, name)
    assert good, note


def test_every_query_is_registered():
    assert set(catalog.QUERIES) | {"pipeline"} <= set(contract.queries())
    assert [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in catalog.QUERIES)] == []
