"""The operators that SQL can express, on ordinary, odd and empty tables; all others at least run on these."""

import pytest
from conftest import SF
from oracle import differ
from quarry.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert differ(QUERIES[name](spark, SF), SQL[name], SF) == ([], [])


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_odd(spark, odd, name):
    assert differ(QUERIES[name](spark, odd), SQL[name], odd) == ([], [])


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op7_search", "op11_whitening", "op12_warc", "op13_audit"}))
def test_odd_rows_stay(spark, odd, name):
    """One row out for each row in, null and repeated ids included."""
    assert sorted(map(str, (r["doc_id"] for r in QUERIES[name](spark, odd).collect()))) == sorted(map(str, (r["doc_id"] for r in spark.read.parquet(f"{odd}/documents.parquet").collect())))
