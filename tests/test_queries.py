import pytest
from oracle import differ
from quarry.plans import curation_queries, join_queries, page_queries, rebuild_queries, sketch_queries, window_queries  # noqa: F401  register their queries
from quarry.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in SQL:
        assert differ(df, SQL[name], SF) == ([], [])
    else:
        assert df.columns and df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
