"""Every catalog query with SQL against DuckDB on the small tables."""

import pytest

from gridquarry.plans import registry
from gridquarry.sources.fixtures import fixture, table
from oracle import compare


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    n, bad = compare(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLE_SQL[name])
    assert n and not bad


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_all_rows(spark):
    """The relations of the queries over all rows leave no row of their tables out, and every table gets a verdict row."""
    sf = "/root/testdata/sf0.001"
    for name, source in (("fx_words", "lineitem"), ("fx_captions", "orders")):
        assert fixture(spark, sf, name).count() == table(spark, sf, source).count()
    tables = fixture(spark, sf, "fx_grid").select("doc_id", "table_no").distinct().count()
    assert registry.QUERIES["caption_ownership"](spark, sf).count() == tables
