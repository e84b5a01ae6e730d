import pytest

from codeloom.plans import registry
from tests.compare import oracle, spark_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf, name):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == oracle(registry.ORACLE_SQL[name], sf)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_rows_only(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
