import pytest

from palimpsest import catalog_queries as q

from .conftest import SF, same


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_agrees_with_sql(spark, name):
    assert same(q.QUERIES[name](spark, SF), q.ORACLE_SQL[name])


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
