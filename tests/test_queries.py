import pytest
from oracle import difference

from tilewright.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_sql(spark, small, name):
    if name in ORACLE_SQL:
        assert difference(spark, small, QUERIES[name], ORACLE_SQL[name]) == []
    else:
        assert QUERIES[name](spark, small).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 3
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
