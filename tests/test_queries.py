import pytest

from brindle.plans import registry
from tests.against_sql import check
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_as_sql(spark, name):
    check(spark, registry.queries()[name], registry.oracle_sql()[name], SF)


def test_every_query_has_sql():
    assert registry.queries().keys() == registry.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(5).count() == 5
    assert set(registry.queries()) <= set(e.queries())
