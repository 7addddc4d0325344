"""Every core query with SQL, side by side on the smallest data."""

import pytest

from burstloom.plans import catalog
from tests.oracle import assert_same, connection


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, data, name):
    assert_same(spark, data, connection(data), catalog.queries()[name], catalog.oracle_sql()[name])


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
