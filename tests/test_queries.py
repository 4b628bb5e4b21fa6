import pytest
from oracle import check

from tankwatch import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf, name):
    check(spark, sf, catalog.QUERIES[name], catalog.SQL[name])


def test_every_sql_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
