"""Every registered query with SQL gives the SQL's rows; the others give rows."""

import oracle
import pytest

from relspark import catalog


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows_as_sql(spark, sf, con, name):
    assert oracle.compare(spark, con, sf, catalog.queries()[name], catalog.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0
