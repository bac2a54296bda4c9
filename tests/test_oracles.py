"""Every catalogue query against its DuckDB SQL on the smallest tables."""

import pytest

from quire.plans import catalogue
from tests.helpers import DATA, duck, same_rows

SQL = catalogue.oracle_sql()


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(SQL)
    assert len(SQL) > 70


@pytest.fixture(scope="module")
def con():
    return duck()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    same_rows(catalogue.queries()[name](spark, DATA), con, SQL[name])
