"""Every query of the library against its DuckDB SQL, rows and types."""

import pytest

import __spark_entry__ as registry
import check
from commitloom import catalog, oracles

from conftest import SF_DIR

SQL = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.tables(SF_DIR)


def test_every_query_has_sql():
    assert set(SQL) == set(catalog.QUERIES)
    assert set(SQL) <= set(registry.oracle_sql()) and set(catalog.QUERIES) <= set(registry.queries())


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, name, SF_DIR, SQL[name]).startswith("ok")


def test_entry(spark):
    result = registry.entry(spark)
    assert result.columns == ["owner", "repo", "commits", "fitting"] and result.count() > 0
