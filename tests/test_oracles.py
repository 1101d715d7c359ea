"""Every registered query against its SQL on the smallest scale; the others must run."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    if name in SQL:
        message, _ = compare(df, con, SQL[name])
        assert message is None, message
    else:
        assert df.schema and df.count() >= 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
