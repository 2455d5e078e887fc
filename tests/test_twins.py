"""Every registered query against its DuckDB twin at the smallest scale."""

import pytest

import __spark_entry__ as entry
from twins import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", list(entry.oracle_sql()))
def test_twin(spark, db, name):
    rows, extra, missing = compare(spark, db, SF, entry.queries()[name], entry.oracle_sql()[name])
    assert not extra and not missing
    assert rows > 0 or name in ("J08_unassigned", "QGW_hits_of_prose")


def test_entry(spark):
    assert entry.entry(spark).count() == 25
