"""Every catalog query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_queries import connect, difference

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.queries()))
@pytest.mark.filterwarnings("ignore::FutureWarning")
def test_query(spark, sf, duck, name):
    got = entry.queries()[name](spark, sf).toPandas()
    if name in SQL:
        assert difference(got, duck.execute(SQL[name]).df()) is None
    else:
        assert len(got) > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
