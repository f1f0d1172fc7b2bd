"""Every query over the small tables: against its SQL where there is one, else that it runs and gives rows."""

import pytest

from tests.oracle import connect, rows
from veritrail.plans.queries import FLAGSHIP, ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert rows(got) == rows(db.execute(ORACLES[name]).df())
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() and FLAGSHIP in e.queries() and set(e.oracle_sql()) <= set(e.queries())
