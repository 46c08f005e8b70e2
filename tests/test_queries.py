"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from check_oracles import connect, differences
from gradeweave.plans import oracles, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(queries.registry()) == set(oracles.oracle_sql())
    assert set(queries.registry()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(queries.registry()))
def test_query(spark, duck, name):
    ours = queries.registry()[name](spark, SF_DIR).toPandas()
    assert differences(ours, duck.execute(oracles.oracle_sql()[name]).df()) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
