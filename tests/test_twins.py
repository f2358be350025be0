"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as contract
from compare import database, difference
from duowave.checks.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_result(spark, con, name):
    got = contract.queries()[name](spark, FOLDER).toPandas()
    assert difference(got, con.execute(contract.oracle_sql()[name]).df()) is None


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


def test_entry_has_a_stable_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["instrument", "effect", "f_value", "df1", "df2", "pes", "p_value"]
    assert df.count() > 0
