"""Every registered query against its SQL twin, on the smallest tables."""

import pytest

import __spark_entry__ as contract
from compare import check, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, duck, name):
    _, _, rows, problem = check(spark, duck, name, contract.queries()[name], contract.oracle_sql().get(name), SF)
    assert problem is None
    assert rows > 0


def test_entry(spark):
    assert contract.entry(spark).count() > 0
