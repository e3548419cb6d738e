"""Registered queries against their SQL on the smallest tables, and the driver contract."""

from __future__ import annotations

from pathlib import Path

import pytest

import __spark_entry__ as contract
from tests.oracle_check import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
    assert contract.queries()["embed"](spark, SF).filter("dims <> 64").count() == 0
