"""Every registered query against its SQL on the smallest tables; the entry contract."""

import importlib

import pytest

import __spark_entry__ as entry
from citeloom.queries import ORACLES, QUERIES
from harness import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["work", "year", "n", "total", "share"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_optional_parts_are_guarded():
    assert entry._optional("citeloom.nothing_of_that_name") is None
    assert importlib.import_module("citeloom.queries").QUERIES
