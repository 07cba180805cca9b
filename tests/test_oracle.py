"""Every registered query beside DuckDB on the small tables."""

import pathlib

import pytest

SF = "/root/testdata/sf0.001"
if not pathlib.Path(SF).exists():
    pytest.skip("test tables are not present", allow_module_level=True)

import __spark_entry__ as entry
from compare import check, duck

from dragline.plans import registry

NAMES = sorted(registry.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, con, name):
    ok, message, _, _ = check(spark, con, SF, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, message


def test_every_query_has_an_oracle():
    assert set(registry.QUERIES) == set(registry.ORACLE)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
