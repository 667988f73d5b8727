"""Every registered query against its SQL in DuckDB."""

import os

import pytest

import oracle_check
from workload import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def names():
    return sorted(registry.ALL)


@pytest.fixture(scope="module")
def con():
    return oracle_check.duck(SF)


@pytest.mark.parametrize("name", names())
def test_query(spark, con, name):
    message = oracle_check.compare(spark, con, SF, name, *registry.ALL[name])
    assert message is None, message


def test_all_have_sql():
    import __spark_entry__ as entry

    assert set(registry.ALL) <= set(entry.queries()) & set(entry.oracle_sql())
