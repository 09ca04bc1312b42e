"""Every registered query against its SQL twin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as registry  # noqa: E402
import compare  # noqa: E402

#: The queries of the library's own modules; tests/llm has the others.
OWN = [name for module in registry.REGISTRY for name in module.QUERIES]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SF)


def test_every_query_has_a_twin():
    assert OWN == [name for name in OWN if name in registry.oracle_sql()]


@pytest.mark.parametrize("name", OWN)
def test_query(spark, connection, name):
    assert compare.compare(spark, connection, SF, name) is None


def test_entry(spark):
    assert registry.entry(spark).count() > 0
