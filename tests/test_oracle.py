"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest

import __spark_entry__ as registry
from tests.compare import compare, open_tables
from workload import spark_queries, sql

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF)


@pytest.mark.parametrize("name", spark_queries.QUERIES)
def test_query(spark, tables, name):
    assert compare(spark, tables, name, SF) is None


def test_every_query_has_sql():
    assert set(sql.statements()) == set(spark_queries.QUERIES)


def test_entry(spark):
    assert registry.entry(spark).count() == 250
