"""Every registered query against SQL on the raw tables."""

from __future__ import annotations

import os

import pytest
from compare import raw_tables, spark_rows, sql_rows

from tracewell.workload.oracle import ORACLE
from tracewell.workload.registry import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def raw():
    return raw_tables(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, raw, name):
    names, rows = spark_rows(QUERIES[name](spark, SF_DIR))
    expected_names, expected = sql_rows(raw, ORACLE[name])
    assert names == expected_names
    assert len(rows) == len(expected)
    assert rows == expected
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_oracle_has_no_other_queries():
    assert set(ORACLE) <= set(QUERIES)
