"""The queries of this package that SQL can express, against it, on the smallest tables."""

import pytest

from pathloom.llm.queries import ORACLES, QUERIES
from tests.compare import rows_of_duckdb, rows_of_spark, tables

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = rows_of_spark(QUERIES[name](spark, SF))
    assert got == rows_of_duckdb(tables(SF), ORACLES[name])
    assert got[1]
