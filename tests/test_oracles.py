"""Every registered query on the smallest tables against DuckDB."""

import pytest
from compare import compare

from __spark_entry__ import oracle_sql, queries

QUERIES, ORACLES = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    ok, text, _ = compare(spark, "/root/testdata/sf0.001", name, QUERIES[name], ORACLES.get(name))
    assert ok, text
