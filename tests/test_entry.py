"""The driver's entry points."""

import __spark_entry__ as entry
from loomway.plans import queries


def test_registry():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(queries.Q) <= set(q)
    assert set(sql) <= set(q)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["v", "time_ms"]
    assert df.count() == 10
