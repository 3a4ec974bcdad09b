"""The registered queries line up with the contract."""

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


def test_flagship_runs(spark):
    out = entry.entry(spark)
    assert out.count() > 0 and "delta" in out.columns
