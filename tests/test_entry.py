"""Driver contract: entry smoke, catalogue and oracle keys."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "cliente" in df.columns


def test_every_query_has_oracle_or_is_declared():
    from arlens.plans.catalog import QUERIES

    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(QUERIES) <= set(sql)
