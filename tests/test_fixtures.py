"""The Spark landing builders reproduce the FIXTURES.md SQL definitions
(run by DuckDB) row for row, including the ledger running balance and the
composition row numbers computed by the sliced window helpers."""

import duckdb
import pytest

from arlens.plans.oracle import build
from arlens.sources import fixtures
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["nation", "customer", "part", "orders", "lineitem"]:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(rows):
    return sorted((tuple("" if v is None else str(v) for v in r) for r in rows))


def test_invoice_landing(spark, con):
    df = fixtures.invoices_raw(spark, SF_SMALL)
    sql = build(f"SELECT {', '.join(df.columns)} FROM inv_raw", ["inv_raw"])
    assert _rows(df.collect()) == _rows(con.execute(sql).fetchall())


def test_ledger_landing(spark, con):
    df = fixtures.ledger_raw(spark, SF_SMALL)
    sql = build(f"SELECT {', '.join(df.columns)} FROM led_raw", ["led_raw"])
    assert _rows(df.collect()) == _rows(con.execute(sql).fetchall())


def test_composition_landing(spark, con):
    df = fixtures.composition_raw(spark, SF_SMALL)
    got = [(r["file"], r["sheet"], r["row_idx"], *r["cells"], *[None] * (5 - len(r["cells"]))) for r in df.collect()]
    sql = build("SELECT file, sheet, row_idx, c0, c1, c2, c3, c4 FROM comp_raw", ["comp_raw"])
    assert _rows(got) == _rows(con.execute(sql).fetchall())
