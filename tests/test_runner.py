"""Product runner: degraded runs and staged replacement."""

import datetime as dt

from arlens.plans.runner import run_products
from arlens.sources import fixtures, io
from conftest import SF_SMALL


def test_full_and_degraded_runs(spark, scratch):
    inv = fixtures.invoices_raw(spark, SF_SMALL)
    led = fixtures.ledger_raw(spark, SF_SMALL)
    grid = fixtures.composition_raw(spark, SF_SMALL)
    st = {r["producto"]: r for r in run_products(spark, scratch, fixtures.AS_OF, inv, led, grid,
                                                  fixtures.COMPANY_MAP_FIXTURE).collect()}
    assert all(r["estado"] == "ok" for r in st.values())
    assert io.load(spark, scratch, "cc_saldos").count() == st["cc_saldos"]["filas"]
    assert "fuente_aging" in io.load(spark, scratch, "cc_saldos").columns
    assert io.load_meta(spark, scratch)["filas"] == str(st["facturas"]["filas"])

    # No ledger: composition is still processed, balances are reported as missing.
    other = scratch + "/degraded"
    st2 = {r["producto"]: r["estado"] for r in run_products(spark, other, fixtures.AS_OF,
                                                           composition_grid=grid).collect()}
    assert st2 == {"facturas": "sin_fuente", "cc_composicion": "ok", "cc_saldos": "sin_fuente"}

    # A failing source leaves the previous product untouched.
    before = io.load(spark, scratch, "facturas").count()
    bad = inv.withColumnRenamed("fecha", "no_such_column")
    st3 = {r["producto"]: r["estado"] for r in run_products(spark, scratch, fixtures.AS_OF, invoices_raw=bad).collect()}
    assert st3["facturas"] == "error"
    assert io.load(spark, scratch, "facturas").count() == before


def test_ledger_only_derives_items(spark, scratch):
    led = fixtures.ledger_raw(spark, SF_SMALL)
    run_products(spark, scratch, dt.date(2001, 9, 1), ledger_raw=led)
    items = io.load(spark, scratch, "cc_items_derivados")
    assert items.count() > 0 and set(r[0] for r in items.select("centro_costo").distinct().collect()) == {"Sin centro"}


def test_failed_composition_does_not_read_last_runs_table(spark, scratch):
    led = fixtures.ledger_raw(spark, SF_SMALL)
    grid = fixtures.composition_raw(spark, SF_SMALL)
    run_products(spark, scratch, fixtures.AS_OF, ledger_raw=led, composition_grid=grid)
    bad = grid.withColumnRenamed("cells", "other")
    st = {r["producto"]: r for r in run_products(spark, scratch, fixtures.AS_OF, ledger_raw=led, composition_grid=bad).collect()}
    assert st["cc_composicion"]["estado"] == "error" and len(st["cc_composicion"]["detalle"]) > 0
    assert st["cc_saldos"]["estado"] == "ok"
    assert "saldo_composicion" not in io.load(spark, scratch, "cc_saldos").columns
    assert "esta_vencido" in io.load(spark, scratch, "cc_composicion").columns


def test_a_product_set_aside_is_put_back(spark, scratch):
    import os

    inv = fixtures.invoices_raw(spark, SF_SMALL)
    run_products(spark, scratch, fixtures.AS_OF, invoices_raw=inv, company_map=fixtures.COMPANY_MAP_FIXTURE)
    os.rename(f"{scratch}/facturas", f"{scratch}/facturas__previous")  # a run that died between its renames
    st = run_products(spark, scratch, fixtures.AS_OF, invoices_raw=inv, company_map=fixtures.COMPANY_MAP_FIXTURE).collect()
    assert all(r["estado"] != "error" for r in st) and not os.path.exists(f"{scratch}/facturas__previous")
