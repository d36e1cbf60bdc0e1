"""Batch product runner (S14): build every product that has a source, keep
going when one fails, report a status row per product.

Products are written to ``out_dir`` (a shared folder on a cluster). Each is
staged next to its final folder and swapped in only after the write
succeeded, so a failing source leaves the previous product untouched: the old
folder is set aside, the new one renamed into its place, and the old one put
back if that fails. Later products read the tables this run wrote, which cuts
the lineage between steps; a step never reads what an earlier run left.
"""

from __future__ import annotations

import datetime as _dt
import traceback

from pyspark.sql import DataFrame, SparkSession

from arlens.operators.aging import lifo_slices, open_items
from arlens.operators.balances import client_balances, client_balances_with_composition
from arlens.operators.composition import composition_items, composition_summary
from arlens.operators.invoices import clean_invoices, customer_summary
from arlens.operators.ledger import clean_ledger
from arlens.sources import io

STATUS_SCHEMA = "producto string, estado string, filas long, detalle string"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def save_swap(df: DataFrame, out_dir: str, name: str) -> int:
    """Write ``df`` to a staging folder, then replace ``{out_dir}/{name}``."""
    spark = df.sparkSession
    staging = f"{name}__staging"
    n = io.save(df, out_dir, staging, observe_rows=True)
    fs, final = _fs(spark, f"{out_dir.rstrip('/')}/{name}")
    _, staged = _fs(spark, f"{out_dir.rstrip('/')}/{staging}")
    _, aside = _fs(spark, f"{out_dir.rstrip('/')}/{name}__previous")
    if fs.exists(aside):
        # A run ended between its two renames: the set-aside product is the good one.
        if fs.exists(final):
            fs.delete(aside, True)
        else:
            fs.rename(aside, final)
    had = fs.exists(final)
    if had and not fs.rename(final, aside):
        raise OSError(f"{name}: the previous product could not be set aside")
    if not fs.rename(staged, final):
        if had:
            fs.rename(aside, final)
        raise OSError(f"{name}: the new product could not be moved into place")
    if had:
        fs.delete(aside, True)
    return int(n or 0)


def run_products(spark: SparkSession, out_dir: str, as_of: _dt.date,
                 invoices_raw: DataFrame | None = None, ledger_raw: DataFrame | None = None,
                 composition_grid: DataFrame | None = None, company_map: dict | None = None) -> DataFrame:
    """Build ``facturas``, ``resumen_clientes``, ``meta``, ``cc_composicion``,
    ``cc_movimientos`` and ``cc_saldos``; without composition also
    ``cc_items_derivados``, the items the ledger gives. Returns the status report."""
    status: list[tuple] = []

    def step(product: str, fn) -> bool:
        try:
            n = fn()
            status.append((product, "ok", n, ""))
            return True
        except Exception as e:  # noqa: BLE001 - a failing product must not stop the others
            status.append((product, "error", None, f"{type(e).__name__}: {e}"))
            traceback.print_exc()
            return False

    def skipped(product: str) -> None:
        status.append((product, "sin_fuente", None, ""))

    if invoices_raw is None:
        skipped("facturas")
    else:
        def invoices_step():
            n = save_swap(clean_invoices(invoices_raw, company_map or {}), out_dir, "facturas")
            inv = io.load(spark, out_dir, "facturas")
            save_swap(customer_summary(inv), out_dir, "resumen_clientes")
            io.save_meta(spark, out_dir, {"ultima_actualizacion": _dt.datetime.now().isoformat(), "filas": n})
            return n
        step("facturas", invoices_step)

    comp_summary = None
    if composition_grid is None:
        skipped("cc_composicion")
    else:
        def composition_step():
            return save_swap(composition_items(composition_grid, as_of), out_dir, "cc_composicion")
        if step("cc_composicion", composition_step):
            items = io.load(spark, out_dir, "cc_composicion")
            if not items.isEmpty():
                comp_summary = composition_summary(items)

    if ledger_raw is None:
        skipped("cc_saldos")
    else:
        def ledger_step():
            save_swap(clean_ledger(ledger_raw), out_dir, "cc_movimientos")
            led = io.load(spark, out_dir, "cc_movimientos")
            if comp_summary is not None:
                bal = client_balances_with_composition(led, comp_summary, as_of)
                return save_swap(bal, out_dir, "cc_saldos")
            n = save_swap(client_balances(led, as_of), out_dir, "cc_saldos")
            bal = io.load(spark, out_dir, "cc_saldos")
            # Without a composition workbook the open items come from the ledger.
            derived = open_items(lifo_slices(led, bal.select("cliente", "saldo_actual")), as_of)
            save_swap(derived, out_dir, "cc_items_derivados")
            return n
        step("cc_saldos", ledger_step)

    return spark.createDataFrame(status, STATUS_SCHEMA)
