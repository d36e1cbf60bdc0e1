"""Data briefing (A18 K4 K5 A17): the numbers a text summary of billing and
debt is written from, as one long table ``(seccion, metrica, clave, valor)``.
Rendering the text is not part of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.functions.constants import AGING_CURRENT, BRIEFING_CRITICAL_DAYS

BILLING = "facturacion"
DEBT = "cuentas_corrientes"


def _rows(df: DataFrame, seccion: str, metrica: str, clave, valor) -> DataFrame:
    return df.select(F.lit(seccion).alias("seccion"), F.lit(metrica).alias("metrica"),
                     (F.lit(clave) if isinstance(clave, str) else clave).cast("string").alias("clave"),
                     valor.cast("double").alias("valor"))


def _scalars(agg: DataFrame, seccion: str, names: list[str]) -> DataFrame:
    """One aggregate row -> one long row per metric (``stack``)."""
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in names)
    return agg.selectExpr(f"stack({len(names)}, {pairs}) AS (metrica, valor)").select(
        F.lit(seccion).alias("seccion"), "metrica", F.lit("").alias("clave"), "valor")


def briefing(inv: DataFrame, bal: DataFrame, top: int = 5, months: int = 12, critical_top: int = 10) -> DataFrame:
    """Billing: total, net, invoice count, active customers, top customers,
    last ``months`` months. Debt: total, current, overdue, per aging bucket,
    top debtors, critical customers (> 60 days overdue)."""
    inv_tot = inv.agg(F.sum("monto_total_ars").alias("total"), F.sum("monto_neto_ars").alias("total_neto"),
                      F.count(F.lit(1)).alias("cantidad_facturas"),
                      F.count_distinct("cliente").alias("clientes_activos"))
    per_client = inv.filter(F.col("cliente").isNotNull()).groupBy("cliente").agg(F.sum("monto_total_ars").alias("m"))
    top_clients = per_client.orderBy(F.col("m").desc(), "cliente").limit(top)
    per_month = (inv.filter(F.col("anio").isNotNull()).groupBy("anio", "mes")
                    .agg(F.sum("monto_total_ars").alias("m"))
                    .orderBy(F.col("anio").desc(), F.col("mes").desc()).limit(months))
    month_key = F.concat_ws("-", F.col("anio").cast("string"), F.lpad(F.col("mes").cast("string"), 2, "0"))

    debt_tot = bal.agg(F.sum("saldo_deuda").alias("deuda_total"),
                       F.sum(F.when(F.col("aging_base") == AGING_CURRENT, F.col("saldo_deuda"))).alias("al_dia"))
    debt_tot = debt_tot.select("deuda_total", F.coalesce("al_dia", F.lit(0)).alias("al_dia"),
                               (F.col("deuda_total") - F.coalesce("al_dia", F.lit(0))).alias("vencido"))
    by_aging = bal.groupBy("aging_base").agg(F.sum("saldo_deuda").alias("m"))
    debtors = bal.groupBy("cliente").agg(F.sum("saldo_deuda").alias("m"))
    top_debtors = debtors.orderBy(F.col("m").desc(), "cliente").limit(top)
    critical = (bal.filter(F.col("dias_vencido_base") > BRIEFING_CRITICAL_DAYS).groupBy("cliente")
                   .agg(F.sum("saldo_deuda").alias("m")).orderBy(F.col("m").desc(), "cliente").limit(critical_top))

    parts = [
        _scalars(inv_tot, BILLING, ["total", "total_neto", "cantidad_facturas", "clientes_activos"]),
        _rows(top_clients, BILLING, "top_clientes", F.col("cliente"), F.col("m")),
        _rows(per_month, BILLING, "evolucion_mensual", month_key, F.col("m")),
        _scalars(debt_tot, DEBT, ["deuda_total", "al_dia", "vencido"]),
        _rows(by_aging, DEBT, "aging", F.col("aging_base"), F.col("m")),
        _rows(top_debtors, DEBT, "top_deudores", F.col("cliente"), F.col("m")),
        _rows(critical, DEBT, "criticos", F.col("cliente"), F.col("m")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
