"""Dashboard aggregates: billing evolution and mix (A11-A13 W5 J12 P22 P23),
top customers / debtors (K2 K3 U5), headline totals (A15), billing vs debt
(J11), open-item drill-down (F9 U4 K6), customer statement (A20 P24) and
financial KPIs (A16 K4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.amounts import AMOUNT, MONEY, div_half_even
from arlens.functions.constants import AGING_CRITICAL, KPI_BILLING_DAYS, KPI_COVERAGE_DAYS, NO_DEBT
from arlens.functions.dates import aging_bucket
from arlens.functions.text import client_key, line_label
from arlens.operators.ledger import ledger_order

LOCAL = "Local"
INTERNATIONAL = "Internacional"


def monthly(inv: DataFrame, amount: str = "monto_total_ars") -> DataFrame:
    """Billing per (year, month, label); rows without a date have no month."""
    return (inv.filter(F.col("anio").isNotNull())
               .groupBy("anio", "mes", "mes_nombre").agg(F.sum(amount).alias("monto")))


def monthly_local(inv: DataFrame) -> DataFrame:
    return monthly(inv.filter((F.col("razon_social") == LOCAL) & (F.col("moneda_iso") == "ARS")))


def monthly_intl(inv: DataFrame) -> DataFrame:
    return monthly(inv.filter(F.col("razon_social") == INTERNATIONAL))


def monthly_usd(inv: DataFrame) -> DataFrame:
    return monthly(inv, "monto_usd")


def period_line_share(inv: DataFrame) -> DataFrame:
    """Billing per (period, business line) and its share of the period.

    Period key is ``YYYY-MM`` with label ``Mon YYYY 'YY`` when the data spans
    more than one year, else ``MM`` and ``Mon YYYY``. The year count is a
    scalar subquery; the period total is a window over the small aggregate.
    """
    dated = inv.filter(F.col("anio").isNotNull())
    multi = dated.agg(F.count_distinct("anio")).scalar() > 1
    mm = F.lpad(F.col("mes").cast("string"), 2, "0")
    yy = F.substring(F.col("anio").cast("string"), -2, 2)
    periodo = F.when(multi, F.concat_ws("-", F.col("anio").cast("string"), mm)).otherwise(mm)
    etiqueta = F.when(multi, F.concat(F.col("mes_nombre"), F.lit(" '"), yy)).otherwise(F.col("mes_nombre"))
    g = (dated.groupBy(periodo.alias("periodo"), etiqueta.alias("etiqueta"), line_label("linea_negocio").alias("linea"))
              .agg(F.sum("monto_total_ars").alias("monto")))
    g = g.withColumn("total_periodo", F.sum("monto").over(Window.partitionBy("periodo")))
    return g.withColumn("pct", F.coalesce(div_half_even(F.col("monto") * 100, F.col("total_periodo"), 1), F.lit(0.0)))


def line_mix(inv: DataFrame) -> DataFrame:
    """ARS billing per business line, largest first."""
    return (inv.filter(F.col("moneda_iso") == "ARS")
               .groupBy(line_label("linea_negocio").alias("linea")).agg(F.sum("monto_total_ars").alias("monto"))
               .orderBy(F.col("monto").desc(), F.col("linea")))


def top_clients(inv: DataFrame, line: str | Column | None = None, n: int = 10) -> DataFrame:
    """Top ``n`` customers by ARS billing, optionally inside one business line.
    ``orderBy().limit()`` plans as a per-partition top-k merged once."""
    ars = inv.filter(F.col("moneda_iso") == "ARS")
    if line is not None:
        ars = ars.filter(F.col("linea_negocio") == (F.lit(line) if isinstance(line, str) else line))
    return (ars.groupBy("cliente").agg(F.sum("monto_total_ars").alias("monto"))
               .orderBy(F.col("monto").desc(), F.col("cliente")).limit(n))


def top_line(inv: DataFrame) -> Column:
    """Business line with the most ARS billing, as a scalar subquery."""
    ars = inv.filter((F.col("moneda_iso") == "ARS") & F.col("linea_negocio").isNotNull())
    return (ars.groupBy("linea_negocio").agg(F.sum("monto_total_ars").alias("m"))
               .orderBy(F.col("m").desc(), F.col("linea_negocio")).limit(1).select("linea_negocio").scalar())


def billing_totals(inv: DataFrame) -> DataFrame:
    """Headline billing: Local and Internacional in their own main currency
    (never added together) and the consolidated USD amount."""
    zero = F.lit(0).cast(MONEY)
    return inv.agg(
        F.coalesce(F.sum(F.when(F.col("razon_social") == LOCAL, F.col("monto_total_ars"))), zero).alias("total_local"),
        F.coalesce(F.sum(F.when(F.col("razon_social") == INTERNATIONAL, F.col("monto_total_ars"))), zero).alias("total_intl"),
        F.coalesce(F.sum("monto_usd"), zero).alias("total_usd"))


def billing_vs_debt(inv: DataFrame, bal: DataFrame) -> DataFrame:
    """Per customer: ARS billed next to debt, overdue, collection ratio, aging
    and days overdue; customers on one side only get zeros / ``Sin deuda``."""
    fact = (inv.filter((F.col("moneda_iso") == "ARS") & F.col("cliente").isNotNull())
               .groupBy("cliente").agg(F.sum("monto_total_ars").alias("facturado_ars")))
    debt = bal.select("cliente", F.col("saldo_deuda").alias("deuda_ars"), F.col("saldo_vencido_base").alias("saldo_vencido"),
                      "ratio_cobranza", F.col("aging_base").alias("aging"), F.col("dias_vencido_base").alias("dias_vencido"))
    zero = F.lit(0).cast(MONEY)
    j = fact.join(debt, "cliente", "full")
    return j.select(
        "cliente",
        F.coalesce("facturado_ars", zero).alias("facturado_ars"),
        F.coalesce("deuda_ars", zero).alias("deuda_ars"),
        F.coalesce("saldo_vencido", zero).alias("saldo_vencido"),
        F.coalesce("ratio_cobranza", F.lit(0.0)).alias("ratio_cobranza"),
        F.coalesce("aging", F.lit(NO_DEBT)).alias("aging"),
        F.coalesce("dias_vencido", F.lit(0)).alias("dias_vencido"))


def debtor_top(bal: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` debtors by balance (ties: overdue, days, name)."""
    return (bal.orderBy(F.col("saldo_deuda").desc(), F.col("saldo_vencido_base").desc(), F.col("dias_vencido_base").desc(),
                        F.col("cliente")).limit(n))


def top_debtors(bal: DataFrame, n: int = 10) -> DataFrame:
    """Top debtors table plus a ``TOTAL`` row summing balance and overdue."""
    top = debtor_top(bal, n).select("cliente", F.col("saldo_deuda").alias("saldo"),
                                    F.col("saldo_vencido_base").alias("vencido"),
                                    F.col("dias_vencido_base").alias("dias_vencido"), F.col("aging_base").alias("aging"))
    total = top.agg(F.sum("saldo").alias("saldo"), F.sum("vencido").alias("vencido")).select(
        F.lit("TOTAL").alias("cliente"), "saldo", "vencido",
        F.lit(None).cast("int").alias("dias_vencido"), F.lit(None).cast("string").alias("aging"))
    return top.unionByName(total)


def debt_totals(bal: DataFrame) -> DataFrame:
    """Total, overdue and critical (+90) debt and the critical share of overdue."""
    g = bal.agg(F.sum("saldo_deuda").alias("deuda_total"), F.sum("saldo_vencido_base").alias("deuda_vencida"),
                F.sum(F.when(F.col("aging_base") == AGING_CRITICAL, F.col("saldo_vencido_base"))).alias("deuda_critica"))
    zero = F.lit(0).cast(AMOUNT)
    g = g.select(*[F.coalesce(c, zero).alias(c) for c in ("deuda_total", "deuda_vencida", "deuda_critica")])
    return g.withColumn("pct_critica", div_half_even(F.col("deuda_critica") * 100, F.col("deuda_vencida"), 2, in_scale=6))


def selected_items(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Open items of the selected customers, matched on the name key and tagged
    with the selection's name."""
    sel = selected.select(F.col("cliente").alias("seleccion"), client_key("cliente").alias("cliente_norm"))
    return items.filter(F.col("saldo_abierto") > 0).join(sel, "cliente_norm")


def open_items_drill(items: DataFrame, selected: DataFrame) -> DataFrame:
    """Open items of the selected customers with centre and aging label, most overdue first."""
    return (selected_items(items, selected)
            .select(F.col("seleccion").alias("cliente"), "documento_ref", "centro_costo", F.col("venc_comp").alias("venc"),
                    F.col("dias_vencido_item").alias("dias"), aging_bucket("dias_vencido_item").alias("estado"),
                    F.col("saldo_abierto").alias("saldo"))
            .orderBy(F.col("dias").desc(), "cliente", "documento_ref"))


def selection_totals(debt: DataFrame, items: DataFrame, selected: DataFrame) -> DataFrame:
    """One row for a selection of customers: how many, their debt and overdue,
    the longest days, and number and balance of their open items."""
    chosen = debt.join(selected.select("cliente"), "cliente", "left_semi")
    of_items = selected_items(items, selected).agg(F.struct(F.count(F.lit(1)).alias("n"), F.sum("saldo_abierto").alias("s"))).scalar()
    return chosen.agg(F.count(F.lit(1)).alias("clientes"), F.sum("saldo_deuda").alias("saldo"),
                      F.sum("saldo_vencido_base").alias("vencido"), F.max("dias_vencido_base").alias("dias_vencido_max")).select(
        "*", of_items["n"].alias("items"), of_items["s"].alias("saldo_items"))


def fmt_money(c, symbol: str = "$") -> Column:
    """``$ 1,234`` or ``USD 1,234`` (half-even to units), blank when zero."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(col == 0, F.lit("")).otherwise(F.concat(F.lit(f"{symbol} "), F.format_number(col, 0)))


def fmt_percent(c) -> Column:
    """``12.3%``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.concat(F.format_number(col, 1), F.lit("%"))


def client_statement(led: DataFrame, cliente: Column | str) -> DataFrame:
    """One customer's movements in date order with display amounts."""
    who = F.lit(cliente) if isinstance(cliente, str) else cliente
    m = led.filter(F.col("cliente") == who)
    return m.select("orden_origen", "fecha", "documento", "descripcion", F.col("fecha_vencimiento").alias("vencimiento"), "tipo",
                    "debe", "haber", "saldo",
                    fmt_money("debe").alias("debe_fmt"), fmt_money("haber").alias("haber_fmt"),
                    fmt_money("saldo").alias("saldo_fmt"),
                    F.date_format("fecha", "dd/MM/yyyy").alias("fecha_fmt")) \
            .orderBy(F.col("fecha").asc_nulls_first(), "orden_origen")


def client_statement_totals(led: DataFrame, cliente: Column | str) -> DataFrame:
    """Debit, credit and the balance after the last movement of one customer."""
    who = F.lit(cliente) if isinstance(cliente, str) else cliente
    return led.filter(F.col("cliente") == who).agg(
        F.sum("debe").alias("debe_total"), F.sum("haber").alias("haber_total"),
        F.max_by("saldo", ledger_order()).alias("saldo_final"))


def largest_debtor(bal: DataFrame) -> Column:
    """Customer with the largest current balance of the balances, as a scalar subquery."""
    return (bal.select("cliente", "saldo_actual").orderBy(F.col("saldo_actual").desc(), F.col("cliente"))
            .limit(1).select("cliente").scalar())


def kpi_financial(inv: DataFrame, bal: DataFrame) -> DataFrame:
    """DSO = debt / (billing of the last 90 days / 90); overdue ratio; top-5
    debt concentration; share of overdue held by customers <= 30 days overdue;
    90-day billing. Zero denominators give 0. Sums are exact decimals; the
    ratios are DOUBLE arithmetic in a fixed order."""
    b = bal.agg(F.sum("saldo_deuda").alias("deuda"), F.sum("saldo_vencido_base").alias("venc"),
                F.sum(F.when(F.col("dias_vencido_base") <= KPI_COVERAGE_DAYS, F.col("saldo_vencido_base"))).alias("v30"))
    top5 = bal.select("saldo_deuda").orderBy(F.col("saldo_deuda").desc()).limit(5).agg(F.sum("saldo_deuda")).scalar()
    fmax = inv.agg(F.max("fecha")).scalar()
    fact90 = inv.filter(F.col("fecha") >= F.date_sub(fmax, KPI_BILLING_DAYS - 1)).agg(F.sum("monto_total_ars")).scalar()
    d = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    deuda, venc, v30, t5, f90 = d(F.col("deuda")), d(F.col("venc")), d(F.col("v30")), d(top5), d(fact90)
    diaria = f90 / F.lit(float(KPI_BILLING_DAYS))
    return b.select(
        F.when(diaria > 0, deuda / diaria).otherwise(F.lit(0.0)).alias("dso"),
        F.when(deuda > 0, venc / deuda * F.lit(100.0)).otherwise(F.lit(0.0)).alias("overdue_ratio"),
        F.when(deuda > 0, t5 / deuda * F.lit(100.0)).otherwise(F.lit(0.0)).alias("top5_concentracion"),
        F.when(venc > 0, v30 / venc * F.lit(100.0)).otherwise(F.lit(0.0)).alias("cobertura_30d"),
        f90.alias("facturacion_90d"))
