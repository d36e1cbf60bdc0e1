"""Daily billing rollup with running totals (F4 A11 A15): any date window is the
difference of two of its rows per key, and no view has to read invoices for it.

One row per company scope, currency, business line and day: rows, ARS and USD billed
that day and up to that day. Invoices are added up once (partial sums, one shuffle);
the running totals are windows over the days of a key, of which there are as many as
days, however many invoices a key has. Rows without a date belong to no window: they
are one row per key with a null date and no running total.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.amounts import MONEY
from arlens.functions.dates import month_label
from arlens.operators.views import INTERNATIONAL, LOCAL

KEYS = ["razon_social", "moneda_iso", "linea_negocio"]
MEASURES = {"filas": F.count, "ars": F.sum, "usd": F.sum}


def daily_rollup(inv: DataFrame) -> DataFrame:
    """KEYS, fecha, the day's filas, ars and usd, and ``*_hasta``, the totals up to it."""
    day = inv.groupBy(*KEYS, "fecha").agg(F.count(F.lit(1)).alias("filas"), F.coalesce(F.sum("monto_total_ars"), F.lit(0)).cast(MONEY).alias("ars"),
                                          F.coalesce(F.sum("monto_usd"), F.lit(0)).cast(MONEY).alias("usd"))
    upto = Window.partitionBy(*KEYS, F.col("fecha").isNull()).orderBy("fecha").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dated = F.col("fecha").isNotNull()
    return day.withColumns({f"{m}_hasta": F.when(dated, F.sum(m).over(upto)).cast("long" if m == "filas" else MONEY) for m in MEASURES}
                           ).withColumns({"anio": F.year("fecha"), "mes": F.month("fecha")})


def window_totals(rollup: DataFrame, lo: Column, hi: Column, keys: list[str] = KEYS) -> DataFrame:
    """Totals of the days from ``lo`` to ``hi`` per ``keys``: running total at the end less
    the one before the beginning, per key of the rollup, then added up over the others."""
    def at(m: str, inside: Column) -> Column:
        return F.coalesce(F.max_by(F.when(inside, F.col(f"{m}_hasta")), F.when(inside, F.col("fecha"))), F.lit(0))

    ends = rollup.filter(F.col("fecha") <= hi).groupBy(*KEYS).agg(
        *[(at(m, F.lit(True)) - at(m, F.col("fecha") < lo)).alias(m) for m in MEASURES])
    ends = ends.filter(F.col("filas") > 0)
    return (ends.groupBy(*keys) if keys else ends).agg(*[F.coalesce(F.sum(m), F.lit(0)).cast("long" if m == "filas" else MONEY).alias(m) for m in MEASURES])


def date_window(rollup: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Rows and billing inside the window, from the rollup alone."""
    return window_totals(rollup, lo, hi, []).select(lo.alias("desde"), hi.alias("hasta"), "filas", F.col("ars").alias("total"))


def billing_totals(rollup: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Headline billing of the window: each company scope in its own currency, and all USD."""
    t = window_totals(rollup, lo, hi, ["razon_social"])
    zero = F.lit(0).cast(MONEY)
    return t.agg(F.coalesce(F.sum(F.when(F.col("razon_social") == LOCAL, F.col("ars"))), zero).alias("total_local"),
                 F.coalesce(F.sum(F.when(F.col("razon_social") == INTERNATIONAL, F.col("ars"))), zero).alias("total_intl"),
                 F.coalesce(F.sum("usd"), zero).alias("total_usd"))


def monthly(rollup: DataFrame, lo: Column, hi: Column, amount: str = "ars", where: Column | None = None) -> DataFrame:
    """Billing per month of the window: days added up."""
    days = rollup.filter(F.col("fecha").between(lo, hi))
    if where is not None:
        days = days.filter(where)
    return days.groupBy("anio", "mes", month_label("fecha").alias("mes_nombre")).agg(F.sum(amount).alias("monto"))


def year_to_date(rollup: DataFrame) -> DataFrame:
    """Per key and month: billing of the month and of its year up to the month's end,
    as differences of running totals; no sum over days is taken again."""
    dated = rollup.filter(F.col("fecha").isNotNull())
    month = dated.groupBy(*KEYS, "anio", "mes").agg(
        F.max_by("ars_hasta", "fecha").alias("fin"), F.min_by(F.col("ars_hasta") - F.col("ars"), "fecha").alias("ini"),
        F.max_by("filas_hasta", "fecha").alias("n_fin"), F.min_by(F.col("filas_hasta") - F.col("filas"), "fecha").alias("n_ini"))
    start = Window.partitionBy(*KEYS, "anio")
    return month.select(*KEYS, "anio", "mes", (F.col("n_fin") - F.col("n_ini")).cast("long").alias("filas"), (F.col("fin") - F.col("ini")).cast(MONEY).alias("monto"),
                        (F.col("n_fin") - F.min("n_ini").over(start)).cast("long").alias("filas_anio"),
                        (F.col("fin") - F.min_by("ini", "mes").over(start)).cast(MONEY).alias("monto_anio"))
