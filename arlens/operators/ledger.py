"""Ledger movements: cleaning, movement type (P14), running balance (W6),
first/last movement (W1 W2), reconciliation (A2 A3 J2)."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.functions.amounts import MONEY, RATE, to_money, to_rate
from arlens.functions.constants import (COLLECTION_PREFIXES, MOV_CHARGE, MOV_COLLECTION, MOV_OPENING,
                                        RECONCILE_TOLERANCE)
from arlens.functions.dates import parse_dayfirst
from arlens.functions.text import strip, title_case
from arlens.operators.windows import month_slice, running_sum

LEDGER_EXPORT_COLUMNS = {
    "Fecha": "fecha",
    "Fecha vencimiento": "fecha_vencimiento",
    "Cliente": "cliente",
    "Documento": "documento",
    "Descripción": "descripcion",
    "Debe ppal": "debe",
    "Haber ppal": "haber",
    "Saldo ppal": "saldo",
    "Cotizacionmonedasecundaria": "cotizacion",
}


def movement_type(doc) -> Column:
    """Opening when blank or ``Saldo Inicial``; collection/credit note when the
    text before ``" - "`` (upper-cased) starts with a collection prefix;
    otherwise a charge."""
    d = F.coalesce(strip(doc), F.lit(""))
    # One look at the upper-cased text: it begins without blanks, and no prefix ends with one.
    is_collection = F.upper(F.substring_index(d, " - ", 1)).rlike(f"^(?:{'|'.join(map(re.escape, COLLECTION_PREFIXES))})")
    return (F.when(d.isin("", MOV_OPENING), F.lit(MOV_OPENING))
             .when(is_collection, F.lit(MOV_COLLECTION))
             .otherwise(F.lit(MOV_CHARGE)))


def clean_ledger(raw: DataFrame) -> DataFrame:
    """Typed movements with the movement type.

    ``orden_origen`` (the export's row order, used to break date ties)
    must be landed: no row order survives a scan of several files. Optional
    columns (description, secondary rate) default to ``""`` / 0; the rate keeps
    ten decimals.
    """
    raw = raw.withColumnsRenamed({k: v for k, v in LEDGER_EXPORT_COLUMNS.items() if k in raw.columns})
    cols = set(raw.columns)
    sch = {f.name: f.dataType for f in raw.schema.fields}

    def money(c):
        return to_money(c) if c in cols else F.lit(0).cast(MONEY)

    if "orden_origen" not in cols:
        raise ValueError("the ledger landing needs orden_origen, the row order of the export")
    orden = F.col("orden_origen").cast("long")
    return raw.select(
        orden.alias("orden_origen"),
        title_case("cliente").alias("cliente"),
        F.coalesce(strip("documento"), F.lit("")).alias("documento"),
        (F.coalesce(F.col("descripcion").cast("string"), F.lit("")) if "descripcion" in cols
         else F.lit("")).alias("descripcion"),
        parse_dayfirst("fecha", sch["fecha"]).alias("fecha"),
        parse_dayfirst("fecha_vencimiento", sch["fecha_vencimiento"]).alias("fecha_vencimiento"),
        money("debe").alias("debe"), money("haber").alias("haber"), money("saldo").alias("saldo"),
        (to_rate("cotizacion") if "cotizacion" in cols else F.lit(0).cast(RATE)).alias("cotizacion"),
    ).withColumn("tipo", movement_type("documento"))


def _valid_client(df: DataFrame) -> DataFrame:
    return df.filter(F.col("cliente").isNotNull() & (F.col("cliente") != ""))


def ledger_order() -> Column:
    """Ledger order as one exact number: date (missing first), then source
    order. ``(epoch day + 10^7) * 10^20 + (source order + 10^19)`` fits in
    ``DECIMAL(38,0)`` for every representable date and 64-bit order; a
    fixed-width key keeps ``min_by``/``max_by`` in the hash aggregate (a
    struct key forces a sort-based aggregate)."""
    day = F.datediff(F.col("fecha"), F.lit("1970-01-01").cast("date")).cast("decimal(38,0)")
    hi = F.coalesce(day + F.lit(10_000_000), F.lit(0).cast("decimal(38,0)"))
    lo = F.col("orden_origen").cast("decimal(38,0)") + F.lit(Decimal(10 ** 19))
    return (hi * F.lit(Decimal(10 ** 20)) + lo).cast("decimal(38,0)")


def movement_mix(led: DataFrame) -> DataFrame:
    """Movements, debit and credit per movement type."""
    return led.groupBy("tipo").agg(F.count(F.lit(1)).alias("movimientos"),
                                   F.sum("debe").alias("debe"), F.sum("haber").alias("haber"))


def running_balance(led: DataFrame) -> DataFrame:
    """Recompute the balance the export carries: opening balance, then
    debit - credit, accumulated in ledger order per customer (a customer's
    months are separate slices, so a hot one is spread over tasks)."""
    step = F.when(F.col("tipo") == MOV_OPENING, F.col("saldo")).otherwise(F.col("debe") - F.col("haber"))
    base = _valid_client(led).select("cliente", "orden_origen", "fecha", "saldo", step.alias("_step"))
    out = running_sum(base, ["cliente"], [F.col("fecha").asc_nulls_first(), F.col("orden_origen")],
                      "_step", "saldo_recalculado", month_slice("fecha"))
    return out.select("cliente", "orden_origen", "saldo", F.col("saldo_recalculado").cast(MONEY).alias("saldo_recalculado"))


def reconcile(led: DataFrame) -> DataFrame:
    """Per customer: balance after the first movement (``saldo_inicial``),
    debit/credit totals, reconstructed balance, balance after the last
    movement, difference and whether it is within tolerance.

    First and last come from ``min_by``/``max_by`` over the ledger order in
    the same aggregate as the sums: one shuffle, partial aggregation on the
    map side, so a customer with a third of the rows is still one small row
    per task before the exchange.
    """
    key = ledger_order()
    g = _valid_client(led).groupBy("cliente").agg(
        F.min_by("saldo", key).alias("saldo_inicial"),
        F.sum("debe").cast(MONEY).alias("debe_total"),
        F.sum("haber").cast(MONEY).alias("haber_total"),
        F.max_by("saldo", key).alias("saldo_final_ledger"),
    )
    recon = (F.col("saldo_inicial") + F.col("debe_total") - F.col("haber_total")).cast(MONEY)
    return (g.withColumn("saldo_reconstruido", recon)
             .withColumn("dif_conciliacion", (F.col("saldo_final_ledger") - F.col("saldo_reconstruido")).cast(MONEY))
             .withColumn("conciliado", F.abs("dif_conciliacion") <= F.lit(RECONCILE_TOLERANCE))
             .withColumn("saldo_actual", F.col("saldo_final_ledger")))


def current_balance(led: DataFrame) -> DataFrame:
    """Balance after each customer's last movement."""
    return _valid_client(led).groupBy("cliente").agg(F.max_by("saldo", ledger_order()).alias("saldo_actual"))
