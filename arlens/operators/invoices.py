"""Invoice cleaning (P1-P10) and the customer billing summary (F1 F2 A1 J1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arlens.functions.amounts import MONEY, to_money
from arlens.functions.constants import CREDIT_NOTE_TYPES, CURRENCY_MAP
from arlens.functions.dates import month_label, parse_dayfirst
from arlens.functions.text import strip, title_case

# Export header -> landing column name.
INVOICE_EXPORT_COLUMNS = {
    "Documento": "documento",
    "Fecha": "fecha",
    "Comprobante": "comprobante",
    "Cliente": "cliente",
    "Gravado": "gravado",
    "No gravado": "no_gravado",
    "Iva por tasa impositiva": "iva",
    "Moneda": "moneda",
    "Importe mon. principal": "importe_principal",
    "Imp. usd": "imp_usd",
    "Importenetopendiente": "importe_pendiente",
    "Empresa": "empresa",
    "Nivel 1 dimensión": "nivel_1_dimension",
    "Condición pago": "condicion_pago",
    "Producto": "producto",
    "Descripción item": "descripcion_item",
    "Descripción": "descripcion",
    "Situacion": "situacion",
    "Dim. valor": "dim_valor",
    "Cantidadesagro": "cantidad",
}

INVOICE_COLUMNS = ["fecha", "numero_comprobante", "cliente", "empresa", "tipo_documento", "moneda_iso",
                   "razon_social", "es_nota_credito", "monto_total_ars", "monto_neto_ars", "monto_usd",
                   "importe_pendiente", "anio", "mes", "mes_nombre", "linea_negocio", "iva", "condicion_pago", "producto",
                   "descripcion_item", "descripcion", "situacion", "dim_valor", "cantidad"]
# Text columns of the export that pass through unchanged; absent ones are null.
PLAIN_COLUMNS = ["condicion_pago", "producto", "descripcion_item", "descripcion", "situacion", "dim_valor"]


def _map_or_keep(c, mapping: dict) -> F.Column:
    """Dictionary lookup with pass-through of unmapped values."""
    lookup = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(lookup, c), c)


def landing_from_export(df: DataFrame) -> DataFrame:
    """Rename export headers to landing names (missing optional columns are fine)."""
    return df.withColumnsRenamed({k: v for k, v in INVOICE_EXPORT_COLUMNS.items() if k in df.columns})


def clean_invoices(raw: DataFrame, company_map: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Typed invoice lines.

    Day-first dates (bad -> null), amounts coerced (bad -> 0), names trimmed and
    title-cased, currency/company mapped with pass-through, credit-note flag,
    derived amounts, year/month/label, business line without its ``NN_``
    prefix. Optional amount columns that are absent count as 0. ``company_map``
    gives the scope of each company label; export headers are accepted. Columns
    named in ``keep`` pass through.
    """
    raw = landing_from_export(raw)
    cols = set(raw.columns)

    def money(c):
        if c not in cols:
            return F.lit(0).cast(MONEY)
        return to_money(c)

    def text(c):
        return strip(F.col(c)) if c in cols else F.lit(None).cast("string")

    dated = raw.schema["fecha"].dataType
    if isinstance(dated, StringType):
        # Once, and not per pattern: a generated method over 8000 bytes is never compiled by the JIT.
        raw = raw.withColumn("fecha", strip("fecha"))
    fecha = parse_dayfirst("fecha", dated, stripped=isinstance(dated, StringType))
    moneda = text("moneda")
    empresa = text("empresa")
    documento = strip("documento") if "documento" in cols else F.lit(None).cast("string")
    nivel = text("nivel_1_dimension")
    df = raw.select(
        fecha.alias("fecha"),
        F.col("comprobante").cast("string").alias("numero_comprobante"),
        title_case("cliente").alias("cliente"),
        empresa.alias("empresa"),
        documento.alias("tipo_documento"),
        moneda.alias("moneda"),
        nivel.alias("nivel_dimension"),
        money("gravado").alias("_gravado"),
        money("no_gravado").alias("_no_gravado"),
        money("importe_principal").alias("monto_total_ars"),
        money("imp_usd").alias("monto_usd"),
        money("importe_pendiente").alias("importe_pendiente"),
        money("iva").alias("iva"), money("cantidad").alias("cantidad"),
        *[(F.col(c).cast("string") if c in cols else F.lit(None).cast("string")).alias(c) for c in PLAIN_COLUMNS],
        *(keep or []),
    )
    return df.select(
        "fecha", "numero_comprobante", "cliente", "empresa", "tipo_documento",
        _map_or_keep(F.col("moneda"), CURRENCY_MAP).alias("moneda_iso"),
        _map_or_keep(F.col("empresa"), company_map).alias("razon_social"),
        F.coalesce(F.col("tipo_documento").isin(*CREDIT_NOTE_TYPES), F.lit(False)).alias("es_nota_credito"),
        "monto_total_ars",
        (F.col("_gravado") + F.col("_no_gravado")).cast(MONEY).alias("monto_neto_ars"),
        "monto_usd", "importe_pendiente",
        F.year("fecha").alias("anio"), F.month("fecha").alias("mes"),
        month_label("fecha").alias("mes_nombre"),
        F.regexp_replace(F.col("nivel_dimension"), r"^\d+_", "").alias("linea_negocio"),
        "iva", *PLAIN_COLUMNS, "cantidad", "moneda", "nivel_dimension", *(keep or []),
    )


def customer_summary(inv: DataFrame) -> DataFrame:
    """Billing per (cliente, razon_social), credit notes excluded: ARS billed,
    pending and invoice count; USD billed and pending; absent side -> 0.

    One conditional aggregate over the ARS and USD rows replaces the two
    grouped frames and their full outer join (same rows, one shuffle).
    """
    ars = F.col("moneda_iso") == "ARS"
    usd = F.col("moneda_iso") == "USD"
    zero = F.lit(0).cast(MONEY)
    fact = inv.filter(~F.col("es_nota_credito") & F.col("moneda_iso").isin("ARS", "USD")
                      & F.col("cliente").isNotNull() & F.col("razon_social").isNotNull())
    return fact.groupBy("cliente", "razon_social").agg(
        F.coalesce(F.sum(F.when(ars, F.col("monto_total_ars"))), zero).alias("facturado_ars"),
        F.coalesce(F.sum(F.when(ars, F.col("importe_pendiente"))), zero).alias("pendiente_ars"),
        F.count(F.when(ars, F.col("numero_comprobante"))).alias("cantidad_fact"),
        F.coalesce(F.sum(F.when(usd, F.col("monto_usd"))), zero).alias("facturado_usd"),
        F.coalesce(F.sum(F.when(usd, F.col("importe_pendiente"))), zero).alias("pendiente_usd"),
    )
