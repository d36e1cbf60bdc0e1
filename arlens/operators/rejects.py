"""Values the cleaning could not read (P1 P2 P13): every date that became null and every
amount that became 0 is kept with its text and the reason, so none is lost unseen.

The rejects of a row are an array beside its cleaned columns. One write stores both and
counts them on the way (``clean_with_rejects``); the good rows and the reject table are
two projections of what was written, and neither reads the export again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from arlens.functions.amounts import AMOUNT, MONEY, local_amount_text
from arlens.functions.dates import parse_dayfirst
from arlens.functions.text import strip
from arlens.operators.invoices import clean_invoices, landing_from_export

# --- fixed values: reasons ----------------------------------------------------------
DATE_UNREAD = "fecha_no_leida"
AMOUNT_UNREAD = "importe_no_leido"
AMOUNT_TOO_LARGE = "importe_excede"
# --- end of fixed values ------------------------------------------------------------
INVOICE_DATES = ["fecha"]
INVOICE_AMOUNTS = ["gravado", "no_gravado", "importe_principal", "imp_usd", "importe_pendiente", "iva", "cantidad"]
REJECT = "struct<columna:string,valor:string,motivo:string>"


def _text(c: str) -> Column:
    return F.col(c).cast("string")


def _reject(c: str, bad: Column, reason: Column) -> Column:
    return F.when(bad & (F.coalesce(strip(_text(c)), F.lit("")) != ""), F.struct(F.lit(c).alias("columna"), _text(c).alias("valor"), reason.alias("motivo")))


def bad_date(c: str) -> Column:
    return _reject(c, parse_dayfirst(_text(c)).isNull(), F.lit(DATE_UNREAD))


def _reason(number: Column) -> Column:
    """A number money cannot hold, or no number at all."""
    wide = number.try_cast("double")
    return F.when(wide.isNotNull() & ~F.isnan(wide) & (F.abs(wide) < float("inf")), F.lit(AMOUNT_TOO_LARGE)).otherwise(F.lit(AMOUNT_UNREAD))


def bad_amount(c: str) -> Column:
    return _reject(c, _text(c).try_cast(MONEY).isNull(), _reason(_text(c)))


def bad_local_amount(c: str) -> Column:
    """Rejects of amounts with local separators; ``nan`` and ``None`` mean none there."""
    number = local_amount_text(c)
    blank = strip(_text(c)).isin("nan", "None")
    return F.when(~blank, _reject(c, number.try_cast(AMOUNT).isNull(), _reason(number)))


def with_rejects(df: DataFrame, found: list[Column], into: str = "rechazos") -> DataFrame:
    """``df`` with the array of its rejects, empty if all was read."""
    return df.withColumn(into, F.filter(F.array(*[c.cast(REJECT) for c in found]), lambda x: x.isNotNull()) if found
                         else F.array().cast(f"array<{REJECT}>"))


def reject_rows(df: DataFrame, dataset: str, ref: str, into: str = "rechazos") -> DataFrame:
    """(dataset, referencia, columna, valor, motivo), one row per value not read."""
    return df.select(F.lit(dataset).alias("dataset"), _text(ref).alias("referencia"), F.explode(into).alias("r")).select(
        "dataset", "referencia", "r.columna", "r.valor", "r.motivo")


def invoice_rejects(raw: DataFrame) -> list[Column]:
    have = set(raw.columns)
    return [bad_date(c) for c in INVOICE_DATES if c in have] + [bad_amount(c) for c in INVOICE_AMOUNTS if c in have]


def invoices_with_rejects(raw: DataFrame, company_map: dict[str, str]) -> DataFrame:
    """Cleaned invoices with ``rechazos``."""
    marked = with_rejects(landing_from_export(raw), invoice_rejects(landing_from_export(raw)))
    return clean_invoices(marked, company_map, keep=["rechazos"])


def clean_with_rejects(raw: DataFrame, company_map: dict[str, str], path: str) -> tuple[DataFrame, DataFrame, dict]:
    """Write the cleaned invoices once; (good rows, reject table, counts seen by the write)."""
    seen = Observation("rechazos")
    one = invoices_with_rejects(raw, company_map)

    def count(reason: str) -> Column:
        return F.coalesce(F.sum(F.size(F.filter("rechazos", lambda x: x["motivo"] == reason))), F.lit(0)).alias(reason)

    reasons = [count(r) for r in (DATE_UNREAD, AMOUNT_UNREAD, AMOUNT_TOO_LARGE)]
    one.observe(seen, F.count(F.lit(1)).alias("filas"), *reasons).write.mode("overwrite").parquet(path)
    back = raw.sparkSession.read.parquet(path)
    return back.drop("rechazos"), reject_rows(back, "facturas", "numero_comprobante"), seen.get


def reject_summary(rejects: DataFrame) -> DataFrame:
    """Rejects per dataset, column and reason with an example (the smallest text)."""
    return rejects.groupBy("dataset", "columna", "motivo").agg(F.count(F.lit(1)).alias("valores"), F.min("valor").alias("ejemplo"))
