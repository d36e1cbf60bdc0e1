"""LIFO allocation of balances to open charges (W3 J7) and aging (A4 A6 P15 P16)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.amounts import MONEY, clamp0, div_half_even
from arlens.functions.constants import MOV_CHARGE, NO_CENTER
from arlens.functions.dates import aging_bucket, days_overdue
from arlens.functions.text import client_key
from arlens.operators.windows import SLICE, month_slice, slice_carry

ITEM_COLUMNS = ["cliente", "cliente_norm", "documento_ref", "venc_comp", "saldo_abierto",
                "dias_vencido_item", "centro_costo"]


def charges(led: DataFrame) -> DataFrame:
    """Positive charges of identified customers."""
    return led.filter((F.col("tipo") == MOV_CHARGE) & F.col("cliente").isNotNull()
                      & (F.col("cliente") != "") & (F.col("debe") > 0))


def lifo_slices(led: DataFrame, debtors: DataFrame) -> DataFrame:
    """Spend each debtor's balance on its charges, newest due date first.

    Order inside a customer: due date descending (missing last), movement date
    descending (missing last), source order. Each charge keeps
    ``min(charge, balance - charges before it)`` while that remainder is
    positive. ``debtors`` = ``(cliente, saldo_actual)`` with a positive balance.

    Charges are summed per customer and due month first (partial aggregates);
    the months that newer ones have not yet used up are joined with the charges,
    which are shuffled once, by customer and month. Most charges of long
    settled months never leave their task's shuffle output for the window, and
    a customer with a third of all charges is spread over its months. A debtor
    without charges has no open item; the aging summary left-joins it back.
    """
    c = (charges(led).select("cliente", "documento", "fecha", "fecha_vencimiento", "orden_origen", "debe")
         .withColumn(SLICE, month_slice("fecha_vencimiento", latest_first=True)))
    d = debtors.filter(F.col("saldo_actual") > 0).select("cliente", "saldo_actual")
    live = slice_carry(c, ["cliente"], "debe").join(d, "cliente").filter(F.col("_carry") < F.col("saldo_actual"))
    order = [F.col("fecha_vencimiento").desc_nulls_last(), F.col("fecha").desc_nulls_last(), F.col("orden_origen")]
    w = Window.partitionBy("cliente", SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    j = c.join(live, ["cliente", SLICE])
    remaining = F.col("saldo_actual") - F.col("_carry") - F.coalesce(F.sum("debe").over(w), F.lit(0))
    return (j.withColumn("_left", remaining).filter(F.col("_left") > 0)
             .withColumn("tramo", F.least(F.col("debe"), F.col("_left")).cast(MONEY))
             .drop("_left", "_carry", SLICE))


def open_items(slices: DataFrame, as_of, centers: DataFrame | None = None) -> DataFrame:
    """Open-item rows from LIFO slices; an item without due date counts 0 days.
    ``centers`` = ``(cliente, centro_costo_principal)`` gives each customer's
    main cost centre (default ``Sin centro``)."""
    out = slices.select(
        "cliente", client_key("cliente").alias("cliente_norm"),
        F.col("documento").alias("documento_ref"), F.col("fecha_vencimiento").alias("venc_comp"),
        F.col("tramo").alias("saldo_abierto"),
        F.coalesce(days_overdue(as_of, "fecha_vencimiento"), F.lit(0)).alias("dias_vencido_item"))
    if centers is None:
        return out.withColumn("centro_costo", F.lit(NO_CENTER))
    cmap = centers.select("cliente", F.col("centro_costo_principal").cast("string").alias("_centro")) \
                  .filter(F.col("_centro").isNotNull()).dropDuplicates(["cliente"])
    return (out.join(cmap, "cliente", "left")
               .withColumn("centro_costo", F.coalesce(F.col("_centro"), F.lit(NO_CENTER))).drop("_centro"))


def aging_summary(slices: DataFrame, debtors: DataFrame, as_of) -> DataFrame:
    """Per debtor: overdue and not-yet-due balance, balance-weighted days
    overdue (half-even), max days, oldest overdue due date, next due date,
    reference due date and aging bucket. Debtors without open slices have all
    their balance not due."""
    dias = days_overdue(as_of, "fecha_vencimiento")
    overdue = F.col("fecha_vencimiento").isNotNull() & (dias > 0)
    per = slices.groupBy("cliente").agg(
        F.sum(F.when(overdue, F.col("tramo"))).alias("_vencido"),
        F.sum(F.when(overdue, F.col("tramo") * dias)).alias("_peso"),
        F.max(F.when(overdue, dias)).alias("_dias_max"),
        F.min(F.when(overdue, F.col("fecha_vencimiento"))).alias("venc"),
        F.min(F.when(~overdue & F.col("fecha_vencimiento").isNotNull(), F.col("fecha_vencimiento")))
         .alias("prox_vencimiento"),
    )
    d = debtors.filter(F.col("saldo_actual") > 0).select("cliente", "saldo_actual")
    zero = F.lit(0).cast(MONEY)
    out = d.join(per, "cliente", "left")
    vencido = F.coalesce(F.col("_vencido"), zero).cast(MONEY)
    dias_pond = F.coalesce(div_half_even(F.col("_peso"), F.col("_vencido"), 0).cast("int"), F.lit(0))
    return out.select(
        "cliente",
        F.col("saldo_actual").alias("saldo_pendiente_cc"),
        vencido.alias("saldo_vencido"),
        clamp0(F.col("saldo_actual") - vencido).cast(MONEY).alias("saldo_por_vencer"),
        "venc", "prox_vencimiento",
        dias_pond.alias("dias_vencido"),
        F.coalesce(F.col("_dias_max"), F.lit(0)).alias("dias_vencido_max"),
        F.coalesce(F.col("venc"), F.col("prox_vencimiento")).alias("venc_referencia"),
    ).withColumn("aging", aging_bucket("dias_vencido"))


def open_items_source(comp_items: DataFrame | None, led: DataFrame, balances: DataFrame, as_of) -> DataFrame:
    """Open items for the views: the composition items when there are any,
    else items derived by LIFO from the ledger for the debtors in
    ``balances`` (which may already be scoped, e.g. by a centre filter that
    left no composition item). ``isEmpty`` is one bounded job."""
    if comp_items is not None and not comp_items.isEmpty():
        return comp_items
    centers = balances if "centro_costo_principal" in balances.columns else None
    debtors = balances.select("cliente", "saldo_actual")
    return open_items(lifo_slices(led, debtors), as_of, centers=centers)
