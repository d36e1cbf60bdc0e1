"""Per-customer balances product (J3-J6 P17-P21 K1) and the composition
override (J5 P20)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.functions.amounts import AMOUNT, MONEY, clamp0, div_half_even
from arlens.functions.constants import SOURCE_COMPOSITION, SOURCE_LEDGER
from arlens.functions.dates import aging_bucket, as_of_lit
from arlens.operators.aging import aging_summary, lifo_slices
from arlens.operators.ledger import reconcile

BALANCE_COLUMNS = ["cliente", "saldo_actual", "saldo_inicial", "debe_total", "haber_total", "saldo_reconstruido",
                   "saldo_final_ledger", "dif_conciliacion", "conciliado", "saldo_pendiente_cc", "saldo_vencido",
                   "saldo_por_vencer", "venc", "prox_vencimiento", "dias_vencido", "dias_vencido_max",
                   "venc_referencia", "fuente_aging", "aging", "total_facturado", "total_cobrado", "ratio_cobranza"]
COMPOSITION_BALANCE_COLUMNS = ["saldo_composicion", "saldo_vencido_comp", "saldo_por_vencer_comp",
                               "dias_vencido_comp", "dias_vencido_max_comp", "venc_comp_min",
                               "centro_costo_principal", "centros_costo"]


def collection_ratio(collected, billed) -> F.Column:
    """collected / billed x 100, a zero divisor counts as 1, half-even to 0.1."""
    den = F.when(F.col(billed) == 0, F.lit(1).cast(MONEY)).otherwise(F.col(billed))
    return div_half_even(F.col(collected) * F.lit(100), den, 1)


def _base(led: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    rec = reconcile(led)
    debtors = rec.select("cliente", "saldo_actual")
    ag = aging_summary(lifo_slices(led, debtors), debtors, as_of).drop("aging")
    return rec, rec.join(ag, "cliente", "left")


def _finish(df: DataFrame, with_comp: bool) -> DataFrame:
    df = (df.withColumn("aging", aging_bucket("dias_vencido"))
            .withColumn("total_facturado", F.col("debe_total"))
            .withColumn("total_cobrado", F.col("haber_total"))
            .withColumn("ratio_cobranza", collection_ratio("total_cobrado", "total_facturado"))
            .filter(F.col("saldo_actual") > 0))
    cols = BALANCE_COLUMNS + (COMPOSITION_BALANCE_COLUMNS if with_comp else [])
    return df.select(*cols)


def client_balances(led: DataFrame, as_of) -> DataFrame:
    """Debtors with reconciliation, ledger-derived aging, totals and collection
    ratio. Missing aging values are filled: pending <- balance, overdue <- 0,
    not due <- balance - overdue (>= 0), due <- reference due or as-of, days <- 0.
    Per-customer frames share the ``cliente`` hash partitioning of the
    reconciliation aggregate, so the joins add no exchange of the ledger."""
    _, df = _base(led, as_of)
    zero = F.lit(0).cast(MONEY)
    df = df.select(
        *[c for c in df.columns if c not in ("saldo_pendiente_cc", "saldo_vencido", "saldo_por_vencer",
                                              "venc", "dias_vencido", "dias_vencido_max")],
        F.coalesce("saldo_pendiente_cc", "saldo_actual").alias("saldo_pendiente_cc"),
        F.coalesce("saldo_vencido", zero).alias("saldo_vencido"),
        clamp0(F.coalesce(F.col("saldo_por_vencer"),
                          F.col("saldo_actual") - F.coalesce("saldo_vencido", zero))).cast(MONEY).alias("saldo_por_vencer"),
        F.coalesce(F.col("venc_referencia"), as_of_lit(as_of)).alias("venc"),
        F.coalesce("dias_vencido", F.lit(0)).alias("dias_vencido"),
        F.coalesce("dias_vencido_max", F.lit(0)).alias("dias_vencido_max"),
    ).withColumn("fuente_aging", F.lit(SOURCE_LEDGER))
    return _finish(df, with_comp=False)


def rank_debtors(df: DataFrame) -> DataFrame:
    """Debtor ranking: overdue, balance, days overdue (all descending), name."""
    return df.orderBy(F.col("saldo_vencido").desc(), F.col("saldo_actual").desc(),
                      F.col("dias_vencido").desc(), F.col("cliente"))


def client_balances_with_composition(led: DataFrame, comp_summary: DataFrame, as_of) -> DataFrame:
    """Balances where customers with a positive composition balance take their
    overdue / not-due / days / max days / due date from the composition
    (``fuente_aging = composicion``); the rest keep the ledger values."""
    bal = client_balances(led, as_of).drop("aging", "ratio_cobranza")
    comp = comp_summary.select("cliente", *COMPOSITION_BALANCE_COLUMNS)
    df = bal.join(comp, "cliente", "left")
    has = F.coalesce(F.col("saldo_composicion"), F.lit(0)) > 0
    zero = F.lit(0).cast(MONEY)

    def pick(comp_col, own_col):
        return F.when(has, comp_col).otherwise(F.col(own_col))

    df = (df.withColumn("saldo_vencido", pick(F.coalesce("saldo_vencido_comp", zero), "saldo_vencido"))
            .withColumn("saldo_por_vencer", pick(F.coalesce("saldo_por_vencer_comp", zero), "saldo_por_vencer"))
            .withColumn("dias_vencido", pick(F.coalesce("dias_vencido_comp", F.lit(0)), "dias_vencido"))
            .withColumn("dias_vencido_max", pick(F.coalesce("dias_vencido_max_comp", F.lit(0)), "dias_vencido_max"))
            .withColumn("venc", pick(F.coalesce("venc_comp_min", "venc"), "venc"))
            .withColumn("fuente_aging", F.when(has, F.lit(SOURCE_COMPOSITION)).otherwise(F.lit(SOURCE_LEDGER))))
    return _finish(df, with_comp=True)


def debt_base(bal: DataFrame) -> DataFrame:
    """What every debt view adds up, per debtor: balance, overdue, not due, days
    and longest days from the composition where its balance is positive, else
    from the ledger; aging and source follow. ``bal`` comes from
    :func:`client_balances_with_composition`."""
    has = F.coalesce(F.col("saldo_composicion"), F.lit(0)) > 0

    def pick(comp: str, own: str, kind) -> F.Column:
        return F.when(has, F.coalesce(F.col(comp), F.lit(0))).otherwise(F.col(own)).cast(kind)

    return bal.select(
        "cliente",
        pick("saldo_composicion", "saldo_actual", AMOUNT).alias("saldo_deuda"),
        pick("saldo_vencido_comp", "saldo_vencido", AMOUNT).alias("saldo_vencido_base"),
        pick("saldo_por_vencer_comp", "saldo_por_vencer", AMOUNT).alias("saldo_por_vencer_base"),
        pick("dias_vencido_comp", "dias_vencido", "int").alias("dias_vencido_base"),
        pick("dias_vencido_max_comp", "dias_vencido_max", "int").alias("dias_vencido_max_base"),
        F.when(has, F.lit(SOURCE_COMPOSITION)).otherwise(F.lit(SOURCE_LEDGER)).alias("fuente_cc_base"),
        "ratio_cobranza",
    ).withColumn("aging_base", aging_bucket("dias_vencido_base"))


def aging_sources(debt: DataFrame) -> DataFrame:
    """Debtors and debt by the source their aging comes from."""
    return debt.groupBy("fuente_cc_base").agg(F.count(F.lit(1)).alias("clientes"), F.sum("saldo_deuda").alias("saldo"))
