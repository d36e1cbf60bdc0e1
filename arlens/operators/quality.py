"""Post-run financial quality checks (Q1-Q8) and upload column checks (S5 U6).

Each dataset's checks are one aggregate pass; the report is one DataFrame
``(check_id, passed, detail)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from arlens.functions.constants import (QUALITY_BALANCE_COLUMNS, QUALITY_INVOICE_COLUMNS, QUALITY_ITEM_COLUMNS,
                                        RECONCILE_TOLERANCE)
from arlens.operators.rejects import AMOUNT_TOO_LARGE

WIDE_MONEY = DecimalType(38, 2)


def _check(check_id: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(check_id).alias("check_id"), passed.alias("passed"), detail.cast("string").alias("detail"))


def _columns_check(have: list[str], check_id: str, required: list[str]) -> Column:
    missing = [c for c in required if c not in have]
    return _check(check_id, F.lit(not missing), F.lit(",".join(missing)))


def _with_columns(df: DataFrame | None, spark: SparkSession, columns: list[str]) -> DataFrame:
    """``df`` with nulls for the columns it lacks; an empty frame if it is missing."""
    if df is None:
        return spark.createDataFrame([], ", ".join(f"{c} double" for c in columns))
    return df.withColumns({c: F.lit(None).cast("double") for c in columns if c not in df.columns})


def quality_report(inv: DataFrame | None, bal: DataFrame | None, items: DataFrame | None,
                   spark: SparkSession | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """Invoices present, required columns, positive billing; balances present,
    overdue <= balance, no negative days, reconciliation within tolerance;
    composition items with positive open balance (missing items are only a
    warning); overall status. A missing dataset or column fails its checks
    instead of stopping the report; ``spark`` is needed if all are missing. With
    ``rejects`` the values that could not be read are counted; an amount that money
    cannot hold fails the check, unread texts are only a warning."""
    spark = spark or next(df.sparkSession for df in (inv, bal, items) if df is not None)
    own = {"inv": inv.columns if inv is not None else [], "bal": bal.columns if bal is not None else []}
    inv = _with_columns(inv, spark, QUALITY_INVOICE_COLUMNS)
    bal = _with_columns(bal, spark, [*QUALITY_BALANCE_COLUMNS, "dif_conciliacion"])
    fi = inv.agg(F.count(F.lit(1)).alias("n"), F.sum("monto_total_ars").cast(WIDE_MONEY).alias("total"))
    fb = bal.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col("saldo_vencido"), F.lit(0)) > F.coalesce(F.col("saldo_actual"), F.lit(0)) + F.lit(1e-6))
         .alias("over"),
        F.count_if(F.coalesce(F.col("dias_vencido"), F.lit(0)) < 0).alias("neg"),
        F.max(F.abs(F.coalesce(F.col("dif_conciliacion"), F.lit(0)))).cast(WIDE_MONEY).alias("maxdif"))
    facts = {"fi": fi, "fb": fb}
    if items is not None:
        have = items.columns
        facts["fc"] = _with_columns(items, spark, QUALITY_ITEM_COLUMNS).agg(
            F.count(F.lit(1)).alias("n"), F.sum("saldo_abierto").cast(WIDE_MONEY).alias("total"))
    if rejects is not None:
        facts["fr"] = rejects.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("motivo") == AMOUNT_TOO_LARGE).alias("lost"))
    checks = [
        _check("Q1_facturas_presentes", F.col("fi.n") > 0, F.col("fi.n")),
        _columns_check(own["inv"], "Q2_facturas_columnas", QUALITY_INVOICE_COLUMNS),
        _check("Q3_facturacion_positiva", F.coalesce(F.col("fi.total") > 0, F.lit(False)), F.col("fi.total")),
        _check("Q1_saldos_presentes", F.col("fb.n") > 0, F.col("fb.n")),
        _columns_check(own["bal"], "Q2_saldos_columnas", QUALITY_BALANCE_COLUMNS),
        _check("Q4_vencido_menor_saldo", F.col("fb.over") == 0, F.col("fb.over")),
        _check("Q5_dias_no_negativos", F.col("fb.neg") == 0, F.col("fb.neg")),
        _check("Q6_conciliacion_tolerancia",
               F.coalesce(F.col("fb.maxdif") <= F.lit(RECONCILE_TOLERANCE), F.lit(True)), F.col("fb.maxdif")),
    ]
    if items is not None:
        checks += [
            _columns_check(have, "Q2_composicion_columnas", QUALITY_ITEM_COLUMNS),
            _check("Q7_composicion_positiva", F.coalesce(F.col("fc.total") > 0, F.lit(False)), F.col("fc.total")),
        ]
    if rejects is not None:
        checks.append(_check("valores_no_leidos", F.col("fr.lost") == 0, F.col("fr.n")))
    # One row of facts: each dataset is aggregated once for its checks and the overall status.
    row = spark.range(1).select(*[df.select(F.struct(*df.columns)).scalar().alias(name) for name, df in facts.items()])
    done = row.select(F.array(*checks).alias("checks"))
    overall = _check("Q8_estado_general", F.forall("checks", lambda x: x["passed"]), F.size(F.filter("checks", lambda x: ~x["passed"])))
    return done.select(F.explode(F.concat("checks", F.array(overall))).alias("c")).select("c.*")


def missing_columns(spark: SparkSession, required: dict[str, list[str]], actual: dict[str, list[str]]) -> DataFrame:
    """``(dataset, column)`` for each required column absent from a dataset's
    header (header-only: ``df.columns`` needs no job)."""
    req = spark.createDataFrame([(d, c) for d, cols in required.items() for c in cols], "dataset string, column string")
    have = spark.createDataFrame([(d, c) for d, cols in actual.items() for c in cols] or [("", "")],
                                 "dataset string, column string")
    return req.exceptAll(have)
