"""The quality report fails when it should, and never stops on missing data."""

import datetime as dt

from arlens.operators.quality import quality_report

BAL = "cliente string, saldo_actual double, saldo_vencido double, dias_vencido int, aging string, dif_conciliacion double"


def _report(*frames, **kw):
    return {r["check_id"]: r["passed"] for r in quality_report(*frames, **kw).collect()}


def test_each_check_can_fail(spark):
    inv = spark.createDataFrame([(dt.date(2001, 1, 1), -5.0)], "fecha date, monto_total_ars double")
    bal = spark.createDataFrame([("a", 1.0, 2.0, -3, "x", 5.0)], BAL)
    items = spark.createDataFrame([("c", -1.0)], "centro_costo string, saldo_abierto double")
    got = _report(inv, bal, items)
    assert {k for k, v in got.items() if not v} == {"Q3_facturacion_positiva", "Q4_vencido_menor_saldo", "Q5_dias_no_negativos",
                                                    "Q6_conciliacion_tolerancia", "Q7_composicion_positiva", "Q8_estado_general"}


def test_good_data_passes(spark):
    inv = spark.createDataFrame([(dt.date(2001, 1, 1), 5.0)], "fecha date, monto_total_ars double")
    bal = spark.createDataFrame([("a", 2.0, 1.0, 3, "x", 0.5)], BAL)
    assert all(_report(inv, bal, None).values())


def test_missing_columns_and_datasets_are_reported(spark):
    inv = spark.createDataFrame([(dt.date(2001, 1, 1),)], "fecha date")
    got = _report(inv, None, spark.createDataFrame([(1.0,)], "saldo_abierto double"))
    assert not got["Q2_facturas_columnas"] and not got["Q1_saldos_presentes"] and not got["Q2_saldos_columnas"]
    assert not got["Q2_composicion_columnas"] and got["Q7_composicion_positiva"] and not got["Q8_estado_general"]
    assert not _report(None, None, None, spark=spark)["Q1_facturas_presentes"]


def test_each_dataset_is_read_once(spark):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def touch(x):
        seen.add(1)
        return x

    inv = spark.createDataFrame([(dt.date(2001, 1, 1), 5.0)], "fecha date, monto_total_ars double")
    rejects = spark.range(7).select(F.udf(touch, "string")(F.col("id").cast("string")).alias("motivo"))
    got = _report(inv, None, None, rejects=rejects)
    assert got["valores_no_leidos"] and not got["Q8_estado_general"]
    assert seen.value == 7
