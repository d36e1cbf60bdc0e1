"""Functions called from SQL against the column functions they stand for."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arlens.functions import sql
from arlens.functions.amounts import parse_local_amount
from arlens.functions.dates import aging_bucket, days_overdue
from arlens.functions.text import client_key
from arlens.operators import aging
from arlens.operators.ledger import movement_type
from arlens.plans import catalog
from conftest import SF_SMALL

HARD = [None, "", "  ", "nan", " None ", "O'Higgins \\ Cía. S.A.", "ｆｕｌｌ＇ｗｉｄｔｈ", "Ñandú é", "\t x\u0085", "a - b", "cobranza - 1", " NCVEE-2", "saldo inicial",
        "Saldo Inicial", "ncvee   - 9", "Factura - cobranza - 3", "$ 1.234,50", "1.234", "-1.234,5", "1,2,3", "1e5", "12.", "--3", "9" * 40, "\"quoted\"", "%_'", "日本"]


@pytest.fixture(scope="module")
def text(spark):
    sql.register(spark)
    df = spark.createDataFrame([(x,) for x in HARD], "x string")
    df.createOrReplaceTempView("hard_text")
    return df


@pytest.mark.parametrize("call, column", [("clave_cliente(x)", client_key), ("tipo_movimiento(x)", movement_type), ("monto_local(x)", parse_local_amount)])
def test_text_functions(spark, text, call, column):
    for row in text.select("x", F.expr(call).alias("sql"), column("x").alias("fn")).collect():
        assert row["sql"] == row["fn"], row["x"]


def test_days_and_buckets(spark, text):
    days = spark.createDataFrame([(d,) for d in (None, -5, 0, 1, 30, 31, 60, 61, 90, 91, 4000)], "d int")
    assert all(r[0] == r[1] for r in days.select(F.expr("tramo_antiguedad(d)"), aging_bucket("d")).collect())
    dates = spark.createDataFrame([(None,), (dt.date(2001, 9, 1),), (dt.date(1999, 2, 28),), (dt.date(2004, 2, 29),)], "v date")
    assert all(r[0] == r[1] for r in dates.select(F.expr("dias_vencido(DATE '2001-09-01', v)"), days_overdue("2001-09-01", "v")).collect())


def test_open_items_with_a_hot_customer(spark):
    rng = random.Random(2)
    day = dt.date(2001, 1, 1)
    rows = [(rng.choice(["Hot", "Hot", "B", "C", None, ""]), f"FAC - {i}", rng.choice([None, day + dt.timedelta(days=i % 90)]),
             rng.choice([None, day + dt.timedelta(days=rng.randrange(400))]), i, f"{rng.randrange(-5, 300)}.{rng.randrange(100):02d}", rng.choice(["Factura/Cargo", "Cobro/NC"])) for i in range(900)]
    led = spark.createDataFrame(rows, "cliente string, documento string, fecha date, fecha_vencimiento date, orden_origen long, d string, tipo string")
    led = led.withColumn("debe", F.col("d").cast("decimal(28,2)")).drop("d")
    due = spark.createDataFrame([("Hot", "20000.10"), ("B", "150.00"), ("C", "-3.00"), ("D", "9.00")], "cliente string, s string")
    due = due.select("cliente", F.col("s").cast("decimal(28,2)").alias("saldo_actual"))
    got = spark.sql(f"SELECT * FROM {sql.register_views(led, due)}(DATE '2001-09-01')")
    want = aging.open_items(aging.lifo_slices(led, due), "2001-09-01")
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 10
    assert spark.sql("SELECT count(*) FROM partidas_abiertas(DATE '2001-09-01') WHERE cliente = 'B' AND saldo_abierto > 150").first()[0] == 0


def test_inlined_without_python(spark):
    for name in ("sql_scalars", "sql_open_items"):
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "clave_cliente(" not in plan, name
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW libro AS SELECT * FROM parquet.`" + SF_SMALL + "/customer.parquet`")
    plan = spark.sql("SELECT clave_cliente(c_name) FROM libro WHERE tramo_antiguedad(int(c_custkey)) = '+90 días' AND c_custkey = 5")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,5)" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan
