"""Sinks / sources round trips, metadata, state documents, discovery, staleness."""

import os
import time

from pyspark.sql import functions as F

from arlens.operators.quality import missing_columns
from arlens.sources import discovery, io
from arlens.functions.constants import REQUIRED_INVOICE_COLUMNS


def test_save_load_roundtrip(spark, scratch):
    df = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00")], "id int, s string, t string") \
              .withColumn("t", F.to_timestamp("t"))
    n = io.save(df, scratch, "facturas", observe_rows=True)
    assert n == 1
    back = io.load(spark, scratch, "facturas")
    assert back.collect()[0]["s"] == "a"
    assert dict(back.dtypes)["t"] == "timestamp_ntz"
    assert io.load(spark, scratch, "nada") is None


def test_csv_export_and_fallback(spark, scratch):
    df = spark.createDataFrame([("x", 1.5)], "cliente string, saldo double")
    io.export_csv(df, os.path.join(scratch, "cc_saldos.csv"))
    back = io.load(spark, scratch, "cc_saldos", csv_schema="cliente string, saldo double")
    assert back.collect()[0]["saldo"] == 1.5


def test_meta_and_state(spark, scratch):
    io.save_meta(spark, scratch, {"filas": 3, "ultima_actualizacion": "2001-09-01"})
    assert io.load_meta(spark, scratch) == {"filas": "3", "ultima_actualizacion": "2001-09-01"}
    doc = io.load_state(spark, scratch, "permisos", default='{"superusers": []}')
    assert doc.collect()[0]["valor"] == '{"superusers": []}'
    io.save_state(spark, scratch, "permisos", '{"superusers": ["admin"]}')
    assert io.load_state(spark, scratch, "permisos").collect()[0]["valor"] == '{"superusers": ["admin"]}'


def test_missing_columns(spark):
    got = missing_columns(spark, {"facturas": REQUIRED_INVOICE_COLUMNS},
                          {"facturas": ["Fecha", "Cliente", "Empresa", "Moneda", "Documento"]})
    assert sorted(r["column"] for r in got.collect()) == ["Imp. usd", "Importe mon. principal", "Nivel 1 dimensión"]


def _touch(path, t=None):
    with open(path, "wb") as fh:
        fh.write(b"x")
    if t is not None:
        os.utime(path, (t, t))


def test_source_pick(spark, scratch):
    for n in ["cc_clientes.xlsx", "Reporte_b.xlsx", "Reporte_a.xlsx", "saldos_viejos.xlsx", "otro.txt"]:
        _touch(os.path.join(scratch, n))
    files = discovery.list_files(spark, scratch)
    assert discovery.pick_composition_source(files).collect()[0]["name"] == "Reporte_a.xlsx"
    _touch(os.path.join(scratch, "composicion_de_saldos.xlsx"))
    files = discovery.list_files(spark, scratch)
    assert discovery.pick_composition_source(files).collect()[0]["name"] == "composicion_de_saldos.xlsx"


def test_pick_sheet(spark):
    g = spark.createDataFrame([("a", "Resumen", 0, 1), ("a", "HOJA1", 1, 2), ("b", "X", 0, 3), ("b", "Y", 1, 4)],
                              "file string, sheet string, sheet_ordinal int, v int")
    assert sorted(r["v"] for r in discovery.pick_sheet(g).collect()) == [2, 3]


def test_staleness(spark, scratch):
    raw, out = os.path.join(scratch, "raw"), os.path.join(scratch, "out")
    os.makedirs(raw)
    os.makedirs(out)
    now = time.time()
    _touch(os.path.join(raw, "datos_facturacion.xlsx"), now - 100)
    _touch(os.path.join(out, "facturas.parquet"), now - 50)
    st = discovery.staleness(discovery.list_files(spark, raw), discovery.list_files(spark, out)).collect()[0]
    assert st["stale"] is False
    _touch(os.path.join(raw, "datos_facturacion.xlsx"), now)
    st = discovery.staleness(discovery.list_files(spark, raw), discovery.list_files(spark, out)).collect()[0]
    assert st["stale"] is True
