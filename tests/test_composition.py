"""Composition grid: header discovery rules, forward fill, flexible check."""

import datetime as dt

from pyspark.sql import functions as F

from arlens.operators.composition import (composition_items, composition_summary, customer_centers,
                                          detect_header, flexible_check)

GRID = "file string, sheet string, row_idx int, cells array<string>"


def grid(spark, rows):
    return spark.createDataFrame(rows, GRID)


def test_header_after_title_rows_exact_before_substring(spark):
    g = grid(spark, [
        ("f", "s1", 0, ["Reporte", None, None]),
        ("f", "s1", 1, ["Saldo pendiente total", "Cliente", "Saldo"]),   # exact 'saldo' beats substring col 0
        ("f", "s1", 2, ["1.000,50", "acme s.a.", "10"]),
        ("f", "s2", 0, ["Nombre cliente", "Deuda vieja", "Importe total"]),  # substring: first column in order
        ("f", "s3", 0, ["nada", "que", "ver"]),                           # no header -> sheet dropped
    ])
    h = {r["sheet"]: r for r in detect_header(g).collect()}
    assert set(h) == {"s1", "s2"}
    assert h["s1"]["header_row"] == 1 and h["s1"]["col_saldo"] == "Saldo" and h["s1"]["col_cliente"] == "Cliente"
    assert h["s2"]["header_row"] == 0 and h["s2"]["col_saldo"] == "Deuda vieja"
    assert h["s1"]["col_centro"] is None


def test_ffill_items_and_summary(spark):
    g = grid(spark, [
        ("f", "s", 0, ["Cliente", "Centro", "Saldo", "Vencimiento", "Documento"]),
        ("f", "s", 1, ["acme s.a.", "SOPORTE", "$ 1.000,00", "01/08/2001", "F1"]),
        ("f", "s", 2, ["", None, "500,5", "", "F2"]),
        ("f", "s", 3, [None, "STAFFING", "200", "15/09/2001", "F3"]),
        ("f", "s", 4, ["beta", "STAFFING", "0", "01/01/2001", "F4"]),
    ])
    items = composition_items(g, dt.date(2001, 9, 1)).orderBy("row_idx").collect()
    assert [(r["cliente"], r["centro_costo"], float(r["saldo_abierto"])) for r in items] == [
        ("Acme S.A.", "SOPORTE", 1000.0), ("Acme S.A.", "SOPORTE", 500.5), ("Acme S.A.", "STAFFING", 200.0)]
    assert [r["dias_vencido_item"] for r in items] == [31, None, -14]
    s = composition_summary(composition_items(g, dt.date(2001, 9, 1))).collect()[0]
    assert float(s["saldo_composicion"]) == 1700.5 and float(s["saldo_vencido_comp"]) == 1000.0
    assert s["dias_vencido_comp"] == 31 and s["centro_costo_principal"] == "SOPORTE"
    assert s["centros_costo"] == "SOPORTE | STAFFING"


def test_center_ties_by_name(spark):
    items = spark.createDataFrame([("a", "B", 5.0), ("a", "A", 5.0), ("a", " ", 9.0)],
                                  "cliente string, centro_costo string, saldo_abierto double")
    r = customer_centers(items).collect()[0]
    assert r["centro_costo_principal"] == " " and r["centros_costo"] == "A | B"


def test_flexible_check(spark):
    g = grid(spark, [("f", "ok", 3, ["Razón Social", "Importe pendiente"]),
                     ("f", "late", 7, ["Cliente", "Saldo"]),
                     ("f", "half", 0, ["Cliente", "Otro"])])
    got = {r["sheet"]: r["ok"] for r in flexible_check(g).collect()}
    assert got == {"ok": True, "late": False, "half": False}
