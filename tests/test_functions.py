"""Scalar expressions against the unit-test rows of FIXTURES.md section 7."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from arlens.functions.amounts import div_half_even, parse_local_amount, to_money
from arlens.functions.dates import aging_bucket, aging_rank, days_overdue, month_label, parse_dayfirst
from arlens.functions.text import client_key, header_key, header_key_alnum, line_label, title_case
from arlens.operators.ledger import movement_type


def col_values(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_title_case(spark):
    got = col_values(spark, ["payway s.a.u.", "  customer#000000001 s.a.u. ", "ÑANDÚ méxico", None, "1abc"], title_case)
    assert got == ["Payway S.A.U.", "Customer#000000001 S.A.U.", "Ñandú México", None, "1Abc"]


def test_client_key(spark):
    got = col_values(spark, ["PAYWAY S.A.", "Ñandú  México", None, "nan", "  None ", "Payway SAU"], client_key)
    assert got == ["PAYWAY S A", "NANDU MEXICO", "", "", "", "PAYWAY SAU"]


def test_header_keys(spark):
    assert col_values(spark, ["Razón Social", "Fecha Vto.", "  Saldo  Abierto ", "Nivel 1 dimensión"], header_key) == \
        ["razon_social", "fecha_vto", "saldo_abierto", "nivel_1_dimension"]
    assert col_values(spark, ["Razón Social", "Importe-Pendiente"], header_key_alnum) == ["razonsocial", "importependiente"]


def test_line_label(spark):
    assert col_values(spark, ["  soporte ", "", None], line_label) == ["SOPORTE", "SIN LINEA", "SIN LINEA"]


def test_local_amounts(spark):
    got = col_values(spark, ["$ 1.234,56", "1234,5", "1.234", "", "nan", "abc", "-5", None, "1.234.567"],
                     parse_local_amount)
    assert [float(v) for v in got] == [1234.56, 1234.5, 1.234, 0, 0, 0, -5, 0, 0]


def test_money_coercion(spark):
    got = col_values(spark, ["12.5", "n/d", "", None, " 7 "], to_money)
    assert got == [Decimal("12.50"), Decimal("0.00"), Decimal("0.00"), Decimal("0.00"), Decimal("7.00")]


def test_dayfirst_dates(spark):
    got = col_values(spark, ["05/01/2024", "5/1/2024", "2024-01-05", "sin fecha", "31/02/2024", None], parse_dayfirst)
    d = dt.date(2024, 1, 5)
    assert got == [d, d, d, None, None, None]
    assert col_values(spark, [d], month_label, "date") == ["Jan 2024"]


def test_aging_edges(spark):
    got = col_values(spark, [-1, 0, 1, 30, 31, 60, 61, 90, 91], aging_bucket, "int")
    assert got == ["Al día", "Al día", "1–30 días", "1–30 días", "31–60 días", "31–60 días",
                   "61–90 días", "61–90 días", "+90 días"]
    assert col_values(spark, ["Al día", "+90 días"], aging_rank) == [1, 5]


def test_days_overdue(spark):
    got = col_values(spark, [dt.date(2001, 8, 31), dt.date(2001, 9, 2), None],
                     lambda c: days_overdue(dt.date(2001, 9, 1), c), "date")
    assert got == [1, -1, None]


def test_movement_types(spark):
    got = col_values(spark, ["", "Saldo Inicial", "cobranza - 1", "NCVEE - 2", "FACVTA - 3", None,
                             "COBRANZA_FCE - 9", "saldo inicial"], movement_type)
    assert got == ["Saldo Inicial", "Saldo Inicial", "Cobro/NC", "Cobro/NC", "Factura/Cargo", "Saldo Inicial",
                   "Cobro/NC", "Factura/Cargo"]


def test_half_even_division(spark):
    df = spark.createDataFrame([(Decimal("5.00"), Decimal("2.00")), (Decimal("7.00"), Decimal("2.00")),
                                (Decimal("-5.00"), Decimal("2.00")), (Decimal("1.00"), Decimal("3.00")),
                                (Decimal("1.00"), Decimal("0.00"))], "n decimal(18,2), d decimal(18,2)")
    got = [r[0] for r in df.select(div_half_even(F.col("n"), F.col("d"), 0)).collect()]
    assert got == [2.0, 4.0, -2.0, 0.0, None]
    got1 = [r[0] for r in df.select(div_half_even(F.col("n") * 100, F.col("d"), 1)).collect()]
    assert got1 == [250.0, 350.0, -250.0, 33.3, None]


def test_optional_invoice_columns_default(spark):
    """Absent optional amount columns count as 0 (P19)."""
    from arlens.operators.invoices import clean_invoices
    raw = spark.createDataFrame([("Factura", "05/01/2024", "1-1", " acme ", "10.00", "Pesos", "Empresa Local", "03_SOPORTE")],
                                "documento string, fecha string, comprobante string, cliente string, "
                                "importe_principal string, moneda string, empresa string, nivel_1_dimension string")
    r = clean_invoices(raw, {"Empresa Local": "Local"}).collect()[0]
    assert r["monto_neto_ars"] == 0 and r["monto_usd"] == 0 and r["importe_pendiente"] == 0
    assert r["moneda_iso"] == "ARS" and r["razon_social"] == "Local" and r["linea_negocio"] == "SOPORTE"
    assert r["cliente"] == "Acme" and r["mes_nombre"] == "Jan 2024"


def test_strip_like_python(spark):
    vals = ["\t a b \n", "\xa0x ", "  ", None]
    from arlens.functions.text import strip
    assert col_values(spark, vals, strip) == ["a b", "x", "", None]
    assert col_values(spark, ["\tpayway s.a.u.\n"], title_case) == ["Payway S.A.U."]


def test_amounts_beyond_18_digits_and_rates_survive(spark):
    from arlens.functions.amounts import to_money, to_rate
    df = spark.createDataFrame([("12345678901234567.00", "0.00093"), ("x", None), (" ", "n/d"), ("9" * 40, "1")], "a string, r string")
    rows = df.select(to_money("a"), to_rate("r")).collect()
    assert [r[0] for r in rows] == [Decimal("12345678901234567.00"), 0, 0, 0]
    assert rows[0][1] == Decimal("0.00093") and rows[1][1] == 0


def test_more_date_layouts(spark):
    import datetime as dt
    from arlens.functions.dates import parse_dayfirst
    texts = ["01/02/03", "1.2.2003", "2003-02-01T10:20:30", "01/02/2003 7:05", "sin fecha", ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_dayfirst("t")).collect()]
    assert got == [dt.date(2003, 2, 1)] * 4 + [None, None]


def test_decomposed_accents(spark):
    from arlens.functions.text import client_key, header_key
    r = spark.createDataFrame([("Lo\u0301pez", "Razo\u0301n Social")], "a string, b string").select(client_key("a"), header_key("b")).first()
    assert tuple(r) == ("LOPEZ", "razon_social")


def test_export_headers_are_accepted(spark):
    from arlens.operators.invoices import clean_invoices
    raw = spark.createDataFrame([("05/01/2024", "acme", "Pesos", "7.5", "x")], "`Fecha` string, `Cliente` string, `Moneda` string, `Cantidadesagro` string, `Comprobante` string")
    r = clean_invoices(raw, {}).first()
    assert (r["cliente"], r["cantidad"], r["numero_comprobante"], r["producto"]) == ("Acme", Decimal("7.50"), "x", None)


def test_blank_documents_of_any_white_space_are_openings(spark):
    from arlens.operators.ledger import movement_type
    df = spark.createDataFrame([("\t",), ("\u00a0",), ("FACVTA - 1",)], "d string")
    assert [r[0] for r in df.select(movement_type("d")).collect()] == ["Saldo Inicial", "Saldo Inicial", "Factura/Cargo"]
