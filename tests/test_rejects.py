"""Values that could not be read are kept with their text; nothing is lost unseen."""

import datetime as dt
import os
from decimal import Decimal as D

from pyspark.sql import functions as F

from arlens.functions.dates import parse_dayfirst
from arlens.operators import rejects as rj
from arlens.operators.quality import quality_report

HUGE = "1" + "0" * 30
ROWS = [("A-1", "05/03/2001", "10.5", "1", "ana"), ("A-2", "sin fecha", "n/d", "", "ana"), ("A-3", None, HUGE, " 7 ", "zoe"),
        ("A-4", " \t", "nan", "x", "zoe"), ("A-5", "31/02/2001", "-3", None, None), ("A-5", "31/02/2001", "-3", None, None)]


def _raw(spark):
    return spark.createDataFrame(ROWS, "comprobante string, fecha string, importe_principal string, gravado string, cliente string")


WANT = [("A-2", "fecha", "sin fecha", rj.DATE_UNREAD), ("A-2", "importe_principal", "n/d", rj.AMOUNT_UNREAD), ("A-3", "importe_principal", HUGE, rj.AMOUNT_TOO_LARGE),
        ("A-4", "importe_principal", "nan", rj.AMOUNT_UNREAD), ("A-4", "gravado", "x", rj.AMOUNT_UNREAD), ("A-5", "fecha", "31/02/2001", rj.DATE_UNREAD),
        ("A-5", "fecha", "31/02/2001", rj.DATE_UNREAD)]


def test_one_write_gives_rows_rejects_and_counts(spark, scratch):
    good, bad, seen = rj.clean_with_rejects(_raw(spark), {}, os.path.join(scratch, "facturas"))
    assert "rechazos" not in good.columns and good.count() == len(ROWS)
    assert sorted(tuple(r)[1:] for r in bad.collect()) == sorted(WANT)
    assert seen == {"filas": 6, rj.DATE_UNREAD: 3, rj.AMOUNT_UNREAD: 3, rj.AMOUNT_TOO_LARGE: 1}
    # A null or a 0 without a reject was blank in the export.
    blank = {(r[0], c) for r in ROWS for c, v in zip(("fecha", "importe_principal", "gravado"), r[1:4], strict=True) if v is None or not v.strip()}
    kept = {(r["numero_comprobante"], "fecha") for r in good.collect() if r["fecha"] is None}
    assert kept == {x[:2] for x in WANT if x[1] == "fecha"} | {x for x in blank if x[1] == "fecha"}


def test_report_counts_them_and_fails_on_lost_amounts(spark):
    raw = _raw(spark)
    rows = rj.reject_rows(rj.with_rejects(raw, rj.invoice_rejects(raw)), "facturas", "comprobante")
    check = {r["check_id"]: r for r in quality_report(None, None, None, spark, rows).collect()}["valores_no_leidos"]
    assert (check["passed"], check["detail"]) == (False, "7")
    fine = {r["check_id"]: r for r in quality_report(None, None, None, spark, rows.filter(F.col("motivo") != rj.AMOUNT_TOO_LARGE)).collect()}["valores_no_leidos"]
    assert (fine["passed"], fine["detail"]) == (True, "6")
    got = {(r["columna"], r["motivo"]): (r["valores"], r["ejemplo"]) for r in rj.reject_summary(rows).collect()}
    assert got["fecha", rj.DATE_UNREAD] == (3, "31/02/2001") and len(got) == 4


def test_local_amounts(spark):
    df = spark.createDataFrame([("$ 1.234,50",), ("1-2",), ("nan",), (" \t",), (None,), ("9" * 25 + ",1",), ("sin saldo",)], "saldo string")
    got = [(r["valor"], r["motivo"]) for r in rj.reject_rows(rj.with_rejects(df, [rj.bad_local_amount("saldo")]), "composicion", "saldo").collect()]
    assert got == [("1-2", rj.AMOUNT_UNREAD), ("9" * 25 + ",1", rj.AMOUNT_TOO_LARGE), ("sin saldo", rj.AMOUNT_UNREAD)]


def test_layouts_of_dates(spark):
    texts = ["\t05/03/2001", "5/3/2001 10:15 PM", "05-mar-2001", "5 Mar 2001", " 05/03/2001\n", "5/3/2001 22:15:00"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_dayfirst("t")).collect()] == [dt.date(2001, 3, 5)] * len(texts)


def test_large_amounts_are_exact_up_to_the_limit(spark):
    raw = spark.createDataFrame([("A", "9" * 26 + ".99")], "comprobante string, gravado string")
    assert rj.with_rejects(raw, rj.invoice_rejects(raw)).first()["rechazos"] == []
    assert raw.select(F.col("gravado").try_cast("decimal(28,2)")).first()[0] == D("9" * 26 + ".99")
