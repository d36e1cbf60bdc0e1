"""The daily rollup against rescans of the invoices."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arlens.operators import rollup as ro
from arlens.operators import scope, views
from arlens.plans import catalog
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def inv(spark):
    rng = random.Random(4)
    day = dt.date(1998, 12, 20)
    rows = [(rng.choice([None, *[day + dt.timedelta(days=rng.randrange(900))] * 12]), rng.choice(["Local", "Internacional", None]), rng.choice(["ARS", "USD", None]),
             rng.choice(["A", "B", None, ""]), f"{rng.randrange(-900, 9000)}.{rng.randrange(100):02d}", f"{rng.randrange(100)}.5") for _ in range(4000)]
    df = spark.createDataFrame(rows, "fecha date, razon_social string, moneda_iso string, linea_negocio string, a string, u string")
    return df.select("*", F.col("a").cast("decimal(28,2)").alias("monto_total_ars"), F.col("u").cast("decimal(28,2)").alias("monto_usd"),
                     F.year("fecha").alias("anio"), F.month("fecha").alias("mes"), F.date_format("fecha", "MMM yyyy").alias("mes_nombre")).cache()


def test_any_window_equals_a_rescan(inv):
    days = ro.daily_rollup(inv).cache()
    rng = random.Random(8)
    windows = [(None, None), (dt.date(2000, 2, 29), dt.date(2000, 2, 29)), (dt.date(2005, 1, 1), dt.date(2006, 1, 1)), (dt.date(2000, 5, 1), dt.date(1999, 5, 1))]
    windows += [tuple(dt.date(1998, 1, 1) + dt.timedelta(days=rng.randrange(1400)) for _ in "ab") for _ in range(4)]
    for desde, hasta in windows:
        lo, hi = scope.window_bounds(days, desde, hasta)
        assert ro.date_window(days, lo, hi).collect() == scope.date_window(inv, desde, hasta).collect()
        inside = scope.apply_scope(inv, scope.ScopeSpec(desde=desde, hasta=hasta), days)
        assert ro.billing_totals(days, lo, hi).collect() == views.billing_totals(inside).collect()
        assert sorted(ro.monthly(days, lo, hi, "usd").collect()) == sorted(views.monthly_usd(inside).collect())
        by_line = inside.groupBy(*ro.KEYS).agg(F.count(F.lit(1)).alias("filas"), F.sum("monto_total_ars").alias("ars"), F.sum("monto_usd").alias("usd"))
        assert {tuple(r) for r in ro.window_totals(days, lo, hi).collect()} == {tuple(r) for r in by_line.collect()}


def test_undated_rows_are_in_no_window(inv):
    days = ro.daily_rollup(inv)
    apart = days.filter("fecha IS NULL").agg(F.sum("filas"), F.count("filas_hasta")).first()
    assert tuple(apart) == (inv.filter("fecha IS NULL").count(), 0)


def test_year_to_date_starts_anew_each_year(inv):
    got = {tuple(r[:5]): r for r in ro.year_to_date(ro.daily_rollup(inv)).collect()}
    want = inv.filter("fecha IS NOT NULL").groupBy(*ro.KEYS, "anio", "mes").agg(F.count(F.lit(1)).alias("n"), F.sum("monto_total_ars").alias("m")).collect()
    assert len(got) == len(want)
    for r in want:
        sums = [x for x in want if x[:4] == r[:4] and x["mes"] <= r["mes"]]
        row = got[tuple(r[:5])]
        assert (row["filas"], row["monto"], row["filas_anio"], row["monto_anio"]) == (r["n"], r["m"], sum(x["n"] for x in sums), sum(x["m"] for x in sums))


def test_no_invoices(spark, inv):
    none = inv.limit(0)
    days = ro.daily_rollup(none)
    lo, hi = scope.window_bounds(days)
    assert ro.date_window(days, lo, hi).collect() == [(None, None, 0, 0)]
    assert ro.year_to_date(days).count() == 0


def test_window_views_read_no_invoices(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole paths in plans
    for name in ("date_window", "billing_totals", "monthly_local", "monthly_intl", "monthly_usd", "year_to_date"):
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "/rollup" in plan and "/invoices" not in plan, name
    spark.conf.unset("spark.sql.maxMetadataStringLength")
