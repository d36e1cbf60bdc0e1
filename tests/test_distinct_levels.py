"""Distinct customers from bitmaps and totals at every level, against rescans."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from arlens.operators import distinct, levels, rollup, scope
from arlens.plans import catalog
from conftest import SF_SMALL

SCHEMA = "fecha date, cliente string, linea_negocio string, razon_social string, moneda_iso string, ars string, usd string"


@pytest.fixture(scope="module")
def inv(spark):
    rng = random.Random(11)
    day = dt.date(1999, 11, 7)
    names = [f"C{i}" for i in range(700)] + ["HOT"] * 300 + [None] * 20
    rows = [(rng.choice([None, *[day + dt.timedelta(days=rng.randrange(500))] * 15]), rng.choice(names), rng.choice(["A", " A ", "B", None, ""]),
             rng.choice(["Local", "Internacional", None]), rng.choice(["ARS", "USD"]), f"{rng.randrange(-500, 900)}.25", "1.50") for _ in range(5000)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", F.col("ars").cast("decimal(28,2)").alias("monto_total_ars"), F.col("usd").cast("decimal(28,2)").alias("monto_usd"),
                     F.year("fecha").alias("anio"), F.month("fecha").alias("mes")).cache()


def rescanned(inv):
    rows = inv.filter("cliente IS NOT NULL").select(F.trim("linea_negocio").alias("c"), "cliente").collect()
    by = {}
    for c, name in rows:
        by.setdefault((0, c), set()).add(name)
        by.setdefault((1, None), set()).add(name)
    return {k: len(v) for k, v in by.items()}


def counted(df):
    return {(r["es_total"], r["centro"]): r["clientes"] for r in df.collect()}


def test_numbers_have_no_gaps_and_grow_by_append(spark, inv):
    first = distinct.client_numbers(inv.filter("cliente < 'C4'")).cache()
    grown = distinct.client_numbers(inv, first).cache()
    n = inv.select("cliente").distinct().filter("cliente IS NOT NULL").count()
    assert sorted(r["numero"] for r in grown.collect()) == list(range(1, n + 1))
    assert grown.exceptAll(first).count() == n - first.count()
    assert distinct.client_numbers(inv, grown).exceptAll(grown).count() == 0
    assert distinct.client_numbers(inv.limit(0)).count() == 0


def test_any_window_equals_count_distinct(spark, inv):
    maps = distinct.client_bitmaps(inv, distinct.client_numbers(inv)).cache()
    rng = random.Random(3)
    d = dt.date
    windows = [(d(2000, 2, 1), d(2000, 2, 29)), (d(2000, 2, 2), d(2000, 2, 29)), (d(2000, 1, 31), d(2000, 4, 1)), (d(2000, 3, 5), d(2000, 3, 5)), (d(1990, 1, 1), d(2010, 1, 1))]
    windows += [tuple(sorted(d(1999, 11, 1) + dt.timedelta(days=rng.randrange(520)) for _ in "ab")) for _ in range(4)]
    for lo, hi in windows:
        got = counted(distinct.distinct_clients(maps, F.lit(lo), F.lit(hi)))
        assert got == rescanned(inv.filter(F.col("fecha").between(F.lit(lo), F.lit(hi)))), (lo, hi)
    assert counted(distinct.distinct_clients(maps)) == rescanned(inv)
    assert distinct.distinct_clients(maps, F.lit(d(1980, 1, 1)), F.lit(d(1980, 2, 1))).count() == 0


def test_bitmaps_grow_by_append_in_any_split(spark, inv):
    parts = inv.randomSplit([0.5, 0.3, 0.2], 5)
    numbers = maps = None
    for part in parts:
        numbers = distinct.client_numbers(part, numbers).cache()
        new = distinct.client_bitmaps(part, numbers)
        maps = new if maps is None else distinct.append_bitmaps(maps, new)
    again = distinct.append_bitmaps(maps, distinct.client_bitmaps(parts[1], numbers))
    assert counted(distinct.distinct_clients(again)) == counted(distinct.distinct_clients(maps)) == rescanned(inv)


def test_many_ranges_of_numbers(spark):
    rows = spark.range(100_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cliente"), F.lit("A").alias("linea_negocio"),
                                       F.date_add(F.lit("2000-01-01"), (F.col("id") % 50).cast("int")).alias("fecha"))
    maps = distinct.client_bitmaps(rows, distinct.client_numbers(rows))
    lo, hi = F.lit(dt.date(2000, 1, 11)), F.lit(dt.date(2000, 2, 10))
    assert counted(distinct.distinct_clients(maps, lo, hi)) == {(0, "A"): 62_000, (1, None): 62_000}


def test_distinct_views_read_no_invoices(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for name in ("center_impact", "center_impact_window", "billing_levels"):
        plan = catalog.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "/invoices" not in plan, name
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_levels_tell_null_keys_from_totals(inv):
    got = levels.with_share(levels.billing_levels(rollup.daily_rollup(inv))).collect()
    rows = inv.collect()
    for name, keys in levels.LEVELS.items():
        want = {}
        for r in rows:
            k = tuple(r[x] if x in keys else None for x in levels.KEYS)
            n, m, u = want.get(k, (0, 0, 0))
            want[k] = (n + 1, m + r["monto_total_ars"], u + r["monto_usd"])
        have = {tuple(r[x] for x in levels.KEYS): (r["filas"], r["ars"], r["usd"]) for r in got if r["nombre_nivel"] == name}
        assert have == want, name
    for r in got:
        if r["nombre_nivel"] == "EMPRESA":
            assert r["participacion"] == pytest.approx(float(r["ars"]) / float(sum(x["monto_total_ars"] for x in rows)))
    assert [r["participacion"] for r in got if r["nombre_nivel"] == "TOTAL"] == [1.0]


def test_levels_of_nothing(inv):
    assert levels.with_share(levels.billing_levels(rollup.daily_rollup(inv.limit(0)))).count() == 0


def test_default_window(inv):
    maps = distinct.client_bitmaps(inv, distinct.client_numbers(inv))
    lo, hi = scope.window_bounds(inv)
    inside = scope.apply_scope(inv, scope.ScopeSpec())
    assert counted(distinct.distinct_clients(maps, lo, hi)) == rescanned(inside)


def test_bitmaps_are_no_larger_than_their_rows(spark):
    """A customer a day: bitmaps of 32,768 numbers would hold 4 KB for each of these rows."""
    rows = spark.range(3000).select(F.concat(F.lit("c"), (F.col("id") * 7 % 1500).cast("string")).alias("cliente"), F.concat(F.lit("A"), (F.col("id") % 30).cast("string")).alias("linea_negocio"),
                                    F.date_add(F.lit("2000-01-01"), (F.col("id") % 700).cast("int")).alias("fecha"))
    maps = distinct.client_bitmaps(rows, distinct.client_numbers(rows))
    assert dict(maps.dtypes)["mapa"] == "bigint"
    assert maps.filter("nivel = 'd'").count() <= 3000 and maps.filter("nivel = 'm'").count() <= 3000
    assert maps.filter("mapa = 0").count() == 0
