"""Scope filters: include/exclude partition the rows; permissions fail closed."""

from pyspark.sql import functions as F

from arlens.operators import scope
from arlens.plans import catalog
from arlens.sources.fixtures import permissions_doc
from conftest import SF_SMALL


def test_include_exclude_partition(spark):
    inv = catalog.invoices(spark, SF_SMALL)
    sel = ["Customer#000000002 S.A.U.", "customer#000000004 s.a.u."]
    a = scope.apply_scope(inv, scope.ScopeSpec(clientes=sel, clientes_modo=scope.INCLUDE, all_dates=True))
    b = scope.apply_scope(inv, scope.ScopeSpec(clientes=sel, clientes_modo=scope.EXCLUDE, all_dates=True))
    allrows = scope.apply_scope(inv, scope.ScopeSpec(all_dates=True))
    assert a.count() + b.count() == allrows.count()
    assert a.join(b, ["numero_comprobante"], "inner").count() == 0
    assert a.select("cliente").distinct().count() == 2


def test_long_list_uses_join(spark):
    inv = catalog.invoices(spark, SF_SMALL)
    names = [r[0] for r in inv.select("cliente").distinct().collect()]
    many = names + [f"X{i}" for i in range(1500)]
    got = scope.in_list(inv, "cliente", many, scope.INCLUDE).count()
    assert got == inv.count()
    assert scope.in_list(inv, "cliente", many, scope.EXCLUDE).count() == 0


def test_permission_rows_and_fail_closed(spark):
    grants = scope.permission_rows(permissions_doc(spark))
    rows = {(r["usuario"], r["ambito"], r["modo"], r["valor"]) for r in grants.collect()}
    assert ("admin", "superuser", None, None) in rows
    assert ("u_incl", "clientes", "Incluir", "Customer#000000004 S.A.U.") in rows
    assert ("u_excl", "centros", "Incluir", "ECONOMY") in rows
    inv = scope.apply_scope(catalog.invoices(spark, SF_SMALL), scope.ScopeSpec(all_dates=True))
    per = {r["usuario"]: r["filas"] for r in scope.rows_per_user(inv, grants).collect()}
    total = inv.count()
    assert per["admin"] == total
    assert per["u_none"] == 0
    assert per["u_incl"] == inv.filter(F.col("cliente") == "Customer#000000004 S.A.U.").count()
    assert per["u_excl"] == inv.filter((F.col("linea_negocio") == "ECONOMY")
                                       & (F.col("cliente") != "Customer#000000002 S.A.U.")).count()


def test_date_window_bounds(spark):
    import datetime as dt
    inv = catalog.invoices(spark, SF_SMALL)
    b = scope.date_bounds(inv).collect()[0]
    assert b["desde"] == dt.date(b["hasta"].year, 1, 1)
    swapped = scope.date_bounds(inv, dt.date(2000, 6, 1), dt.date(1999, 1, 1)).collect()[0]
    assert swapped["desde"] == dt.date(1999, 1, 1) and swapped["hasta"] == dt.date(2000, 6, 1)
    clamped = scope.date_bounds(inv, dt.date(1900, 1, 1), None).collect()[0]
    assert clamped["desde"] == inv.agg(F.min("fecha")).first()[0]
