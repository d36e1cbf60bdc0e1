"""Ledger, reconciliation, LIFO and aging: FIXTURES.md section 7 cases, a
naive per-customer loop as independent model, and invariants."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from arlens.operators.aging import aging_summary, lifo_slices, open_items
from arlens.operators.balances import client_balances
from arlens.operators.ledger import clean_ledger, current_balance, reconcile
from arlens.sources.fixtures import AS_OF, ledger_raw

SCHEMA = ("orden_origen long, cliente string, documento string, fecha date, fecha_vencimiento date, "
          "debe decimal(18,2), haber decimal(18,2), saldo decimal(18,2)")
D = Decimal


def led(spark, rows):
    return clean_ledger(spark.createDataFrame(rows, SCHEMA))


def test_debtor_without_charges(spark):
    l = led(spark, [(0, "a", "Saldo Inicial", None, None, D(0), D(0), D(9))])
    bal = client_balances(l, AS_OF).collect()
    assert len(bal) == 1
    b = bal[0]
    assert b["saldo_vencido"] == 0 and b["saldo_por_vencer"] == D(9) and b["dias_vencido"] == 0
    assert lifo_slices(l, current_balance(l)).count() == 0


def test_balance_above_charges(spark):
    l = led(spark, [(0, "a", "Saldo Inicial", None, None, D(0), D(0), D(15)),
                    (1, "a", "FACVTA - 1", dt.date(2001, 1, 1), dt.date(2001, 2, 1), D(10), D(0), D(25))])
    s = lifo_slices(l, current_balance(l)).collect()
    assert [r["tramo"] for r in s] == [D(10)]
    b = client_balances(l, AS_OF).collect()[0]
    assert b["saldo_vencido"] == D(10) and b["saldo_por_vencer"] == D(15)


def test_partial_oldest_slice(spark):
    l = led(spark, [(0, "a", "FACVTA - 1", dt.date(2023, 12, 1), dt.date(2024, 1, 1), D(100), D(0), D(100)),
                    (1, "a", "FACVTA - 2", dt.date(2024, 2, 1), dt.date(2024, 3, 1), D(50), D(0), D(150)),
                    (2, "a", "FACVTA - 3", dt.date(2024, 2, 2), None, D(70), D(0), D(220)),
                    (3, "a", "COBRANZA - 9", dt.date(2024, 2, 3), None, D(0), D(100), D(120))])
    s = {r["documento"]: r["tramo"] for r in lifo_slices(l, current_balance(l)).collect()}
    assert s == {"FACVTA - 2": D(50), "FACVTA - 1": D(70)}


def test_half_even_weighted_days(spark):
    # slices 10 at 2 days and 10 at 3 days overdue -> 2.5 -> 2
    as_of = dt.date(2024, 1, 10)
    l = led(spark, [(0, "a", "FACVTA - 1", dt.date(2024, 1, 1), dt.date(2024, 1, 8), D(10), D(0), D(10)),
                    (1, "a", "FACVTA - 2", dt.date(2024, 1, 1), dt.date(2024, 1, 7), D(10), D(0), D(20))])
    cb = current_balance(l)
    a = aging_summary(lifo_slices(l, cb), cb, as_of).collect()[0]
    assert a["dias_vencido"] == 2 and a["dias_vencido_max"] == 3


def test_opening_double_count(spark):
    l = led(spark, [(0, "a", "FACVTA - 1", dt.date(2024, 1, 1), None, D(100), D(0), D(100))])
    r = reconcile(l).collect()[0]
    assert r["saldo_reconstruido"] == D(200) and r["dif_conciliacion"] == D(-100) and not r["conciliado"]


def _naive_lifo(rows, balances):
    """Per-customer loop: newest due first (missing last), then newest date,
    then source order; spend the balance."""
    out = {}
    by = {}
    for r in rows:
        if r["tipo"] == "Factura/Cargo" and r["cliente"] and r["debe"] > 0:
            by.setdefault(r["cliente"], []).append(r)
    for c, bal in balances.items():
        if bal <= 0:
            continue
        rem = bal
        key = lambda r: (r["fecha_vencimiento"] is not None, r["fecha_vencimiento"] or dt.date.min,
                         r["fecha"] is not None, r["fecha"] or dt.date.min, -r["orden_origen"])
        for r in sorted(by.get(c, []), key=key, reverse=True):
            if rem <= 0:
                break
            t = min(r["debe"], rem)
            rem -= t
            out[(c, r["orden_origen"])] = t
    return out


def test_lifo_equals_naive_loop(spark):
    l = clean_ledger(ledger_raw(spark, "/root/testdata/sf0.001"))
    cb = current_balance(l)
    got = {(r["cliente"], r["orden_origen"]): r["tramo"] for r in lifo_slices(l, cb).collect()}
    rows = [r.asDict() for r in l.collect()]
    bals = {r["cliente"]: r["saldo_actual"] for r in cb.collect()}
    assert got == _naive_lifo(rows, bals)
    assert len(got) > 50


def test_invariants(spark):
    l = clean_ledger(ledger_raw(spark, "/root/testdata/sf0.001"))
    cb = current_balance(l)
    slices = lifo_slices(l, cb)
    per = slices.groupBy("cliente").agg(F.sum("tramo").alias("s"))
    charges = (l.filter((F.col("tipo") == "Factura/Cargo") & (F.col("debe") > 0))
                .groupBy("cliente").agg(F.sum("debe").alias("c")))
    chk = (cb.filter("saldo_actual > 0").join(charges, "cliente", "left").join(per, "cliente", "left")
             .select(F.coalesce("s", F.lit(0)).alias("s"),
                     F.least("saldo_actual", F.coalesce("c", F.lit(0))).alias("m")))
    assert chk.filter(F.col("s") != F.col("m")).count() == 0
    b = client_balances(l, AS_OF)
    bad = b.filter(F.col("saldo_vencido") + F.col("saldo_por_vencer") != F.col("saldo_actual")).count()
    assert bad == 0
    items = open_items(slices, AS_OF)
    assert items.filter(F.col("cliente_norm") == "").count() == 0


def test_lifo_hot_customer(spark):
    """One customer holds a third of all charges; the sliced prefix sum still
    equals the naive loop."""
    import random
    rnd = random.Random(5)
    rows, bal = [], {}
    for i in range(900):
        c = "hot" if i % 3 == 0 else f"c{i % 40}"
        due = None if i % 17 == 0 else dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 600))
        amt = D(rnd.randint(1, 5000)) / 10
        bal[c] = bal.get(c, D(0)) + amt
        rows.append((i, c, f"FACVTA - {i}", dt.date(2000, 1, 1) + dt.timedelta(days=rnd.randint(0, 600)), due,
                     amt, D(0), bal[c]))
    for c in list(bal):  # a final collection leaves part of each balance open
        bal[c] = (bal[c] * D("0.4")).quantize(D("0.01"))
        rows.append((10_000 + len(rows), c, "COBRANZA - x", dt.date(2003, 1, 1), None, D(0), D(0), bal[c]))
    l = led(spark, rows)
    cb = current_balance(l)
    got = {(r["cliente"], r["orden_origen"]): r["tramo"] for r in lifo_slices(l, cb).collect()}
    want = _naive_lifo([r.asDict() for r in l.collect()], {r["cliente"]: r["saldo_actual"] for r in cb.collect()})
    assert got == want and any(k[0] == "Hot" for k in got)


def test_open_items_source_falls_back_to_lifo(spark):
    from arlens.operators.aging import open_items_source
    l = clean_ledger(ledger_raw(spark, "/root/testdata/sf0.001"))
    bal = client_balances(l, AS_OF)
    empty = spark.createDataFrame([], "cliente string, saldo_abierto double")
    derived = open_items_source(empty, l, bal, AS_OF)
    assert derived.count() == lifo_slices(l, current_balance(l)).count() > 0
    some = spark.createDataFrame([("x", 1.0)], "cliente string, saldo_abierto double")
    assert open_items_source(some, l, bal, AS_OF).count() == 1
