"""Incremental re-ingestion: two landing batches processed by the file
stream give the same balances as one batch run over everything."""

import datetime as dt
import os
import random
from decimal import Decimal as D

import pytest

from pyspark.sql import functions as F

from arlens.operators.balances import client_balances
from arlens.operators.ledger import clean_ledger
from arlens.sources.fixtures import AS_OF, ledger_raw
from arlens.streaming.incremental import land_ledger, run_incremental
from conftest import SF_SMALL


def _canon(df):
    cols = ["cliente", "saldo_actual", "saldo_vencido", "saldo_por_vencer", "dias_vencido", "aging", "ratio_cobranza"]
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_batch_equals_stream(spark, scratch):
    raw = ledger_raw(spark, SF_SMALL)
    landing, out, ckpt = (os.path.join(scratch, d) for d in ("landing", "out", "ckpt"))
    early = F.coalesce(F.col("fecha"), F.lit("1900-01-01").cast("date")) < F.lit("1999-01-01").cast("date")
    land_ledger(raw.filter(early), landing, 8)
    run_incremental(spark, landing, out, ckpt, AS_OF)
    first = spark.read.parquet(out).count()
    land_ledger(raw.filter(~early), landing, 8)
    run_incremental(spark, landing, out, ckpt, AS_OF)
    streamed = spark.read.parquet(out)
    batch = client_balances(clean_ledger(raw), AS_OF)
    assert first > 0
    assert _canon(streamed) == _canon(batch)


SCHEMA = "orden_origen long, cliente string, documento string, fecha date, fecha_vencimiento date, debe decimal(28,2), haber decimal(28,2), saldo decimal(28,2)"


def _run(spark, scratch, *exports, buckets=8, name=None):
    landing, out, ckpt = (os.path.join(scratch, d) for d in ("landing", "out", "ckpt"))
    for rows in exports:
        land_ledger(spark.createDataFrame(rows, SCHEMA), landing, buckets, name)
        run_incremental(spark, landing, out, ckpt, AS_OF)
    return {r["cliente"]: r for r in spark.read.parquet(out).collect()}


def _charge(order, who, amount, balance):
    return (order, who, f"FACVTA - {order}", dt.date(2001, 5, 1), dt.date(2001, 6, 1), amount, D(0), balance)


def test_a_bucket_whose_debtors_paid_is_emptied(spark, scratch):
    paid = (2, "ana", "COBRANZA - 2", dt.date(2001, 7, 1), None, D(0), D(100), D(0))
    other = _charge(9, "zoe", D(5), D(5))
    got = _run(spark, scratch, [_charge(1, "ana", D(100), D(100)), other], [paid], buckets=64)
    assert set(got) == {"Zoe"}


def test_a_reexport_counts_once(spark, scratch):
    rows = [_charge(1, "ana", D(100), D(100))]
    fixed = [_charge(1, "ana", D(80), D(80))]
    assert _run(spark, scratch, rows, rows)["Ana"]["debe_total"] == D(100)
    assert _run(spark, os.path.join(scratch, "b"), rows, fixed)["Ana"]["debe_total"] == D(80)


def test_a_reexport_with_moved_rows_counts_once(spark, scratch):
    old = (1, "ana", "FACVTA - 1", dt.date(2001, 5, 1), dt.date(2001, 6, 1), D(100), D(0), D(100))
    new = (1, "ana", "FACVTA - 2", dt.date(2001, 4, 1), dt.date(2001, 5, 1), D(50), D(0), D(50))
    moved = (2, *old[1:7], D(150))
    assert _run(spark, scratch, [old], [new, moved])["Ana"]["debe_total"] == D(150)
    assert _run(spark, os.path.join(scratch, "b"), [old], [new, moved], name="ledger")["Ana"]["debe_total"] == D(150)


def test_withdrawn_movements_go(spark, scratch):
    a, b, z = _charge(1, "ana", D(100), D(100)), _charge(2, "ana", D(30), D(130)), _charge(3, "zoe", D(7), D(7))
    got = _run(spark, scratch, [a, b, z], [a], buckets=64, name="ledger")
    assert set(got) == {"Ana"} and got["Ana"]["debe_total"] == D(100)
    # All movements of a customer went, and with them its balance.
    assert _run(spark, os.path.join(scratch, "b"), [a, b, z], [z], buckets=64, name="ledger").keys() == {"Zoe"}


def test_equal_documents_of_one_export_all_count(spark, scratch):
    twice = [(i, "ana", "FACVTA - 1", dt.date(2001, 5, 1), None, D(10), D(0), D(10 * i)) for i in (1, 2)]
    assert _run(spark, scratch, twice, twice)["Ana"]["debe_total"] == D(20)


def test_random_reexports_equal_one_batch(spark, scratch):
    rng = random.Random(3)
    landing, out, ckpt = (os.path.join(scratch, d) for d in ("landing", "out", "ckpt"))
    parts: dict = {}
    for step in range(5):  # two named exports are landed anew with rows moved, changed and withdrawn
        name = rng.choice(["north", "south"]) if step > 1 else ("north", "south")[step]
        rows, total = [], {}
        for i in range(rng.randrange(3, 9)):
            who, amount = f"{name}{rng.randrange(3)}", D(rng.randrange(1, 90))
            total[who] = total.get(who, D(0)) + amount
            rows.append((i, who, f"FACVTA - {rng.randrange(4)}", dt.date(2001, 5, 1 + i), dt.date(2001, 6, 1 + i), amount, D(0), total[who]))
        parts[name] = rows
        land_ledger(spark.createDataFrame(rows, SCHEMA), landing, 16, name)
        run_incremental(spark, landing, out, ckpt, AS_OF)  # a new query each time: it starts from the checkpoint
    batch = client_balances(clean_ledger(spark.createDataFrame([r for x in parts.values() for r in x], SCHEMA)), AS_OF)
    assert _canon(spark.read.parquet(out)) == _canon(batch)


def test_another_bucket_count_is_refused(spark, scratch):
    land_ledger(spark.createDataFrame([_charge(1, "ana", D(1), D(1))], SCHEMA), scratch, 8)
    with pytest.raises(ValueError):
        land_ledger(spark.createDataFrame([_charge(2, "ana", D(1), D(1))], SCHEMA), scratch, 12)
