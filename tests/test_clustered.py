"""Clustered tables: no exchange of the ledger per customer, few rows read for one customer."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from arlens.operators import balances as bal
from arlens.operators import ledger, views
from arlens.plans import catalog
from arlens.sources import clustered, fixtures
from conftest import SF_SMALL

AS_OF = dt.date(2001, 9, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_read(df):
    """Rows that the file scans gave when ``df`` was collected, and df's rows."""
    got = df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
            continue
        if node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if node.nodeName().startswith("Scan parquet"):
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return total, got


@pytest.fixture(scope="module")
def movements(spark):
    rng = random.Random(3)
    names = ["Hot S.A."] * 800 + [None] * 400 + [f"Client {i:03}" for i in range(150)] * 8 + ["", "É ü"]
    rng.shuffle(names)
    rows = [(i, n, rng.choice(["FACVTA - 1", "COBRANZA_FCE - 2", "Saldo Inicial", ""]), rng.choice([None, dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(600))]),
             dt.date(2000, 1, 1) + dt.timedelta(days=rng.randrange(700)), rng.randrange(900), rng.randrange(300), rng.randrange(-50, 2000)) for i, n in enumerate(names)]
    raw = spark.createDataFrame(rows, "orden_origen long, cliente string, documento string, fecha date, fecha_vencimiento date, debe int, haber int, saldo int")
    return ledger.clean_ledger(raw).cache()


def test_hot_and_null_customers_lie_apart(spark, movements, scratch):
    clustered.write_clustered(movements, f"{scratch}/t", "cliente", ["fecha", "orden_origen"], 16)
    t = clustered.read_clustered(spark, f"{scratch}/t")
    assert (t.buckets, t.rows, t.key, t.order) == (16, movements.count(), "cliente", ("fecha", "orden_origen"))
    assert {r[0] for r in t.hot.select("cliente").distinct().collect()} == {"Hot S.A.", None} and t.hot_keys == 2
    assert t.cold.filter("cliente = 'Hot S.A.' OR cliente IS NULL").count() == 0
    assert sorted(map(str, t.all().collect())) == sorted(map(str, movements.collect()))
    assert t.hot.select(F.input_file_name()).distinct().count() > 1      # many files, not one task
    for work in (lambda led: bal.client_balances(led, AS_OF), ledger.reconcile, ledger.current_balance):
        assert sorted(map(str, t.per_key(work).collect())) == sorted(map(str, work(movements).collect()))


def test_later_sessions_take_the_stored_buckets(spark, movements, scratch):
    clustered.write_clustered(movements, f"{scratch}/t", "cliente", ["fecha", "orden_origen"], 32)
    other = spark.newSession()
    spark.sql(f"DROP TABLE {clustered._table(f'{scratch}/t')}")
    t = clustered.read_clustered(other, f"{scratch}/t")
    assert t.buckets == 32 and t.all().count() == movements.count()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert "Exchange" not in plan_of(ledger.reconcile(t.cold))


def test_empty_table(spark, movements, scratch):
    clustered.write_clustered(movements.limit(0), f"{scratch}/t", "cliente", ["fecha"])
    t = clustered.read_clustered(spark, f"{scratch}/t")
    assert t.rows == t.hot_keys == 0 and t.all().dtypes == movements.dtypes and t.per_key(ledger.reconcile).count() == 0


def test_one_key_for_all(spark, movements, scratch):
    clustered.write_clustered(movements.withColumn("cliente", F.lit("Uno")), f"{scratch}/t", "cliente", ["fecha", "orden_origen"], 8)
    t = clustered.read_clustered(spark, f"{scratch}/t")
    assert t.hot_keys == 1 and t.cold.count() == 0 and t.per_key(ledger.reconcile).count() == 1


@pytest.mark.parametrize("rows, shuffle, buckets", [(0, 1, 1), (10, 8, 8), (10, 200, 256), (16 * clustered.ROWS_PER_BUCKET, 8, 16), (16 * clustered.ROWS_PER_BUCKET + 1, 8, 32)])
def test_bucket_count(rows, shuffle, buckets):
    assert clustered.bucket_count(rows, shuffle) == buckets


def test_balances_do_not_shuffle_the_ledger(spark):
    """Every exchange lies under the composition: none above a scan of the ledger."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(catalog.q_client_balances_comp(spark, SF_SMALL))
    scans = re.findall(r"FileScan parquet [^\n]*arlens_cold[^\n]*", plan)
    assert scans and all("Bucketed: true" in s for s in scans)
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "FileScan" not in line or "arlens_cold" not in line:
            continue
        depth = re.search(r"[+:]- ", line).start()
        above = []
        for up in reversed(lines[:i]):
            at = re.search(r"[+:]- ", up)
            if at and at.start() < depth:
                depth = at.start()
                above.append(up)
        assert not [a for a in above if "Exchange hashpartitioning" in a], line
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_statement_opens_a_fraction_of_the_row_groups(spark, scratch):
    led = catalog.ledger(spark, SF_SMALL)
    spark.conf.set("parquet.block.size", "4096")
    clustered.write_clustered(led, f"{scratch}/t", "cliente", ["fecha", "orden_origen"], 64)
    spark.conf.unset("parquet.block.size")
    t = clustered.read_clustered(spark, f"{scratch}/t")
    who = views.largest_debtor(catalog.balances(spark, SF_SMALL))
    name = catalog.balances(spark, SF_SMALL).orderBy(F.desc("saldo_actual"), "cliente").first()["cliente"]
    mine = led.filter(F.col("cliente") == name)
    for value in (F.lit(name), who):
        read, got = rows_read(t.rows_of(value))
        assert sorted(map(str, got)) == sorted(map(str, mine.collect()))
        assert read <= t.rows / 10, (read, t.rows)
    assert rows_read(t.rows_of(F.lit("Nobody At All")))[0] <= t.rows / 10
