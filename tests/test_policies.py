"""Policies of many users against the rows each one may see."""

import os
import random

import pytest
from pyspark.sql import functions as F

from arlens.operators import distinct, policies, scope
from arlens.plans import catalog
from arlens.session import checkpoint_dir
from arlens.sources import fixtures
from conftest import SF_SMALL

GRANTS = "usuario string, ambito string, modo string, valor string"


@pytest.fixture(scope="module")
def inv(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "Hot", "Hot", *[f"C{i}" for i in range(40)]]), rng.choice(["A", " A ", "B", "C", None, ""]), f"{rng.randrange(-90, 900)}.10") for _ in range(1500)]
    return spark.createDataFrame(rows, "cliente string, linea_negocio string, m string").withColumn("monto_total_ars", F.col("m").cast("decimal(28,2)")).cache()


@pytest.fixture(scope="module")
def grants(spark):
    rng = random.Random(9)
    rows = [("root", "superuser", None, None), ("root", "clientes", "Incluir", "C1"), ("free", "clientes", "Excluir", None),
            ("lost", "clientes", "Incluir", "Nobody"), ("harmless", "clientes", "Excluir", "Nobody"), ("lost_c", "centros", "Incluir", "Z"),
            ("mixed", "clientes", "Incluir", "Nobody"), ("mixed", "clientes", "Incluir", "C2")]
    for u in range(60):
        for ambito, values in (("clientes", ["Hot", *[f"C{i}" for i in range(40)]]), ("centros", ["A", "B", "C", ""])):
            modo = rng.choice(["Incluir", "Excluir", None])
            if modo:
                rows += [(f"u{u}", ambito, modo, rng.choice(values)) for _ in range(rng.randrange(1, 5))]
    return spark.createDataFrame(rows, GRANTS).cache()


@pytest.fixture(scope="module")
def names(inv):
    centers = distinct.client_numbers(inv.select(F.trim("linea_negocio").alias("cliente"))).withColumnRenamed("cliente", "centro").cache()
    return distinct.client_numbers(inv).cache(), centers


def test_totals_equal_the_visible_rows_of_each_user(inv, grants, names):
    users, masks, listed = (x.cache() for x in policies.compile_policies(grants, *names))
    got = {r["usuario"]: (r["filas"], r["monto"]) for r in policies.policy_totals(inv, users, masks, listed, *names).collect()}
    data, lists = inv.collect(), grants.collect()
    for user in {r["usuario"] for r in lists}:
        mine = [r for r in lists if r["usuario"] == user]
        kept = data
        if not any(r["ambito"] == "superuser" for r in mine):
            for ambito, value in (("clientes", lambda r: r["cliente"]), ("centros", lambda r: r["linea_negocio"] and r["linea_negocio"].strip() if r["linea_negocio"] is not None else None)):
                listed_names = {r["valor"] for r in mine if r["ambito"] == ambito and r["valor"] is not None}
                modes = {r["modo"] for r in mine if r["ambito"] == ambito and r["valor"] is not None}
                if listed_names:
                    kept = [r for r in kept if (value(r) in listed_names) == (modes == {"Incluir"})]
        assert got[user] == (len(kept), sum((r["monto_total_ars"] for r in kept), 0)), user


def test_visible_rows_by_policy_and_fail_closed(inv, grants, names):
    users, _, listed = (x.cache() for x in policies.compile_policies(grants, *names))
    for user in ("root", "free", "lost", "harmless", "mixed", "u1", "u2", "u7", "nobody at all"):
        a = policies.visible(inv, users, listed, *names, user).groupBy("cliente", "linea_negocio").count().collect()
        b = scope.visible_rows(inv, grants, user).groupBy("cliente", "linea_negocio").count().collect()
        assert sorted(map(str, a)) == sorted(map(str, b)), user
    assert policies.visible(inv, users, listed, *names, "lost").count() == policies.visible(inv, users, listed, *names, "nobody at all").count() == 0


def test_users_of_one_policy_share_it(spark, names):
    rows = [(f"s{i}", "clientes", "Incluir", v) for i in range(50) for v in (("C1", "C2") if i % 2 else ("C2", "C1", "C1"))]
    rows += [("other", "clientes", "Excluir", "C1"), ("other", "clientes", "Excluir", "C2")]
    users, masks, listed = policies.compile_policies(spark.createDataFrame(rows, GRANTS), *names)
    assert users.select("politica").distinct().count() == 2 and users.count() == 51
    assert masks.count() == 2 and listed.count() == 4


def test_bits_of_far_numbers(spark):
    numbers = [1, 8, 9, 32768, 32769, 70001]
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    maps = df.groupBy(F.bitmap_bucket_number("n").alias("t")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("m"))
    probe = spark.range(1, 70010).select(F.col("id").alias("n"), F.bitmap_bucket_number("id").alias("t"))
    hit = probe.join(maps, "t").filter(policies.bit_is_set(F.col("m"), F.col("n")))
    assert sorted(r["n"] for r in hit.collect()) == numbers


def test_fixture_has_a_user_per_order_and_no_pairs(spark):
    orders = spark.read.parquet(f"{SF_SMALL}/orders.parquet").count()
    assert fixtures.many_grants(spark, SF_SMALL).select("usuario").distinct().count() == orders
    df = catalog.QUERIES["policy_totals"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert df.count() == orders


def test_masks_of_short_lists_are_a_few_bytes(spark):
    """Lists of numbers far apart: a word of 8 bytes for each, not a bitmap of 4 KB."""
    clients = spark.range(1, 100_001).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cliente"), F.col("id").alias("numero"))
    centers = spark.createDataFrame([("A", 1), ("B", 2)], "centro string, numero long")
    rows = [(u, "clientes", "Incluir", f"c{n}") for u in ("x", "y") for n in (1, 63, 64, 65, 40_000, 99_999)] + [("z", "clientes", "Incluir", "c64"), ("z", "centros", "Excluir", "B")]
    users, masks, listed = policies.compile_policies(spark.createDataFrame(rows, "usuario string, ambito string, modo string, valor string"), clients, centers)
    assert dict(masks.dtypes)["mapa"] == "bigint"
    politica = {r["usuario"]: r["politica"] for r in users.collect()}
    assert politica["x"] == politica["y"] != politica["z"]
    got = {(r["ambito"], r["tramo"]): r["mapa"] for r in masks.filter(F.col("politica") == politica["x"]).collect()}
    assert got == {("clientes", 0): 2 - 2 ** 63, ("clientes", 1): 3, ("clientes", 625): 1, ("clientes", 1562): 2 ** 31}


def test_numbers_of_masks(spark):
    words = {0: [1, 63], 1: [64], 2: [191], 3: list(range(192, 256))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [("p", "clientes", t, signed(sum(1 << (n & 63) for n in ns))) for t, ns in words.items()]
    got = policies.numbers_of(spark.createDataFrame(rows, "politica string, ambito string, tramo long, mapa long"))
    assert dict(got.dtypes)["numero"] == "bigint"
    assert sorted(r["numero"] for r in got.collect()) == sorted(n for ns in words.values() for n in ns)


def test_a_row_without_a_user_shares_a_policy_with_users_but_has_no_lists(spark, inv, names):
    rows = [(None, "clientes", "Excluir", "C1"), ("harmless", "clientes", "Excluir", "Nobody"), ("a", "clientes", "Excluir", "C1"), ("b", "clientes", "Excluir", "C1")]
    users, masks, listed = policies.compile_policies(spark.createDataFrame(rows, GRANTS), *names)
    politica = {r["usuario"]: r["politica"] for r in users.collect()}
    assert politica["a"] == politica["b"] != politica[None] == politica["harmless"] and listed.count() == 1
    got = {r["usuario"]: r["filas"] for r in policies.policy_totals(inv, users, masks, listed, *names).collect()}
    other = inv.filter("cliente IS NULL OR cliente <> 'C1'").count()
    assert got == {None: inv.count(), "harmless": inv.count(), "a": other, "b": other}


def test_steps_are_stored_and_leave_only_what_the_result_reads(spark):
    """One plan of all steps kept every step's shuffle files till its end."""
    folder = os.path.join(checkpoint_dir(spark).removeprefix("file:"), "arlens-llm")
    had = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    df = catalog.QUERIES["policy_totals"](spark, SF_SMALL)
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 2
    assert {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - had} == {"policy-users", "policy-totals"}
