"""Landing folders with differing columns under one schema."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arlens.plans import catalog
from arlens.sources import landing
from conftest import SF_SMALL


def kind(text):
    return T.StructType.fromDDL(f"x {text}")[0].dataType


@pytest.mark.parametrize("a, b, both", [
    ("int", "bigint", "bigint"), ("decimal(10,2)", "decimal(14,4)", "decimal(14,4)"), ("decimal(12,0)", "decimal(6,4)", "decimal(16,4)"), ("int", "decimal(4,2)", "decimal(12,2)"),
    ("decimal(38,0)", "decimal(10,8)", "string"), ("float", "double", "double"), ("double", "int", "double"), ("double", "bigint", "string"), ("double", "decimal(18,2)", "string"),
    ("date", "timestamp", "timestamp"), ("date", "timestamp_ntz", "timestamp_ntz"), ("date", "int", "string"), ("void", "date", "date"), ("string", "int", "string"), ("boolean", "boolean", "boolean")])
def test_types_widen_without_loss(spark, a, b, both):
    assert landing.wider(kind(a), kind(b)) == landing.wider(kind(b), kind(a)) == kind(both)


def test_no_folder_and_clashing_spellings(spark):
    with pytest.raises(ValueError):
        landing.merge_landings({})
    with pytest.raises(ValueError):
        landing.merge_landings({"a": spark.createDataFrame([(1, 2)], "`Razón Social` int, razon_social int")})


def test_folders_are_read_by_one_plan(spark, scratch):
    old = spark.createDataFrame([(1, "x", Decimal("5.25"), dt.date(1999, 1, 2)), (None, None, None, None)], "id int, `Razón social` string, monto decimal(8,2), alta date")
    new = spark.createDataFrame([(1 << 40, Decimal("1.2345"), dt.datetime(2000, 1, 1, 5), "k", "y")], "ID bigint, monto decimal(12,4), alta timestamp, extra string, razon_social string")
    none = spark.createDataFrame([], "otra double")
    for name, df in (("old", old), ("new", new), ("none", none)):
        df.write.parquet(f"{scratch}/{name}")
    got = landing.read_landings(spark, {n: f"{scratch}/{n}" for n in ("old", "new", "none")}, {"extra": "?"}, "origen")
    assert got.columns == ["id", "Razón social", "monto", "alta", "extra", "otra", "origen"]
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == sorted([(1, "x", Decimal("5.2500"), dt.datetime(1999, 1, 2), "?", None, "old"), (None, None, None, None, "?", None, "old"),
                           (1 << 40, "y", Decimal("1.2345"), dt.datetime(2000, 1, 1, 5), "k", None, "new")], key=str)
    plan = got.filter(F.col("id") > 5).select("monto")._jdf.queryExecution().executedPlan().toString()
    # The folder without the filtered column has no row to give and is not read.
    assert "Exchange" not in plan and plan.count("ReadSchema: struct<") == 2 and "Razón" not in plan.split("ReadSchema", 1)[1]


def test_drift_report(spark):
    a, b = spark.createDataFrame([], "id int, m decimal(8,2)"), spark.createDataFrame([], "id bigint, extra string, M decimal(8,2)")
    assert landing.schema_drift({"a": a, "b": b}) == [("a", "id", "tipo", "int", "bigint"), ("a", "extra", "falta", None, "string")]
    assert landing.schema_drift({"a": a, "again": a}) == []


def test_query_shuffles_only_for_its_sums(spark):
    plan = catalog.QUERIES["landing_merge"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan parquet") == 2 and "cliente" not in plan
