"""Plan lint: no query pairs rows (cartesian / nested-loop joins), none leaves
the JVM, none reads a checkpoint, and views read products with pruned columns
and pushed filters. The plans that build the products are linted as well."""

import re

from arlens.operators import aging, balances, composition, ledger
from arlens.plans import catalog
from arlens.sources import fixtures
from conftest import SF_SMALL

FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython",
             "FlatMapGroupsInPandas", "MapInPandas", "PythonUDF"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _checkpoints(plan):
    # Small lists given by the caller are the only scans of driver rows.
    return [x for x in re.findall(r"Scan ExistingRDD\[([^\]]*)\]", plan) if not re.search(r"_v#|valor#|cells#|clave#", x)]


def test_no_pairing_joins_or_python(spark):
    bad = {}
    for name, fn in catalog.QUERIES.items():
        plan = _plan(fn(spark, SF_SMALL))
        hits = [f for f in FORBIDDEN if f in plan] + _checkpoints(plan)
        if hits:
            bad[name] = hits
    assert bad == {}


def test_product_builds(spark):
    led = ledger.clean_ledger(fixtures.ledger_raw(spark, SF_SMALL))
    grid = fixtures.composition_raw(spark, SF_SMALL)
    builds = {"invoices": catalog.clean_invoices_fresh(spark, SF_SMALL), "ledger": led, "grid": grid,
              "items": composition.composition_items(grid, fixtures.AS_OF), "running": ledger.running_balance(led),
              "lifo": aging.lifo_slices(led, ledger.current_balance(led)), "balances": balances.client_balances(led, fixtures.AS_OF)}
    for name, df in builds.items():
        plan = _plan(df)
        assert not [f for f in FORBIDDEN if f in plan] and not _checkpoints(plan), name
        assert "rangepartitioning" not in plan, name


def test_charges_are_shuffled_once_for_lifo(spark):
    led = catalog.ledger(spark, SF_SMALL)
    plan = _plan(aging.lifo_slices(led, catalog.balances(spark, SF_SMALL).select("cliente", "saldo_actual")))
    # The rows of the charges (with their document) cross one exchange.
    scans = [x for x in plan.splitlines() if "Exchange hashpartitioning(cliente" in x and "_slice" in x]
    assert len(scans) == 1
    assert plan.count("FileScan parquet") <= 3


WINDOWED = ["filter_clients_in", "filter_clients_out", "filter_centers", "row_permissions", "center_semi_filter", "scope_balances", "scope_movements",
            "permission_rows_visible", "line_mix", "top_clients", "top_clients_line", "billing_vs_debt", "kpi_financial", "briefing"]


def test_views_of_the_window_read_its_years_only(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")  # whole paths in plans
    for name in WINDOWED:
        plan = _plan(catalog.QUERIES[name](spark, SF_SMALL))
        scans = [x for x in plan.split("FileScan parquet")[1:] if "/invoices" in x.split("ReadSchema")[0]]
        assert scans, name
        for scan in scans:
            filters = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan, re.S)[1]
            assert re.search(r"anio#\d+L? >= year\(", filters) and re.search(r"anio#\d+L? <= year\(", filters), (name, filters)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_views_prune_and_push(spark):
    plan = _plan(catalog.QUERIES["line_mix"](spark, SF_SMALL))
    assert "PushedFilters: [" in plan and "EqualTo(moneda_iso,ARS)" in plan
    schemas = re.findall(r"ReadSchema: struct<([^>\n]*)", plan)
    assert schemas and all(s.count(":") <= 6 for s in schemas)


def test_export_items_parse_no_file_again(spark):
    plan = catalog.QUERIES["export_items"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "delimited_exports" not in plan
