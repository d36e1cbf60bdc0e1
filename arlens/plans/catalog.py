"""Query catalogue: one named product query per operator of the survey.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built from
the driver's tables through the landing builders and the operators. Final
projections go through :func:`to_edge` (money as DOUBLE, ints as BIGINT) so
the schema equals the oracle's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arlens.operators import invoices as inv_ops
from arlens.plans.edge import to_edge
from arlens.scratch import dispose, shuffles_freed, stored
from arlens.sources import discovery, fixtures
from arlens.sources import exports as exports_src
from arlens.sources.clustered import Clustered, read_clustered, write_clustered

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        return fn
    return deco


# --- products ------------------------------------------------------------------------
# The cleaned inputs and the tables views read are Parquet products, as in a
# deployment where the load writes tables and the views query them: the first
# query that needs a product writes it (a job), later ones read it with column
# pruning and pushed filters. They live below ``spark.arlens.products`` or, if
# that is unset, the session's shared checkpoint folder. A product is keyed by
# the name, size and time of its input files, so rewritten tables give a new
# one. A query that *defines* a product computes it from its inputs.
_INPUTS = ("nation", "customer", "part", "orders", "lineitem")
_READY: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, sf: str) -> str:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for t in _INPUTS:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf}/{t}.parquet")
        fs = p.getFileSystem(conf)
        for f in fs.listStatus(p):
            seen.append(f"{t}/{f.getPath().getName()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha256("\n".join([sf, *sorted(seen)]).encode()).hexdigest()[:16]


def _product(spark: SparkSession, sf: str, name: str, write: Callable[[str], None], done: str = "_SUCCESS") -> str:
    """Path of a product, written by ``write(path)`` unless it is there. Below
    ``spark.arlens.products`` a product outlives its session: one whose ``done`` mark
    exists is read by later sessions as well. A build that was cut off has no mark; its
    successor writes a folder of the next number."""
    from arlens.session import checkpoint_dir

    key = (spark.sparkContext.applicationId, _fingerprint(spark, sf.rstrip("/")), name)
    if key not in _READY:
        base = spark.conf.get("spark.arlens.products", None)
        root = f"{base.rstrip('/')}/{key[1]}" if base else f"{checkpoint_dir(spark).rstrip('/')}/arlens-products/{key[0]}/{key[1]}"
        jvm, conf, attempt = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), 0
        while True:
            path = f"{root}/{name}-{attempt}"
            folder = jvm.org.apache.hadoop.fs.Path(path)
            fs = folder.getFileSystem(conf)
            if not fs.exists(folder):
                with shuffles_freed(spark):
                    write(path)
                break
            if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{done}")):
                break
            attempt += 1
        _READY[key] = path
    return _READY[key]


def shared(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    return spark.read.parquet(_product(spark, sf, name, lambda path: build().write.partitionBy(*partition_by).parquet(path)))


def clean_invoices_fresh(spark: SparkSession, sf: str) -> DataFrame:
    return inv_ops.clean_invoices(fixtures.invoices_raw(spark, sf), fixtures.COMPANY_MAP_FIXTURE)


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "invoices", lambda: clean_invoices_fresh(spark, sf), ("anio",))


# --- M0 / M1: invoices -----------------------------------------------------------
@query("inv_clean")
def q_inv_clean(spark, sf):
    return to_edge(clean_invoices_fresh(spark, sf), inv_ops.INVOICE_COLUMNS)


@query("customer_summary")
def q_customer_summary(spark, sf):
    return to_edge(inv_ops.customer_summary(invoices(spark, sf)))


# --- M2 / M3: ledger, LIFO, aging ------------------------------------------------
from arlens.functions.dates import aging_rank  # noqa: E402
from arlens.operators import aging as aging_ops  # noqa: E402
from arlens.operators import balances as bal_ops  # noqa: E402
from arlens.operators import ledger as led_ops  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

AS_OF = fixtures.AS_OF


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "ledger", lambda: led_ops.clean_ledger(fixtures.ledger_raw(spark, sf)))


def ledger_clustered(spark: SparkSession, sf: str) -> Clustered:
    """The ledger bucketed by customer, customers with very many movements apart."""
    return read_clustered(spark, _product(spark, sf, "ledger_clustered", lambda path: write_clustered(
        ledger(spark, sf), path, "cliente", ["fecha", "orden_origen"]), "layout/_SUCCESS"))


def balances(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "balances", lambda: bal_ops.client_balances(ledger(spark, sf), AS_OF))


@query("mov_classify")
def q_mov_classify(spark, sf):
    return to_edge(led_ops.movement_mix(ledger(spark, sf)))


@query("ledger_running")
def q_ledger_running(spark, sf):
    return to_edge(led_ops.running_balance(ledger(spark, sf)))


@query("current_balance")
def q_current_balance(spark, sf):
    return to_edge(led_ops.current_balance(ledger(spark, sf)))


@query("reconcile")
def q_reconcile(spark, sf):
    return to_edge(led_ops.reconcile(ledger(spark, sf)),
                   ["cliente", "saldo_inicial", "debe_total", "haber_total", "saldo_reconstruido",
                    "saldo_final_ledger", "dif_conciliacion", "conciliado"])


@query("open_items_lifo")
def q_open_items_lifo(spark, sf):
    led = ledger(spark, sf)
    debtors = led_ops.current_balance(led)
    return to_edge(aging_ops.open_items(aging_ops.lifo_slices(led, debtors), AS_OF), aging_ops.ITEM_COLUMNS)


@query("aging_by_client")
def q_aging_by_client(spark, sf):
    led = ledger(spark, sf)
    debtors = led_ops.current_balance(led)
    return to_edge(aging_ops.aging_summary(aging_ops.lifo_slices(led, debtors), debtors, AS_OF))


@query("client_balances")
def q_client_balances(spark, sf):
    return to_edge(bal_ops.rank_debtors(bal_ops.client_balances(ledger(spark, sf), AS_OF)))


# --- M4: composition ---------------------------------------------------------------
from arlens.operators import composition as comp_ops  # noqa: E402


def comp_grid(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "comp_grid", lambda: fixtures.composition_raw(spark, sf))


def comp_items(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "comp_items", lambda: comp_ops.composition_items(comp_grid(spark, sf), AS_OF))


def comp_summary(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "comp_summary", lambda: comp_ops.composition_summary(comp_items(spark, sf)))


def balances_comp_fresh(spark: SparkSession, sf: str) -> DataFrame:
    comp = comp_summary(spark, sf)
    return ledger_clustered(spark, sf).per_key(lambda led: bal_ops.client_balances_with_composition(led, comp, AS_OF))


def balances_comp(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "balances_comp", lambda: balances_comp_fresh(spark, sf))


@query("comp_header_detect")
def q_comp_header_detect(spark, sf):
    h = comp_ops.detect_header(comp_grid(spark, sf))
    return to_edge(h, ["file", "sheet", "header_row", "col_cliente", "col_centro", "col_saldo", "col_venc", "col_doc"])


@query("comp_ffill")
def q_comp_ffill(spark, sf):
    f = comp_ops.filled_rows(comp_grid(spark, sf))
    return to_edge(f.select("file", "sheet", "row_idx", F.col("cliente_raw").alias("cliente"),
                            F.col("centro_raw").alias("centro_costo")))


@query("parse_local_amount")
def q_parse_local_amount(spark, sf):
    rows = comp_ops.data_rows(comp_grid(spark, sf), comp_ops.detect_header(comp_grid(spark, sf)))
    return to_edge(rows.select("file", "sheet", "row_idx",
                               comp_ops.parse_local_amount("saldo_raw").alias("monto")))


@query("comp_items")
def q_comp_items(spark, sf):
    return to_edge(comp_ops.composition_items(comp_grid(spark, sf), AS_OF),
                   ["sheet", "row_idx", "cliente", "cliente_norm", "centro_costo", "saldo_abierto", "venc_comp",
                    "documento_ref", "dias_vencido_item", "esta_vencido"])


@query("comp_centers")
def q_comp_centers(spark, sf):
    return to_edge(comp_ops.customer_centers(comp_items(spark, sf)))


@query("comp_by_center")
def q_comp_by_center(spark, sf):
    return to_edge(comp_ops.debt_by_center(comp_items(spark, sf)))


@query("comp_summary")
def q_comp_summary(spark, sf):
    return to_edge(comp_ops.composition_summary(comp_items(spark, sf)))


@query("client_balances_comp")
def q_client_balances_comp(spark, sf):
    return to_edge(bal_ops.rank_debtors(balances_comp_fresh(spark, sf)))


def debt(spark: SparkSession, sf: str) -> DataFrame:
    return bal_ops.debt_base(balances_comp(spark, sf))


@query("debt_base")
def q_debt_base(spark, sf):
    return to_edge(debt(spark, sf).drop("ratio_cobranza"))


@query("aging_source_count")
def q_aging_source_count(spark, sf):
    return to_edge(bal_ops.aging_sources(debt(spark, sf)))


@query("aging_distribution")
def q_aging_distribution(spark, sf):
    d = debt(spark, sf).groupBy(F.col("aging_base").alias("aging")).agg(F.sum("saldo_deuda").alias("saldo"))
    return to_edge(d.withColumn("orden", aging_rank("aging")), ["aging", "orden", "saldo"])


@query("open_items_center")
def q_open_items_center(spark, sf):
    led = ledger(spark, sf)
    bc = balances_comp(spark, sf)
    debtors = bc.select("cliente", "saldo_actual")
    items = aging_ops.open_items(aging_ops.lifo_slices(led, debtors), AS_OF, centers=bc)
    return to_edge(items, aging_ops.ITEM_COLUMNS)


@query("comp_flexible_check")
def q_comp_flexible_check(spark, sf):
    return comp_ops.flexible_check(comp_grid(spark, sf))


def exports(spark: SparkSession, sf: str) -> DataFrame:
    """The composition workbook as a folder of delimited exports, read back."""
    def write(path: str) -> None:
        cells = comp_grid(spark, sf)
        exports_src.write_exports(cells, path, cells.select("file", "sheet").distinct().withColumn(
            "sheet_ordinal", F.right("sheet", F.lit(1)).cast("int") - 1), delimiter=";")

    return exports_src.read_exports(spark, _product(spark, sf, "exports", write), delimiter=";")


def export_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The grid of the exports, parsed once: every later step would parse the files again."""
    return shared(spark, sf, "export_cells", lambda: exports_src.grid(exports(spark, sf)))


@query("export_grid")
def q_export_grid(spark, sf):
    """Every row with cells of the exports, at its ordinal in its sheet."""
    cells = exports_src.grid(exports(spark, sf)).filter(F.size("cells") > 0)
    return to_edge(cells.select("file", "sheet", "row_idx", *[F.try_element_at("cells", F.lit(i + 1)).alias(f"c{i}") for i in range(5)]))


@query("export_items")
def q_export_items(spark, sf):
    """Open items of the sheet to use of each workbook: ``hoja1``, else the first."""
    cells = discovery.pick_sheet(export_cells(spark, sf))
    return to_edge(comp_ops.composition_items(cells, AS_OF), ["sheet", "row_idx", "cliente", "cliente_norm", "centro_costo", "saldo_abierto", "venc_comp",
                                                              "documento_ref", "dias_vencido_item", "esta_vencido"])


def rollup(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "rollup", lambda: roll_ops.daily_rollup(invoices(spark, sf)))


def client_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "client_numbers", lambda: dist_ops.client_numbers(invoices(spark, sf)))


def client_bitmaps(spark: SparkSession, sf: str) -> DataFrame:
    return shared(spark, sf, "client_bitmaps", lambda: dist_ops.client_bitmaps(invoices(spark, sf), client_numbers(spark, sf)), ("nivel",))


def _landing(folder: str) -> QueryFn:
    return lambda spark, sf: shared(spark, sf, f"landing_{folder}", lambda: fixtures.drifting_landings(spark, sf)[folder])


LANDINGS: dict[str, QueryFn] = {folder: _landing(folder) for folder in ("par", "impar")}
PRODUCTS: dict[str, QueryFn] = {**{f"landing_{k}": v for k, v in LANDINGS.items()}, "invoices": invoices, "rollup": rollup, "client_numbers": client_numbers, "client_bitmaps": client_bitmaps, "ledger": ledger, "ledger_clustered": ledger_clustered, "balances": balances, "comp_grid": comp_grid, "exports": exports, "export_cells": export_cells,
                                "comp_items": comp_items, "comp_summary": comp_summary, "balances_comp": balances_comp}


# --- functions callable from SQL ------------------------------------------------------
from arlens.functions import sql as sql_fns  # noqa: E402


@query("sql_scalars")
def q_sql_scalars(spark, sf):
    """Every scalar function over the ledger export and the composition grid's amounts."""
    sql_fns.register(spark)
    fixtures.ledger_raw(spark, sf).createOrReplaceTempView("mayor")
    parsed = spark.sql(f"""
        SELECT clave_cliente(cliente) AS clave, tipo_movimiento(documento) AS tipo, tramo_antiguedad(dias_vencido(DATE '{AS_OF}', fecha_vencimiento)) AS tramo,
               count(*) AS filas, CAST(sum(monto_local(CAST(debe AS STRING))) AS DECIMAL(28,2)) AS debe
        FROM mayor GROUP BY ALL""")
    return to_edge(parsed)


@query("sql_open_items")
def q_sql_open_items(spark, sf):
    """The LIFO items of the current balances through the table function."""
    led = ledger(spark, sf)
    fn = sql_fns.register_views(led, led_ops.current_balance(led))
    return to_edge(spark.sql(f"SELECT * FROM {fn}(DATE '{AS_OF}')"), aging_ops.ITEM_COLUMNS)


# --- M5: scope, permissions, options ------------------------------------------------
from arlens.functions.text import client_key, strip, title_case  # noqa: E402
from arlens.operators import briefing as brief_ops  # noqa: E402
from arlens.operators import distinct as dist_ops  # noqa: E402
from arlens.operators import levels as level_ops  # noqa: E402
from arlens.operators import policies as pol_ops  # noqa: E402
from arlens.operators import quality as q_ops  # noqa: E402
from arlens.operators import rejects as rej_ops  # noqa: E402
from arlens.operators import rollup as roll_ops  # noqa: E402
from arlens.operators import scope as scope_ops  # noqa: E402
from arlens.operators import views as view_ops  # noqa: E402

# --- fixed values: the selections a dashboard user makes in the fixtures -----------
FILTER_CLIENTS = ["Customer#000000002 S.A.U.", "customer#000000004 s.a.u.", "CUSTOMER#000000007 S.A.U."]
FILTER_CENTERS = ["ECONOMY", "PROMO"]
SEMI_CENTERS = ["ECONOMY", "1-URGENT"]
# --- end of fixed values -----------------------------------------------------------


def scoped_invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Invoices inside the default selection: the default date window."""
    return scope_ops.apply_scope(invoices(spark, sf), scope_ops.ScopeSpec(), rollup(spark, sf))


@query("date_window")
def q_date_window(spark, sf):
    days = rollup(spark, sf)
    return to_edge(roll_ops.date_window(days, *scope_ops.window_bounds(days)))


@query("year_to_date")
def q_year_to_date(spark, sf):
    return to_edge(roll_ops.year_to_date(rollup(spark, sf)))


@query("filter_clients_in")
def q_filter_clients_in(spark, sf):
    spec = scope_ops.ScopeSpec(clientes=FILTER_CLIENTS, clientes_modo=scope_ops.INCLUDE)
    return to_edge(scope_ops.billing_by(scope_ops.apply_scope(invoices(spark, sf), spec, rollup(spark, sf)), "cliente"))


@query("filter_clients_out")
def q_filter_clients_out(spark, sf):
    spec = scope_ops.ScopeSpec(clientes=FILTER_CLIENTS, clientes_modo=scope_ops.EXCLUDE)
    return to_edge(scope_ops.billing_by(scope_ops.apply_scope(invoices(spark, sf), spec, rollup(spark, sf)), "cliente"))


@query("filter_centers")
def q_filter_centers(spark, sf):
    spec = scope_ops.ScopeSpec(centros=FILTER_CENTERS, centros_modo=scope_ops.INCLUDE)
    return to_edge(scope_ops.billing_by(scope_ops.apply_scope(invoices(spark, sf), spec, rollup(spark, sf)), "linea_negocio", "linea"))


@query("row_permissions")
def q_row_permissions(spark, sf):
    grants = scope_ops.permission_rows(fixtures.permissions_doc(spark))
    return to_edge(scope_ops.rows_per_user(scoped_invoices(spark, sf), grants))


@query("policy_totals")
def q_policy_totals(spark, sf):
    """What one user per order may see, through the users' policies."""
    inv, clients = invoices(spark, sf), client_numbers(spark, sf)
    centers = dist_ops.client_numbers(inv.select(strip("linea_negocio").alias("cliente"))).withColumnRenamed("cliente", "centro")
    centers = stored(centers, "policy-centers")
    # Stored step by step: each step's shuffle files are gone before the next one writes its own.
    grants = stored(fixtures.many_grants(spark, sf), "many-grants")
    users, masks, listed = pol_ops.compile_policies(grants, clients, centers)
    dispose(grants)
    totals = pol_ops.policy_totals(inv, users, masks, listed, clients, centers)
    dispose(masks, centers)
    return to_edge(totals)


@query("center_semi_filter")
def q_center_semi_filter(spark, sf):
    keys = scope_ops.clients_of_centers(scoped_invoices(spark, sf), comp_items(spark, sf), SEMI_CENTERS)
    return to_edge(scope_ops.restrict_to_clients(balances(spark, sf), keys).select("cliente", "saldo_actual"))


def scoped(spark: SparkSession, sf: str) -> "scope_ops.Scoped":
    spec = scope_ops.ScopeSpec(clientes=FILTER_CLIENTS, clientes_modo=scope_ops.EXCLUDE, centros=SEMI_CENTERS)
    return scope_ops.scope_frames(invoices(spark, sf), balances_comp(spark, sf), ledger(spark, sf), comp_items(spark, sf), spec, AS_OF, rollup(spark, sf))


@query("scope_balances")
def q_scope_balances(spark, sf):
    return to_edge(scoped(spark, sf).balances.select("cliente", "saldo_actual", "saldo_vencido"))


@query("scope_movements")
def q_scope_movements(spark, sf):
    return to_edge(led_ops.movement_mix(scoped(spark, sf).movements))


@query("scope_items")
def q_scope_items(spark, sf):
    return to_edge(scoped(spark, sf).items.groupBy("cliente", "centro_costo").agg(
        F.count(F.lit(1)).alias("items"), F.sum("saldo_abierto").alias("saldo")))


@query("permission_rows_visible")
def q_permission_rows_visible(spark, sf):
    grants = scope_ops.permission_rows(fixtures.permissions_doc(spark))
    return to_edge(scope_ops.visible_rows(scoped_invoices(spark, sf), grants, "u_excl").select(
        "numero_comprobante", "cliente", "linea_negocio", F.col("monto_total_ars").alias("monto")))


@query("center_impact")
def q_center_impact(spark, sf):
    return to_edge(dist_ops.center_impact(client_bitmaps(spark, sf)))


@query("center_impact_window")
def q_center_impact_window(spark, sf):
    return to_edge(dist_ops.distinct_clients(client_bitmaps(spark, sf), *scope_ops.window_bounds(rollup(spark, sf))))


@query("billing_levels")
def q_billing_levels(spark, sf):
    return to_edge(level_ops.with_share(level_ops.billing_levels(rollup(spark, sf))))


@query("client_options")
def q_client_options(spark, sf):
    return scope_ops.option_list([(invoices(spark, sf), F.col("cliente")),
                                  (balances(spark, sf), F.col("cliente"))], "cliente")


@query("center_options")
def q_center_options(spark, sf):
    return scope_ops.option_list([(invoices(spark, sf), strip("linea_negocio")),
                                  (comp_items(spark, sf), strip("centro_costo")),
                                  (balances_comp(spark, sf), strip("centro_costo_principal"))], "centro")


# --- M1 / M6: views -------------------------------------------------------------------
@query("billing_totals")
def q_billing_totals(spark, sf):
    days = rollup(spark, sf)
    return to_edge(roll_ops.billing_totals(days, *scope_ops.window_bounds(days)))


@query("monthly_local")
def q_monthly_local(spark, sf):
    days = rollup(spark, sf)
    local = (F.col("razon_social") == view_ops.LOCAL) & (F.col("moneda_iso") == "ARS")
    return to_edge(roll_ops.monthly(days, *scope_ops.window_bounds(days), where=local))


@query("monthly_intl")
def q_monthly_intl(spark, sf):
    days = rollup(spark, sf)
    return to_edge(roll_ops.monthly(days, *scope_ops.window_bounds(days), where=F.col("razon_social") == view_ops.INTERNATIONAL))


@query("monthly_usd")
def q_monthly_usd(spark, sf):
    days = rollup(spark, sf)
    return to_edge(roll_ops.monthly(days, *scope_ops.window_bounds(days), "usd"))


@query("period_line_share")
def q_period_line_share(spark, sf):
    inv = scope_ops.apply_scope(invoices(spark, sf), scope_ops.ScopeSpec(all_dates=True))
    return to_edge(view_ops.period_line_share(inv.filter(F.col("razon_social") == view_ops.LOCAL)))


@query("line_mix")
def q_line_mix(spark, sf):
    return to_edge(view_ops.line_mix(scoped_invoices(spark, sf)))


@query("top_clients")
def q_top_clients(spark, sf):
    return to_edge(view_ops.top_clients(scoped_invoices(spark, sf)))


@query("top_clients_line")
def q_top_clients_line(spark, sf):
    inv = scoped_invoices(spark, sf)
    return to_edge(view_ops.top_clients(inv, view_ops.top_line(inv)))


@query("title_case_names")
def q_title_case_names(spark, sf):
    raw = fixtures.invoices_raw(spark, sf).select(F.col("cliente").alias("cliente_raw")).distinct()
    return raw.select("cliente_raw", title_case("cliente_raw").alias("cliente"))  # raw text: not the shared frame


@query("client_norm_key")
def q_client_norm_key(spark, sf):
    raw = fixtures.invoices_raw(spark, sf).select(F.col("cliente").alias("cliente_raw")).distinct()
    return raw.select("cliente_raw", client_key("cliente_raw").alias("cliente_norm"))


@query("billing_vs_debt")
def q_billing_vs_debt(spark, sf):
    return to_edge(view_ops.billing_vs_debt(scoped_invoices(spark, sf), debt(spark, sf)))


@query("top_debtors")
def q_top_debtors(spark, sf):
    return to_edge(view_ops.top_debtors(debt(spark, sf)))


@query("debt_totals")
def q_debt_totals(spark, sf):
    return to_edge(view_ops.debt_totals(debt(spark, sf)))


@query("open_items_drill")
def q_open_items_drill(spark, sf):
    return to_edge(view_ops.open_items_drill(comp_items(spark, sf), view_ops.debtor_top(debt(spark, sf)).select("cliente")))


@query("open_items_drill_lifo")
def q_open_items_drill_lifo(spark, sf):
    chosen = view_ops.debtor_top(debt(spark, sf)).select("cliente")
    debtors = balances(spark, sf).select("cliente", "saldo_actual").join(chosen, "cliente", "left_semi")
    led = scope_ops.restrict_to_clients(ledger(spark, sf), chosen)
    items = aging_ops.open_items(aging_ops.lifo_slices(led, debtors), AS_OF)
    return to_edge(view_ops.open_items_drill(items, chosen))


@query("selection_totals")
def q_selection_totals(spark, sf):
    d = debt(spark, sf)
    return to_edge(view_ops.selection_totals(d, comp_items(spark, sf), view_ops.debtor_top(d).select("cliente")))


@query("client_statement")
def q_client_statement(spark, sf):
    led = ledger_clustered(spark, sf).all()
    return to_edge(view_ops.client_statement(led, view_ops.largest_debtor(balances(spark, sf))))


@query("client_statement_totals")
def q_client_statement_totals(spark, sf):
    led = ledger_clustered(spark, sf).all()
    return to_edge(view_ops.client_statement_totals(led, view_ops.largest_debtor(balances(spark, sf))))


@query("kpi_financial")
def q_kpi_financial(spark, sf):
    return view_ops.kpi_financial(scoped_invoices(spark, sf), debt(spark, sf))


@query("briefing")
def q_briefing(spark, sf):
    return brief_ops.briefing(scoped_invoices(spark, sf), debt(spark, sf))


@query("quality_report")
def q_quality_report(spark, sf):
    return q_ops.quality_report(invoices(spark, sf), balances(spark, sf), comp_items(spark, sf), rejects=rejected(spark, sf))


def rejected(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the invoice export that could not be read."""
    raw = fixtures.invoices_raw(spark, sf)
    return rej_ops.reject_rows(rej_ops.with_rejects(raw, rej_ops.invoice_rejects(raw)), "facturas", "comprobante")


@query("rejects")
def q_rejects(spark, sf):
    return rejected(spark, sf)


@query("reject_summary")
def q_reject_summary(spark, sf):
    return rej_ops.reject_summary(rejected(spark, sf))


@query("landing_merge")
def q_landing_merge(spark, sf):
    """Two landing folders with differing columns as one table, added up per folder and month."""
    from arlens.sources.landing import merge_landings

    rows = merge_landings({k: read(spark, sf) for k, read in LANDINGS.items()}, {"iva": 0, "Condición pago": "SIN DATO"}, "carpeta")
    return to_edge(rows.groupBy("carpeta", F.right("fecha", F.lit(7)).alias("periodo"), "condicion_pago").agg(
        F.count("comprobante").alias("filas"), F.sum("cantidad").cast("decimal(28,4)").alias("cantidad"), F.sum("iva").cast("decimal(28,2)").alias("iva")))


@query("run_meta")
def q_run_meta(spark, sf):
    from arlens.sources.io import run_meta
    return run_meta(invoices(spark, sf), {"ultima_actualizacion": AS_OF.isoformat()})
