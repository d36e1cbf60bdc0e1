"""Open-balance composition workbook: header discovery (S2 S3 P12), merged-cell
forward fill (W4), amount parsing (P13), open items and per-customer summary
(A5-A10 J9 U1), cost-centre views (A8 A9 A10 A21), upload check (S6).

Input is a cell grid ``(file, sheet, row_idx, cells ARRAY<STRING>)`` holding
every sheet of every workbook, so all sheets are processed by one plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.functions.amounts import AMOUNT, clamp0, div_half_even, parse_local_amount  # noqa: F401
from arlens.functions.constants import (COMPOSITION_HEADER_ROWS, COMPOSITION_ROLES, FLEX_BALANCE_TOKENS,
                                        FLEX_CLIENT_TOKENS, FLEX_HEADER_ROWS, NO_CENTER)
from arlens.functions.dates import days_overdue, parse_dayfirst
from arlens.functions.text import client_key, header_key, header_key_alnum, strip, title_case
from arlens.operators.windows import forward_fill

SHEET_KEYS = ["file", "sheet"]
ROLE_ORDER = ["cliente", "centro", "saldo", "venc", "doc"]
# Rows of a sheet that one task fills together.
SLICE_ROWS = 10_000


def _any(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


def header_cells(grid: DataFrame, rows: int = COMPOSITION_HEADER_ROWS) -> DataFrame:
    """Cells of the first ``rows`` rows, one row per distinct header key per
    row: first position (scan order) and last position (the column a name
    lookup lands on)."""
    cells = (grid.filter(F.col("row_idx") < rows)
                 .select(*SHEET_KEYS, "row_idx", F.posexplode("cells").alias("pos", "cell")))
    # Spreadsheet blanks read as "nan" text before normalisation.
    cells = cells.withColumn("norm", header_key(F.coalesce(F.col("cell"), F.lit("nan"))))
    return cells.groupBy(*SHEET_KEYS, "row_idx", "norm").agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
        F.max_by("cell", "pos").alias("name"))


def _role_match(role: str) -> Column:
    """Match rank of a header cell for ``role``: an exact candidate first (by
    candidate order), else a substring candidate (by column order)."""
    cands = COMPOSITION_ROLES[role]
    exact = None
    for i, c in enumerate(cands):
        exact = F.when(F.col("norm") == c, F.lit(i)) if exact is None else exact.when(F.col("norm") == c, F.lit(i))
    sub = _any([F.col("norm").contains(c) for c in cands])
    return (F.when(exact.isNotNull(), F.struct(F.lit(0).alias("kind"), exact.alias("key"), F.col("last_pos").alias("pos"),
                                               F.col("name").alias("name")))
             .when(sub, F.struct(F.lit(1).alias("kind"), F.col("first_pos").alias("key"), F.col("last_pos").alias("pos"),
                                 F.col("name").alias("name"))))


def detect_header(grid: DataFrame) -> DataFrame:
    """Per sheet: the first of the scanned rows that has both a customer and a
    balance column, with the position and header text of each role (null when
    a role is absent). Sheets without such a row are dropped."""
    per_row = header_cells(grid).groupBy(*SHEET_KEYS, "row_idx").agg(
        *[F.min(_role_match(r)).alias(r) for r in ROLE_ORDER])
    ok = F.col("cliente").isNotNull() & F.col("saldo").isNotNull()
    best = per_row.filter(ok).groupBy(*SHEET_KEYS).agg(
        F.min_by(F.struct("row_idx", *ROLE_ORDER), F.col("row_idx")).alias("h"))
    return best.select(
        *SHEET_KEYS, F.col("h.row_idx").alias("header_row"),
        *[F.col(f"h.{r}.pos").alias(f"pos_{r}") for r in ROLE_ORDER],
        *[F.col(f"h.{r}.name").alias(f"col_{r}") for r in ROLE_ORDER])


def data_rows(grid: DataFrame, header: DataFrame) -> DataFrame:
    """Rows below the header with the role cells picked by position.

    ``header`` has one row per sheet; adaptive execution broadcasts it on its
    measured bytes, and splits a skewed sheet where it is too large for that.
    A row shorter than the header has nulls in the cells it lacks.
    """
    j = grid.join(header, SHEET_KEYS).filter(F.col("row_idx") > F.col("header_row"))

    def pick(role):
        return F.when(F.col(f"pos_{role}").isNotNull(),
                      F.try_element_at(F.col("cells"), (F.col(f"pos_{role}") + 1).cast("int")))

    return j.select(*SHEET_KEYS, "row_idx",
                    pick("cliente").alias("cliente_raw"), pick("centro").alias("centro_raw"),
                    pick("saldo").alias("saldo_raw"), pick("venc").alias("venc_raw"), pick("doc").alias("doc_raw"),
                    F.col("pos_centro").isNotNull().alias("has_centro"), F.col("pos_doc").isNotNull().alias("has_doc"))


def _sheet_slice() -> Column:
    return F.floor(F.col("row_idx") / SLICE_ROWS).cast("long")


def filled_rows(grid: DataFrame, header: DataFrame | None = None) -> DataFrame:
    """Data rows with merged customer / centre cells forward-filled within the
    sheet (blank counts as missing)."""
    rows = data_rows(grid, header if header is not None else detect_header(grid))
    rows = (rows.withColumn("cliente_raw", F.when(F.col("cliente_raw") != "", F.col("cliente_raw")))
                .withColumn("centro_raw", F.when(F.col("centro_raw") != "", F.col("centro_raw"))))
    return forward_fill(rows, SHEET_KEYS, [F.col("row_idx")], ["cliente_raw", "centro_raw"], _sheet_slice())


def composition_items(grid: DataFrame, as_of, header: DataFrame | None = None) -> DataFrame:
    """Open items: title-cased customer and its match key, cost centre (or
    ``Sin centro`` when the sheet has none), open balance, due date, document,
    days overdue (null without due date) and overdue flag. Rows without a
    customer or with a non-positive balance are dropped."""
    rows = data_rows(grid, header if header is not None else detect_header(grid))
    # Cells are read before the fill: a name once, not on each row it is filled down to, and
    # an amount once, not again in the filter below (which would be pushed to the text).
    rows = rows.select(
        *SHEET_KEYS, "row_idx", "has_centro",
        F.when(F.col("cliente_raw") != "", title_case("cliente_raw")).alias("_name"),
        F.when(F.col("centro_raw") != "", strip("centro_raw")).alias("_centro"),
        parse_local_amount("saldo_raw").alias("saldo_abierto"),
        parse_dayfirst("venc_raw").alias("venc_comp"),
        F.when(F.col("has_doc"), strip("doc_raw")).otherwise(F.lit("")).alias("documento_ref"))
    who = F.when(F.col("_name").isNotNull(), F.struct(F.col("_name").alias("cliente"), client_key("_name").alias("cliente_norm")))
    f = forward_fill(rows.withColumn("_who", who).drop("_name"), SHEET_KEYS, [F.col("row_idx")], ["_who", "_centro"], _sheet_slice())
    items = f.select(
        *SHEET_KEYS, "row_idx", "_who.cliente", "_who.cliente_norm",
        F.when(F.col("has_centro"), F.col("_centro")).otherwise(F.lit(NO_CENTER)).alias("centro_costo"),
        "saldo_abierto", "venc_comp", "documento_ref",
    ).filter((F.col("cliente_norm") != "") & (F.col("saldo_abierto") > 0))
    dias = days_overdue(as_of, "venc_comp")
    return (items.withColumn("dias_vencido_item", dias)
                 .withColumn("esta_vencido", F.coalesce(dias, F.lit(0)) > 0))


def center_totals(items: DataFrame) -> DataFrame:
    """Open balance per (customer, cost centre)."""
    return (items.filter(F.col("centro_costo").isNotNull())
                 .groupBy("cliente", "centro_costo").agg(F.sum("saldo_abierto").alias("saldo_abierto")))


def customer_centers(items: DataFrame) -> DataFrame:
    """Main centre (largest balance, ties by name) and the ``" | "`` list of the
    customer's centres by descending balance (blank names left out).

    The list is built from the already aggregated (customer, centre) rows, so
    each group holds one entry per distinct centre of that customer.
    """
    ct = center_totals(items)
    ranked = F.struct((-F.col("saldo_abierto")).alias("neg"), F.col("centro_costo").alias("centro"))
    listed = F.when(F.trim("centro_costo") != "", ranked)
    g = ct.groupBy("cliente").agg(F.min(ranked).alias("_main"), F.collect_list(listed).alias("_all"))
    return g.select(
        "cliente", F.col("_main.centro").alias("centro_costo_principal"),
        F.array_join(F.transform(F.array_sort("_all"), lambda x: x["centro"]), " | ").alias("centros_costo"))


def composition_summary(items: DataFrame) -> DataFrame:
    """Per customer: composition balance, overdue and not-due (>= 0) balance,
    balance-weighted days overdue (half-even), max days, oldest overdue due
    date, main centre and centre list."""
    v = F.col("esta_vencido")
    s = F.col("saldo_abierto")
    d = F.col("dias_vencido_item")
    per = items.groupBy("cliente").agg(
        F.sum(s).alias("saldo_composicion"),
        F.sum(F.when(v, s)).alias("_vencido"),
        F.sum(F.when(v, s * d)).alias("_peso"),
        F.max(F.when(v, d)).alias("dias_vencido_max_comp"),
        F.min(F.when(v, F.col("venc_comp"))).alias("venc_comp_min"),
    )
    zero = F.lit(0).cast(AMOUNT)
    venc = F.coalesce(F.col("_vencido"), zero)
    per = per.select(
        "cliente", "saldo_composicion", venc.alias("saldo_vencido_comp"),
        clamp0(F.col("saldo_composicion") - venc).alias("saldo_por_vencer_comp"),
        F.when(F.col("_vencido") > 0, div_half_even(F.col("_peso"), F.col("_vencido"), 0, in_scale=6).cast("int"))
         .when(F.col("_vencido").isNotNull(), F.lit(0)).alias("dias_vencido_comp"),
        "dias_vencido_max_comp", "venc_comp_min")
    return per.join(customer_centers(items), "cliente", "left")


def debt_by_center(items: DataFrame) -> DataFrame:
    """Open balance per cost centre."""
    return items.groupBy("centro_costo").agg(F.sum("saldo_abierto").alias("saldo_abierto"))


def flexible_check(grid: DataFrame) -> DataFrame:
    """Upload check per sheet: some row among the first six has a header cell
    containing a customer token and one containing a balance token."""
    cells = (grid.filter(F.col("row_idx") < FLEX_HEADER_ROWS)
                 .select(*SHEET_KEYS, "row_idx", F.explode("cells").alias("cell"))
                 .filter(F.col("cell").isNotNull() & (strip("cell") != ""))
                 .withColumn("k", header_key_alnum("cell")))
    per_row = cells.groupBy(*SHEET_KEYS, "row_idx").agg(
        F.max(_any([F.col("k").contains(t) for t in FLEX_CLIENT_TOKENS])).alias("has_client"),
        F.max(_any([F.col("k").contains(t) for t in FLEX_BALANCE_TOKENS])).alias("has_balance"))
    sheets = grid.select(*SHEET_KEYS).distinct()
    ok = per_row.groupBy(*SHEET_KEYS).agg(F.max(F.col("has_client") & F.col("has_balance")).alias("ok"))
    return sheets.join(ok, SHEET_KEYS, "left").select(*SHEET_KEYS, F.coalesce("ok", F.lit(False)).alias("ok"))
