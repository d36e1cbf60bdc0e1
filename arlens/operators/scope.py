"""Scoping: date window (F4 A19), company (F3), customer and cost-centre
include/exclude lists (F5 F6), row-level permissions (F7 S11), centre
selection reaching the ledger (J10) and filter option lists (U2)."""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from arlens.functions.amounts import MONEY
from arlens.functions.text import strip, title_case
from arlens.operators.aging import open_items_source

INCLUDE = "Incluir"
EXCLUDE = "Excluir"

PERMISSIONS_SCHEMA = StructType([
    StructField("superusers", ArrayType(StringType())),
    StructField("users", MapType(StringType(), StructType([
        StructField("clientes", ArrayType(StringType())),
        StructField("clientes_modo", StringType()),
        StructField("centros", ArrayType(StringType())),
        StructField("centros_modo", StringType()),
        StructField("tabs", ArrayType(StringType())),
    ]))),
])


@dataclass
class ScopeSpec:
    """What a dashboard user selected. Empty lists mean "no filter"; without
    dates the default window holds (from January 1 of the last year), unless
    ``all_dates`` is set."""
    desde: _dt.date | None = None
    hasta: _dt.date | None = None
    empresa: str | None = None            # "Local" / "Internacional" / None = all
    clientes: list[str] = field(default_factory=list)
    clientes_modo: str = INCLUDE
    centros: list[str] = field(default_factory=list)
    centros_modo: str = INCLUDE
    all_dates: bool = False


def date_bounds(inv: DataFrame, desde=None, hasta=None) -> DataFrame:
    """One row ``(desde, hasta)``: default from max(first date, Jan 1 of the last
    year) to the last date; given bounds are clamped to the data range and
    swapped when reversed."""
    rng = inv.agg(F.min("fecha").alias("dmin"), F.max("fecha").alias("dmax"))
    lo = F.greatest(F.col("dmin"), F.make_date(F.year("dmax"), F.lit(1), F.lit(1))) if desde is None \
        else F.least(F.greatest(F.lit(desde).cast("date"), F.col("dmin")), F.col("dmax"))
    hi = F.col("dmax") if hasta is None else F.least(F.greatest(F.lit(hasta).cast("date"), F.col("dmin")), F.col("dmax"))
    return rng.select(F.least(lo, hi).alias("desde"), F.greatest(lo, hi).alias("hasta"))


def date_window(inv: DataFrame, desde=None, hasta=None) -> DataFrame:
    """Rows and billing inside the (default or given) date window; rows
    without a date never qualify. The bounds are scalar subqueries, so the
    filter runs where the scan is, with no join."""
    bounds = date_bounds(inv, desde, hasta).select(F.struct("desde", "hasta")).scalar()
    lo, hi = bounds["desde"], bounds["hasta"]
    inside = inv.filter(F.col("fecha").between(lo, hi))
    return inside.agg(F.count(F.lit(1)).alias("filas"), F.sum("monto_total_ars").alias("total")).select(
        lo.alias("desde"), hi.alias("hasta"), "filas",
        F.coalesce("total", F.lit(0).cast(MONEY)).alias("total"))


def in_list(df: DataFrame, col: str, values: list[str], mode: str = INCLUDE, key: Column | None = None) -> DataFrame:
    """Keep (include) or drop (exclude) rows whose ``col`` is in ``values``.

    The list becomes a one-column frame and a semi or anti join. It is a list of the
    caller's, so it fits the driver already and is sent to the tasks whole: without the
    hint its size is unknown to the planner, and all rows are shuffled and sorted by
    ``col`` to meet a few names.
    """
    k = key if key is not None else F.col(col)
    lst = F.broadcast(df.sparkSession.createDataFrame([(v,) for v in values], "_v string"))
    keyed = df.withColumn("_k", k)
    how = "left_semi" if mode == INCLUDE else "left_anti"
    return keyed.join(lst, keyed["_k"] == lst["_v"], how).drop("_k")


def window_bounds(dates: DataFrame, desde=None, hasta=None) -> tuple[Column, Column]:
    """(desde, hasta) of ``date_bounds`` as scalar subqueries."""
    bounds = date_bounds(dates, desde, hasta).select(F.struct("desde", "hasta")).scalar()
    return bounds["desde"], bounds["hasta"]


def apply_scope(inv: DataFrame, spec: ScopeSpec, dates: DataFrame | None = None) -> DataFrame:
    """Invoices inside a user's selection (dated rows only, like the window).

    ``dates`` is a small table with the dates of ``inv`` (the daily rollup), which then
    need not be scanned for its bounds. The window's years are a predicate of their own:
    where the invoices are partitioned by year, only those are read."""
    out = inv.filter(F.col("fecha").isNotNull())
    if not spec.all_dates:
        lo, hi = window_bounds(inv if dates is None else dates, spec.desde, spec.hasta)
        out = out.filter(F.col("anio").between(F.year(lo), F.year(hi)) & F.col("fecha").between(lo, hi))
    if spec.empresa:
        out = out.filter(F.col("razon_social") == spec.empresa)
    if spec.clientes:
        out = in_list(out, "cliente", [c.strip().title() for c in spec.clientes], spec.clientes_modo)
    if spec.centros:
        out = in_list(out, "linea_negocio", [c.strip() for c in spec.centros], spec.centros_modo,
                      key=strip("linea_negocio"))
    return out


@dataclass
class Scoped:
    """Every frame of the views inside one selection."""
    invoices: DataFrame
    balances: DataFrame
    movements: DataFrame
    items: DataFrame


def scope_frames(inv: DataFrame, bal: DataFrame, led: DataFrame, items: DataFrame, spec: ScopeSpec, as_of,
                 dates: DataFrame | None = None) -> Scoped:
    """A selection applied to invoices, balances, movements and items: customers
    by name everywhere; centres on invoices and items, and through the customers
    these leave also on balances and movements. If the centres leave no item,
    items are derived again from the scoped ledger."""
    names = [c.strip().title() for c in spec.clientes]

    def by_name(df: DataFrame) -> DataFrame:
        return in_list(df, "cliente", names, spec.clientes_modo) if names else df

    invoices, bal, led, items = apply_scope(inv, spec, dates), by_name(bal), by_name(led), by_name(items)
    if spec.centros:
        centres = [c.strip() for c in spec.centros]
        items = in_list(items, "centro_costo", centres, spec.centros_modo, key=strip("centro_costo"))
        keys = (invoices.select("cliente").unionByName(items.select("cliente")).filter(F.col("cliente").isNotNull()).distinct())
        bal, led = restrict_to_clients(bal, keys), restrict_to_clients(led, keys)
        items = open_items_source(items, led, bal, as_of)
    return Scoped(invoices, bal, led, items)


def visible_rows(inv: DataFrame, grants: DataFrame, user: str) -> DataFrame:
    """The invoice rows ``user`` may see: all for a superuser or a user without
    lists, else those its customer and centre lists include or do not exclude.
    An include list that matches nothing shows nothing; so does an unknown user."""
    mine = grants.filter(F.col("usuario") == user)
    facts = mine.agg(F.struct(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("ambito") == "superuser"), F.lit(False)).alias("all"),
                              *[F.max(F.when((F.col("ambito") == a) & F.col("valor").isNotNull(), F.col("modo"))).alias(a)
                                for a in ("clientes", "centros")])).scalar()
    out = inv.withColumn("_linea", strip("linea_negocio"))
    for scope, key in (("clientes", "cliente"), ("centros", "_linea")):
        listed = mine.filter((F.col("ambito") == scope) & F.col("valor").isNotNull()).select(F.col("valor").alias("_v")).distinct()
        out = out.join(listed, F.col(key) == F.col("_v"), "left")
        hit = F.col("_v").isNotNull()
        out = out.filter(facts["all"] | facts[scope].isNull() | F.when(facts[scope] == INCLUDE, hit).otherwise(~hit)).drop("_v")
    return out.filter(facts["n"] > 0).drop("_linea")


def billing_by(df: DataFrame, key: str, out_key: str | None = None) -> DataFrame:
    return df.groupBy(F.col(key).alias(out_key or key)).agg(
        F.count(F.lit(1)).alias("filas"), F.sum("monto_total_ars").alias("monto"))


# --- permissions ------------------------------------------------------------------
def permission_rows(doc: DataFrame) -> DataFrame:
    """Permissions document (JSON in ``valor``) -> one row per grant
    ``(usuario, ambito, modo, valor)``: ``superuser`` rows, then customer and
    centre list entries with their mode (default ``Excluir``). Customer names
    are title-cased, centres trimmed."""
    p = doc.select(F.from_json("valor", PERMISSIONS_SCHEMA).alias("p"))
    supers = p.select(F.explode("p.superusers").alias("usuario")).select(
        "usuario", F.lit("superuser").alias("ambito"), F.lit(None).cast("string").alias("modo"),
        F.lit(None).cast("string").alias("valor"))
    users = p.select(F.explode("p.users").alias("usuario", "u"))
    cli = users.select("usuario", F.lit("clientes").alias("ambito"),
                       F.coalesce("u.clientes_modo", F.lit(EXCLUDE)).alias("modo"),
                       F.explode_outer("u.clientes").alias("valor")) \
        .withColumn("valor", title_case("valor"))
    ctr = users.select("usuario", F.lit("centros").alias("ambito"),
                       F.coalesce("u.centros_modo", F.lit(EXCLUDE)).alias("modo"),
                       F.explode_outer("u.centros").alias("valor")) \
        .withColumn("valor", strip("valor"))
    return supers.unionByName(cli).unionByName(ctr)


def rows_per_user(inv: DataFrame, grants: DataFrame) -> DataFrame:
    """Rows and billing each user may see (every user, 0 when nothing).

    Superusers see everything. Otherwise a customer list and a centre list
    each include or exclude; an include list that matches nothing yields no
    rows (fail closed). Computed without pairing users with invoice rows:
    invoices are pre-aggregated per (customer, line), then per user the sums
    over "customer in list" (C), "line in list" (L) and both (CL) come from
    equi-joins and are combined by inclusion-exclusion with the total (T):
    inc/inc = CL, inc C/exc L = C - CL, exc C/inc L = L - CL,
    exc/exc = T - C - L + CL.
    """
    cube = inv.groupBy("cliente", strip("linea_negocio").alias("linea")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("monto_total_ars").alias("m"))
    total = cube.agg(F.struct(F.sum("n").alias("n"), F.sum("m").alias("m"))).scalar()
    t_n, t_m = total["n"], total["m"]

    g = grants.filter(F.col("ambito") != "superuser")
    cli = g.filter((F.col("ambito") == "clientes") & F.col("valor").isNotNull()).select("usuario", F.col("valor").alias("cliente")).distinct()
    ctr = g.filter((F.col("ambito") == "centros") & F.col("valor").isNotNull()).select("usuario", F.col("valor").alias("linea")).distinct()

    def sums(df, name):
        return df.groupBy("usuario").agg(F.sum("n").alias(f"{name}_n"), F.sum("m").alias(f"{name}_m"))

    # Summed per customer and per line before users are joined, so a user meets each key once.
    def per(key: str) -> DataFrame:
        return cube.groupBy(key).agg(F.sum("n").alias("n"), F.sum("m").alias("m"))

    s_c = sums(per("cliente").join(cli, "cliente"), "c")
    s_l = sums(per("linea").join(ctr, "linea"), "l")
    s_cl = sums(cube.join(cli, "cliente").join(ctr, ["usuario", "linea"]), "cl")

    users = grants.groupBy("usuario").agg(
        F.max(F.col("ambito") == "superuser").alias("is_super"),
        F.max(F.when(F.col("ambito") == "clientes", F.col("valor").isNotNull())).alias("has_c"),
        F.max(F.when(F.col("ambito") == "centros", F.col("valor").isNotNull())).alias("has_l"),
        F.max(F.when(F.col("ambito") == "clientes", F.col("modo") == INCLUDE)).alias("inc_c"),
        F.max(F.when(F.col("ambito") == "centros", F.col("modo") == INCLUDE)).alias("inc_l"))
    u = (users.join(s_c, "usuario", "left").join(s_l, "usuario", "left").join(s_cl, "usuario", "left")
              .fillna(0, subset=["c_n", "l_n", "cl_n"]))
    u = u.select("*", *[F.coalesce(F.col(f"{x}_m"), F.lit(0).cast(MONEY)).alias(f"{x}_mm") for x in ("c", "l", "cl")])

    has_c = F.coalesce("has_c", F.lit(False))
    has_l = F.coalesce("has_l", F.lit(False))
    inc_c = F.coalesce("inc_c", F.lit(False))
    inc_l = F.coalesce("inc_l", F.lit(False))

    def pick(t, c, l, cl):
        return (F.when(F.col("is_super"), t)
                 .when(~has_c & ~has_l, t)
                 .when(has_c & ~has_l, F.when(inc_c, c).otherwise(t - c))
                 .when(~has_c & has_l, F.when(inc_l, l).otherwise(t - l))
                 .when(inc_c & inc_l, cl)
                 .when(inc_c, c - cl)
                 .when(inc_l, l - cl)
                 .otherwise(t - c - l + cl))

    return u.select("usuario",
                    pick(t_n, F.col("c_n"), F.col("l_n"), F.col("cl_n")).cast("long").alias("filas"),
                    pick(F.coalesce(t_m, F.lit(0).cast(MONEY)), F.col("c_mm"), F.col("l_mm"), F.col("cl_mm"))
                    .cast(MONEY).alias("monto"))


# --- centre selection reaching the ledger -------------------------------------------
def clients_of_centers(inv: DataFrame, items: DataFrame | None, centers: list[str], mode: str = INCLUDE) -> DataFrame:
    """Customers related to the selected centres through invoices (line) and
    composition items (centre)."""
    keys = in_list(inv, "linea_negocio", centers, mode, key=strip("linea_negocio")).select("cliente")
    if items is not None:
        keys = keys.unionByName(in_list(items, "centro_costo", centers, mode, key=strip("centro_costo"))
                                .select("cliente"))
    return keys.filter(F.col("cliente").isNotNull()).distinct()


def restrict_to_clients(df: DataFrame, clients: DataFrame) -> DataFrame:
    """Semi-join on customer. An empty customer set gives no rows."""
    return df.join(clients, "cliente", "left_semi")


def center_impact(inv: DataFrame) -> DataFrame:
    """Distinct customers billed per centre (business line)."""
    return (inv.filter(F.col("cliente").isNotNull())
               .groupBy(strip("linea_negocio").alias("centro"))
               .agg(F.count_distinct("cliente").alias("clientes")))


def option_list(frames: list[tuple[DataFrame, Column]], name: str) -> DataFrame:
    """Distinct, non-blank, sorted union of option values."""
    out = None
    for df, col in frames:
        part = df.select(col.alias(name))
        out = part if out is None else out.unionByName(part)
    out = out.filter(F.col(name).isNotNull() & (F.col(name) != "")).distinct()
    return out.orderBy(name)
