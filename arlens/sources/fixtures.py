"""Landing tables derived from the driver's TPC-H-style tables.

The source system exports three spreadsheets (invoice lines, ledger
movements, open-balance composition) and a permissions document. These
builders reproduce them from ``lineitem/orders/customer/nation/part`` so every
product query runs on data that grows with the tables. The invoice landing is
all text (like a spreadsheet export); the ledger landing is typed; the
composition landing is a raw cell grid ``(file, sheet, row_idx, cells)``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from arlens.functions.amounts import MONEY
from arlens.operators.windows import month_slice, row_number, running_sum
from arlens.sources.tables import read_table

# --- fixed values of the fixture definition (FIXTURES.md) -------------------
AS_OF = _dt.date(2001, 9, 1)
LATE_CUTOFF = _dt.datetime(2001, 3, 1)
SHEETS = 3
COMPANY_MAP_FIXTURE = {"Empresa Local": "Local", "Empresa Internacional": "Internacional"}
PERMISSIONS_DOC = (
    '{"superusers":["admin"],'
    '"users":{"u_excl":{"clientes":["Customer#000000002 S.A.U."],"clientes_modo":"Excluir",'
    '"centros":["ECONOMY"],"centros_modo":"Incluir"},'
    '"u_incl":{"clientes":["customer#000000004 s.a.u."],"clientes_modo":"Incluir"},'
    '"u_none":{"clientes":["NO EXISTE"],"clientes_modo":"Incluir"}}}'
)
COMPOSITION_FILE = "composicion_saldos"
COMPOSITION_HEADER_ROWS = [
    ("Hoja1", 0, ["Reporte al 01/09/2001", None, None, None, None]),
    ("Hoja1", 1, ["Razo\u0301n Social", "Centro de Costo", "Saldo Abierto", "Fecha Vencimiento", "Comprobante"]),
    ("Hoja2", 0, ["Empresa Local", None, None, None, None]),
    ("Hoja2", 1, ["Cliente final", "Dim. valor", "Deuda al cierre", "Fecha Vto.", "Factura nro"]),
    ("Hoja3", 1, ["CLIENTE", "Línea negocio", "Importe Pendiente", "Vencimiento", "Documento"]),
    ("Hoja4", 1, ["Código", "Centro de Costo", "Saldo Abierto", "Fecha Vencimiento", "Comprobante"]),
]
# --- end of fixed values ----------------------------------------------------


def _money_text(c) -> F.Column:
    return c.cast(MONEY).cast("string")


def _dmy(c) -> F.Column:
    return F.date_format(c, "dd/MM/yyyy")


def invoices_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice export, one row per line item, every column text."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity",
                                                 "l_extendedprice", "l_tax", "l_returnflag", "l_linestatus"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    # nation is a fixed 25-row dimension at every scale factor: bounded broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]))
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_size", "p_type", "p_brand", "p_name"])

    head = (orders.join(cust, orders.o_custkey == cust.c_custkey)
                  .join(nation, cust.c_nationkey == nation.n_nationkey)
                  .select("o_orderkey", "o_orderdate", "o_orderpriority", "o_orderstatus", "c_name", "c_mktsegment", "n_regionkey"))
    rows = (li.join(head, li.l_orderkey == head.o_orderkey)
              .join(part, li.l_partkey == part.p_partkey))

    price = F.col("l_extendedprice").cast(MONEY)
    qty = F.col("l_quantity").cast(MONEY)
    credit = F.col("l_returnflag") == "R"
    return rows.select(
        F.when(credit & (F.col("l_linenumber") == 1), F.lit("Nota de Crédito de Ventas Electrónica"))
         .when(credit & (F.col("l_linenumber") == 2), F.lit("FCE Nota de Crédito de Ventas Electrónica MIPymes"))
         .otherwise(F.lit("Factura de Ventas Electrónica")).alias("documento"),
        F.when(F.col("l_orderkey") % 1000 == 7, F.lit("sin fecha")).otherwise(_dmy(F.col("o_orderdate"))).alias("fecha"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("comprobante"),
        F.concat(F.lit("  "), F.lower("c_name"), F.lit(" s.a.u. ")).alias("cliente"),
        price.cast("string").alias("gravado"),
        F.when(F.col("l_orderkey") % 13 == 0, F.lit("n/d")).otherwise(qty.cast("string")).alias("no_gravado"),
        F.when(F.col("n_regionkey") == 1, F.lit("Dólares"))
         .when(F.col("n_regionkey") == 2, F.lit(" Dollars"))
         .when(F.col("n_regionkey") == 3, F.lit("Euros"))
         .otherwise(F.lit("Pesos")).alias("moneda"),
        (price + qty).cast("string").alias("importe_principal"),
        qty.cast("string").alias("imp_usd"),
        F.when(F.col("n_regionkey").isin(1, 2), F.lit("Empresa Internacional"))
         .otherwise(F.lit("Empresa Local")).alias("empresa"),
        F.when(F.col("p_partkey") % 40 == 0, F.lit(""))
         .otherwise(F.concat(F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("_"), F.col("p_type")))
         .alias("nivel_1_dimension"),
        F.when(F.col("l_linestatus") == "O", price.cast("string")).otherwise(F.lit("")).alias("importe_pendiente"),
        F.col("l_tax").cast(MONEY).cast("string").alias("iva"),
        F.col("o_orderpriority").alias("condicion_pago"), F.col("p_brand").alias("producto"),
        F.col("p_name").alias("descripcion_item"),
        F.concat(F.lit("Pedido "), F.col("l_orderkey").cast("string")).alias("descripcion"),
        F.col("o_orderstatus").alias("situacion"), F.col("c_mktsegment").alias("dim_valor"),
        qty.cast("string").alias("cantidad"),
    )


def ledger_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer ledger: opening rows, one charge per order, collections, with
    the running balance the export carries (``saldo``)."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderstatus",
                                                  "o_totalprice", "o_orderdate"])
    oc = orders.join(cust.select("c_custkey", "c_name"), orders.o_custkey == cust.c_custkey)
    zero = F.lit(0).cast(MONEY)
    no_date = F.lit(None).cast(DateType())
    order_date = F.to_date("o_orderdate")

    opening = cust.filter(F.col("c_custkey") % 10 != 1).select(
        F.lit(-1).cast("long").alias("orden"), "c_name", F.lit("Saldo Inicial").alias("documento"),
        no_date.alias("fecha"), no_date.alias("venc"), zero.alias("debe"), zero.alias("haber"),
        F.when(F.col("c_custkey") % 10 == 0, F.col("c_acctbal").cast(MONEY)).otherwise(zero).alias("ini"))
    charges = oc.select(
        (F.col("o_orderkey") * 2).alias("orden"), "c_name",
        F.concat(F.lit("FACVTA - "), F.col("o_orderkey").cast("string")).alias("documento"),
        order_date.alias("fecha"),
        F.when(F.col("o_orderkey") % 50 == 0, no_date)
         .otherwise(F.date_add(order_date, (F.col("o_orderkey") % 4 * 30).cast("int"))).alias("venc"),
        F.col("o_totalprice").cast(MONEY).alias("debe"), zero.alias("haber"), zero.alias("ini"))
    early = F.col("o_orderdate") < F.lit(LATE_CUTOFF)
    collections = oc.filter((early & (F.col("o_orderkey") % 97 != 0)) | (F.col("o_orderstatus") == "P")).select(
        (F.col("o_orderkey") * 2 + 1).alias("orden"), "c_name",
        F.concat(F.when(F.col("o_orderkey") % 2 == 0, F.lit("COBRANZA_FCE - ")).otherwise(F.lit("ncvee - ")),
                 F.col("o_orderkey").cast("string")).alias("documento"),
        F.date_add(order_date, 20).alias("fecha"), no_date.alias("venc"), zero.alias("debe"),
        F.when(early, F.col("o_totalprice"))
         .otherwise(F.floor(F.col("o_totalprice") / 2).cast("double")).cast(MONEY).alias("haber"),
        zero.alias("ini"))

    mv = opening.unionByName(charges).unionByName(collections).withColumn(
        "_delta", F.col("ini") + F.col("debe") - F.col("haber"))
    mv = running_sum(mv, ["c_name"], [F.col("fecha").asc_nulls_first(), F.col("orden")], "_delta", "saldo", month_slice("fecha"))
    return mv.select(
        F.col("orden").alias("orden_origen"),
        F.concat(F.lit(" "), F.upper("c_name"), F.lit(" S.A.U.")).alias("cliente"),
        "documento", "fecha", F.col("venc").alias("fecha_vencimiento"), "debe", "haber",
        F.col("saldo").cast(MONEY).alias("saldo"))


def composition_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open-balance composition workbook as a cell grid of all orders and
    customers: title rows before the header, merged-cell blanks, local amount
    formats, headers with decomposed accents, short rows, and a sheet without a
    customer column, whose customers (a tenth) have no composition."""
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority",
                                                  "o_totalprice", "o_orderdate"])
    d = (orders.join(cust, orders.o_custkey == cust.c_custkey)
               .select((F.col("c_custkey") % SHEETS).alias("s"), "c_custkey", "c_name", "o_orderkey", "o_orderpriority",
                       "o_orderdate", F.col("o_totalprice").cast(MONEY).cast("string").alias("amt")))
    # Every tenth customer's rows are on sheets whose header has no customer column.
    d = d.withColumn("s", F.when(F.col("c_custkey") % 10 == 3, F.lit(SHEETS)).otherwise(F.col("s")))
    # c_name sorts like c_custkey, so blocks of keys are slices of a sheet.
    d = row_number(d, ["s"], [F.col("c_name"), F.col("o_orderkey")], "rn", F.floor(F.col("c_custkey") / 1000).cast("long"))
    d = row_number(d, ["c_name"], [F.col("o_orderkey")], "rc", F.floor(F.col("o_orderkey") / 1_000_000).cast("long"))

    k = F.col("o_orderkey")
    amt = F.col("amt")
    n = F.length(amt)
    c0 = (F.when(F.col("rc") == 1, F.concat(F.lower("c_name"), F.lit(" s.a.u.")))
           .when(k % 2 == 0, F.lit("")).otherwise(F.lit(None).cast("string")))
    c1 = F.when((F.col("rc") == 1) | (k % 3 != 0), F.col("o_orderpriority")).otherwise(F.lit(None).cast("string"))
    c2 = (F.when((k % 3 == 0) & (n > 6),
                 F.concat(F.lit("$ "), amt.substr(F.lit(1), n - 6), F.lit("."), amt.substr(n - 5, F.lit(3)), F.lit(","),
                          amt.substr(n - 1, F.lit(2))))
           .when(k % 3 == 1, F.replace(amt, F.lit("."), F.lit(",")))
           .otherwise(amt))
    c3 = F.when(k % 50 == 0, F.lit("")).otherwise(_dmy(F.col("o_orderdate")))
    c4 = F.concat(F.lit("FACVTA - "), k.cast("string"))
    data = d.select(
        F.lit(COMPOSITION_FILE).alias("file"),
        F.concat(F.lit("Hoja"), (F.col("s") + 1).cast("string")).alias("sheet"),
        (F.col("rn") + 1).cast("int").alias("row_idx"),
        F.when(k % 7 == 0, F.array(c0, c1, c2, c3)).otherwise(F.array(c0, c1, c2, c3, c4)).alias("cells"))
    header = spark.createDataFrame(
        [(COMPOSITION_FILE, sheet, idx, cells) for sheet, idx, cells in COMPOSITION_HEADER_ROWS],
        "file string, sheet string, row_idx int, cells array<string>")
    return data.unionByName(header)


def permissions_doc(spark: SparkSession) -> DataFrame:
    """The permissions document as one JSON text row (``valor``)."""
    return spark.createDataFrame([("permisos", PERMISSIONS_DOC)], "clave string, valor string")


def many_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants ``(usuario, ambito, modo, valor)`` of one user per order: a list with the order's
    customer and, but for every third order, one with the kinds of its parts."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    lines = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    user = F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("usuario")
    own = orders.join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        user, F.lit("clientes").alias("ambito"), F.when(F.col("o_orderkey") % 2 == 0, "Incluir").otherwise("Excluir").alias("modo"),
        F.concat(F.initcap("c_name"), F.lit(" S.A.U.")).alias("valor"))
    kinds = lines.filter(F.col("l_orderkey") % 3 != 0).join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("o_orderkey"), "p_type").distinct().select(
        user, F.lit("centros").alias("ambito"), F.when(F.col("o_orderkey") % 5 < 2, "Incluir").otherwise("Excluir").alias("modo"), F.col("p_type").alias("valor"))
    return own.unionByName(kinds)


def drifting_landings(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The invoice export as two folders, even years (with undated rows) and odd ones, whose
    columns drift: the even ones have no tax and a narrower quantity, the odd ones spell the
    voucher's column in capitals and carry the payment terms as well."""
    raw = invoices_raw(spark, sf_dir)
    odd = F.coalesce(F.right("fecha", F.lit(1)).isin("1", "3", "5", "7", "9"), F.lit(False))
    even = raw.filter(~odd).select("comprobante", "fecha", "cliente", F.col("cantidad").try_cast("decimal(10,2)").alias("cantidad"))
    return {"par": even, "impar": raw.filter(odd).select(
        "condicion_pago", F.col("comprobante").alias("COMPROBANTE"), "fecha", "cliente", F.col("cantidad").try_cast("decimal(14,4)").alias("cantidad"),
        F.col("iva").try_cast("decimal(18,2)").alias("iva"))}
