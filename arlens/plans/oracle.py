"""Independent DuckDB SQL for every catalogue query.

Written as plain SQL over the driver's tables (pre-registered views), without
reusing the Spark expressions: grouped frames and full outer joins where the
Spark side fuses aggregates, correlated ordering via window functions, etc.
Each query is assembled from named CTEs (landing tables, cleaned tables) and a
final SELECT.
"""

from __future__ import annotations

AS_OF = "DATE '2001-09-01'"


def sql_div_half_even(num: str, den: str, scale: int, in_scale: int = 2) -> str:
    """num / den to ``scale`` digits, ties to even: round half up on exact integers
    (twice the numerator plus the divisor over twice the divisor), then step back
    from an odd result where the remainder was exactly one half."""
    n = f"CAST(abs({num}) * {10 ** (in_scale + scale)} AS HUGEINT)"
    d = f"CAST(abs({den}) * {10 ** in_scale} AS HUGEINT)"
    up = f"((2 * {n} + {d}) // (2 * {d}))"
    tie = f"((2 * {n} + {d}) % (2 * {d}) = 0 AND {up} % 2 = 1)"
    sign = f"(CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END)"
    return (f"(CASE WHEN ({den}) = 0 THEN NULL ELSE "
            f"CAST({sign} * ({up} - CASE WHEN {tie} THEN 1 ELSE 0 END) AS DOUBLE) / {float(10 ** scale)} END)")


# Title case: runs of letters / non-letters, first character of each run upper.
def sql_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower(trim({x})), '[\\p{{L}}]+|[^\\p{{L}}]+'), "
            f"lambda t: upper(t[1]) || t[2:]), '')")


def sql_key(x: str) -> str:
    """Customer match key (accent-free, alnum, upper, single spaces)."""
    return (f"(CASE WHEN {x} IS NULL OR lower(trim({x})) IN ('', 'nan', 'none') THEN '' ELSE "
            f"trim(regexp_replace(upper(regexp_replace(strip_accents({x}), '[^A-Za-z0-9 ]+', ' ', 'g')), "
            f"'\\s+', ' ', 'g')) END)")


def sql_header_key(x: str) -> str:
    k = f"regexp_replace(strip_accents({x}), '[^a-zA-Z0-9]+', '_', 'g')"
    return f"lower(regexp_replace({k}, '^_+|_+$', '', 'g'))"


def sql_aging(d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL THEN NULL WHEN {d} <= 0 THEN 'Al día' WHEN {d} <= 30 THEN '1–30 días' "
            f"WHEN {d} <= 60 THEN '31–60 días' WHEN {d} <= 90 THEN '61–90 días' ELSE '+90 días' END)")


def sql_aging_rank(a: str) -> str:
    return (f"(CASE {a} WHEN 'Al día' THEN 1 WHEN '1–30 días' THEN 2 WHEN '31–60 días' THEN 3 "
            f"WHEN '61–90 días' THEN 4 WHEN '+90 días' THEN 5 END)")


def sql_dmy(x: str) -> str:
    return f"CAST(try_strptime({x}, '%d/%m/%Y') AS DATE)"


def sql_amount(x: str) -> str:
    """Local-format amount parser."""
    t = f"regexp_replace(CASE WHEN {x} IS NULL OR trim({x}) IN ('', 'nan', 'None') THEN '0' ELSE trim({x}) END, '[^0-9,.\\-]', '', 'g')"
    return (f"coalesce(TRY_CAST(CASE WHEN contains({t}, ',') AND contains({t}, '.') "
            f"THEN replace(replace({t}, '.', ''), ',', '.') "
            f"WHEN contains({t}, ',') THEN replace({t}, ',', '.') ELSE {t} END AS DECIMAL(24,6)), 0)")


# --- landing tables (FIXTURES.md) --------------------------------------------
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("inv_raw", [], """
SELECT CASE WHEN l_returnflag='R' AND l_linenumber=1 THEN 'Nota de Crédito de Ventas Electrónica'
            WHEN l_returnflag='R' AND l_linenumber=2 THEN 'FCE Nota de Crédito de Ventas Electrónica MIPymes'
            ELSE 'Factura de Ventas Electrónica' END AS documento,
       CASE WHEN l_orderkey%1000=7 THEN 'sin fecha' ELSE
         concat(lpad(cast(day(o_orderdate) AS string),2,'0'),'/',lpad(cast(month(o_orderdate) AS string),2,'0'),'/',cast(year(o_orderdate) AS string)) END AS fecha,
       concat(cast(l_orderkey AS string),'-',cast(l_linenumber AS string)) AS comprobante,
       concat('  ',lower(c_name),' s.a.u. ') AS cliente,
       cast(cast(l_extendedprice AS decimal(18,2)) AS string) AS gravado,
       CASE WHEN l_orderkey%13=0 THEN 'n/d' ELSE cast(cast(l_quantity AS decimal(18,2)) AS string) END AS no_gravado,
       CASE WHEN n_regionkey=1 THEN 'Dólares' WHEN n_regionkey=2 THEN ' Dollars' WHEN n_regionkey=3 THEN 'Euros' ELSE 'Pesos' END AS moneda,
       cast(cast(l_extendedprice AS decimal(18,2)) + cast(l_quantity AS decimal(18,2)) AS string) AS importe_principal,
       cast(cast(l_quantity AS decimal(18,2)) AS string) AS imp_usd,
       CASE WHEN n_regionkey IN (1,2) THEN 'Empresa Internacional' ELSE 'Empresa Local' END AS empresa,
       CASE WHEN p_partkey%40=0 THEN '' ELSE concat(lpad(cast(p_size AS string),2,'0'),'_',p_type) END AS nivel_1_dimension,
       CASE WHEN l_linestatus='O' THEN cast(cast(l_extendedprice AS decimal(18,2)) AS string) ELSE '' END AS importe_pendiente,
       cast(cast(l_tax AS decimal(18,2)) AS string) AS iva, o_orderpriority AS condicion_pago, p_brand AS producto,
       p_name AS descripcion_item, concat('Pedido ',cast(l_orderkey AS string)) AS descripcion, o_orderstatus AS situacion,
       c_mktsegment AS dim_valor, cast(cast(l_quantity AS decimal(18,2)) AS string) AS cantidad
FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey
     JOIN nation ON c_nationkey=n_nationkey JOIN part ON l_partkey=p_partkey
""")

cte("led_mv", [], """
 SELECT cast(-1 AS bigint) AS orden, c_name, 'Saldo Inicial' AS documento,
        cast(NULL AS date) AS fecha, cast(NULL AS date) AS venc,
        cast(0 AS decimal(18,2)) AS debe, cast(0 AS decimal(18,2)) AS haber,
        CASE WHEN c_custkey%10=0 THEN cast(c_acctbal AS decimal(18,2)) ELSE cast(0 AS decimal(18,2)) END AS ini
 FROM customer WHERE c_custkey%10<>1
 UNION ALL
 SELECT o_orderkey*2, c_name, concat('FACVTA - ',cast(o_orderkey AS string)),
        cast(o_orderdate AS date),
        CASE WHEN o_orderkey%50=0 THEN NULL ELSE cast(o_orderdate AS date) + cast(30*(o_orderkey%4) AS int) END,
        cast(o_totalprice AS decimal(18,2)), cast(0 AS decimal(18,2)), cast(0 AS decimal(18,2))
 FROM orders JOIN customer ON o_custkey=c_custkey
 UNION ALL
 SELECT o_orderkey*2+1, c_name, concat(CASE WHEN o_orderkey%2=0 THEN 'COBRANZA_FCE - ' ELSE 'ncvee - ' END,cast(o_orderkey AS string)),
        cast(o_orderdate AS date) + 20, NULL, cast(0 AS decimal(18,2)),
        cast(CASE WHEN o_orderdate < timestamp '2001-03-01 00:00:00' THEN o_totalprice ELSE floor(o_totalprice/2) END AS decimal(18,2)),
        cast(0 AS decimal(18,2))
 FROM orders JOIN customer ON o_custkey=c_custkey
 WHERE (o_orderdate < timestamp '2001-03-01 00:00:00' AND o_orderkey%97<>0) OR o_orderstatus='P'
""")

cte("led_raw", ["led_mv"], """
SELECT orden AS orden_origen, concat(' ',upper(c_name),' S.A.U.') AS cliente, documento, fecha, venc AS fecha_vencimiento, debe, haber,
       cast(sum(ini+debe-haber) OVER (PARTITION BY c_name ORDER BY fecha NULLS FIRST, orden
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS decimal(18,2)) AS saldo
FROM led_mv
""")

cte("comp_d", [], """
 SELECT s, c_name, o_orderkey, o_orderpriority, o_orderdate, amt,
        row_number() OVER (PARTITION BY s ORDER BY c_name, o_orderkey) AS rn,
        row_number() OVER (PARTITION BY c_name ORDER BY o_orderkey) AS rc
 FROM (SELECT CASE WHEN c_custkey%10=3 THEN 3 ELSE c_custkey%3 END AS s, c_name, o_orderkey, o_orderpriority, o_orderdate,
              cast(cast(o_totalprice AS decimal(18,2)) AS string) AS amt
       FROM orders JOIN customer ON o_custkey=c_custkey)
""")

cte("comp_raw", ["comp_d"], """
SELECT 'composicion_saldos' AS file, concat('Hoja',cast(s+1 AS string)) AS sheet, cast(rn+1 AS int) AS row_idx,
       CASE WHEN rc=1 THEN concat(lower(c_name),' s.a.u.') WHEN o_orderkey%2=0 THEN '' ELSE NULL END AS c0,
       CASE WHEN rc=1 OR o_orderkey%3<>0 THEN o_orderpriority ELSE NULL END AS c1,
       CASE WHEN o_orderkey%3=0 AND length(amt)>6
              THEN concat('$ ',substr(amt,1,length(amt)-6),'.',substr(amt,length(amt)-5,3),',',substr(amt,length(amt)-1,2))
            WHEN o_orderkey%3=1 THEN replace(amt,'.',',') ELSE amt END AS c2,
       CASE WHEN o_orderkey%50=0 THEN '' ELSE
         concat(lpad(cast(day(o_orderdate) AS string),2,'0'),'/',lpad(cast(month(o_orderdate) AS string),2,'0'),'/',cast(year(o_orderdate) AS string)) END AS c3,
       CASE WHEN o_orderkey%7<>0 THEN concat('FACVTA - ',cast(o_orderkey AS string)) END AS c4
FROM comp_d
UNION ALL SELECT 'composicion_saldos','Hoja1',0,'Reporte al 01/09/2001',NULL,NULL,NULL,NULL
UNION ALL SELECT 'composicion_saldos','Hoja1',1,'Razo'||chr(769)||'n Social','Centro de Costo','Saldo Abierto','Fecha Vencimiento','Comprobante'
UNION ALL SELECT 'composicion_saldos','Hoja2',0,'Empresa Local',NULL,NULL,NULL,NULL
UNION ALL SELECT 'composicion_saldos','Hoja2',1,'Cliente final','Dim. valor','Deuda al cierre','Fecha Vto.','Factura nro'
UNION ALL SELECT 'composicion_saldos','Hoja3',1,'CLIENTE','Línea negocio','Importe Pendiente','Vencimiento','Documento'
UNION ALL SELECT 'composicion_saldos','Hoja4',1,'Código','Centro de Costo','Saldo Abierto','Fecha Vencimiento','Comprobante'
""")

# --- cleaned invoices ----------------------------------------------------------
cte("inv", ["inv_raw"], f"""
SELECT {sql_dmy('fecha')} AS fecha,
       comprobante AS numero_comprobante,
       {sql_title('cliente')} AS cliente,
       trim(empresa) AS empresa,
       trim(documento) AS tipo_documento,
       CASE trim(moneda) WHEN 'Pesos' THEN 'ARS' WHEN 'Dólares' THEN 'USD' WHEN 'Dollars' THEN 'USD' ELSE trim(moneda) END AS moneda_iso,
       CASE trim(empresa) WHEN 'Empresa Local' THEN 'Local' WHEN 'Empresa Internacional' THEN 'Internacional' ELSE trim(empresa) END AS razon_social,
       coalesce(trim(documento) IN ('Nota de Crédito de Ventas Electrónica', 'FCE Nota de Crédito de Ventas Electrónica MIPymes'), false) AS es_nota_credito,
       coalesce(TRY_CAST(importe_principal AS DECIMAL(18,2)), 0) AS monto_total_ars,
       CAST(coalesce(TRY_CAST(gravado AS DECIMAL(18,2)), 0) + coalesce(TRY_CAST(no_gravado AS DECIMAL(18,2)), 0) AS DECIMAL(18,2)) AS monto_neto_ars,
       coalesce(TRY_CAST(imp_usd AS DECIMAL(18,2)), 0) AS monto_usd,
       coalesce(TRY_CAST(importe_pendiente AS DECIMAL(18,2)), 0) AS importe_pendiente,
       year({sql_dmy('fecha')}) AS anio, month({sql_dmy('fecha')}) AS mes,
       strftime({sql_dmy('fecha')}, '%b %Y') AS mes_nombre,
       regexp_replace(trim(nivel_1_dimension), '^[0-9]+_', '') AS linea_negocio,
       coalesce(TRY_CAST(iva AS DECIMAL(18,2)), 0) AS iva, condicion_pago, producto, descripcion_item, descripcion, situacion,
       dim_valor, coalesce(TRY_CAST(cantidad AS DECIMAL(18,2)), 0) AS cantidad
FROM inv_raw
""")

# Every dated invoice, and the default window: from January 1 of the last year (or the first date) to the last date.
cte("inv_d", ["inv"], "SELECT * FROM inv WHERE fecha IS NOT NULL")
cte("inv_s", ["inv_d"], """
SELECT * FROM inv_d WHERE fecha >= (SELECT greatest(min(fecha), make_date(year(max(fecha)), 1, 1)) FROM inv_d)
""")


def build(body: str, needs: list[str]) -> str:
    """Prefix ``body`` with the CTEs it needs (dependencies first)."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    body = body.strip()
    if not order:
        return body
    parts = [f"{n} AS ({CTES[n][1].strip()})" for n in order]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


ORACLE: dict[str, str] = {}


def oracle(name: str, needs: list[str], body: str) -> None:
    ORACLE[name] = build(body, needs)


# --- M0 / M1: invoices -----------------------------------------------------------
oracle("inv_clean", ["inv"], """
SELECT fecha, numero_comprobante, cliente, empresa, tipo_documento, moneda_iso, razon_social, es_nota_credito,
       CAST(monto_total_ars AS DOUBLE) AS monto_total_ars, CAST(monto_neto_ars AS DOUBLE) AS monto_neto_ars,
       CAST(monto_usd AS DOUBLE) AS monto_usd, CAST(importe_pendiente AS DOUBLE) AS importe_pendiente,
       CAST(anio AS BIGINT) AS anio, CAST(mes AS BIGINT) AS mes, mes_nombre, linea_negocio, CAST(iva AS DOUBLE) AS iva, condicion_pago, producto,
       descripcion_item, descripcion, situacion, dim_valor, CAST(cantidad AS DOUBLE) AS cantidad
FROM inv
""")

oracle("customer_summary", ["inv"], """
WITH fact AS (SELECT * FROM inv WHERE NOT es_nota_credito AND cliente IS NOT NULL AND razon_social IS NOT NULL),
ars AS (SELECT cliente, razon_social, sum(monto_total_ars) AS facturado_ars, sum(importe_pendiente) AS pendiente_ars,
               count(numero_comprobante) AS cantidad_fact
        FROM fact WHERE moneda_iso = 'ARS' GROUP BY cliente, razon_social),
usd AS (SELECT cliente, razon_social, sum(monto_usd) AS facturado_usd, sum(importe_pendiente) AS pendiente_usd
        FROM fact WHERE moneda_iso = 'USD' GROUP BY cliente, razon_social)
SELECT coalesce(ars.cliente, usd.cliente) AS cliente, coalesce(ars.razon_social, usd.razon_social) AS razon_social,
       CAST(coalesce(facturado_ars, 0) AS DOUBLE) AS facturado_ars, CAST(coalesce(pendiente_ars, 0) AS DOUBLE) AS pendiente_ars,
       coalesce(cantidad_fact, 0) AS cantidad_fact,
       CAST(coalesce(facturado_usd, 0) AS DOUBLE) AS facturado_usd, CAST(coalesce(pendiente_usd, 0) AS DOUBLE) AS pendiente_usd
FROM ars FULL OUTER JOIN usd ON ars.cliente = usd.cliente AND ars.razon_social = usd.razon_social
""")


# --- M2 / M3: ledger ----------------------------------------------------------------
_PREFIX_RE = "^(COBRANZA|COBRANZA_FCE|NCVEE|FCEVCTA|FCEINCVTAELEC|FCENCVTAELEC)"
cte("led", ["led_raw"], f"""
SELECT orden_origen, {sql_title('cliente')} AS cliente, coalesce(trim(documento), '') AS documento,
       fecha, fecha_vencimiento, debe, haber, saldo,
       CASE WHEN coalesce(trim(documento), '') IN ('', 'Saldo Inicial') THEN 'Saldo Inicial'
            WHEN regexp_matches(upper(trim(split_part(coalesce(trim(documento), ''), ' - ', 1))), '{_PREFIX_RE}') THEN 'Cobro/NC'
            ELSE 'Factura/Cargo' END AS tipo
FROM led_raw
""")

cte("led_ord", ["led"], """
SELECT *, row_number() OVER (PARTITION BY cliente ORDER BY fecha ASC NULLS FIRST, orden_origen ASC) AS rn_first,
          row_number() OVER (PARTITION BY cliente ORDER BY fecha DESC NULLS LAST, orden_origen DESC) AS rn_last
FROM led WHERE cliente IS NOT NULL AND cliente <> ''
""")

cte("recon", ["led_ord"], """
SELECT cliente,
       max(CASE WHEN rn_first = 1 THEN saldo END) AS saldo_inicial,
       CAST(sum(debe) AS DECIMAL(18,2)) AS debe_total, CAST(sum(haber) AS DECIMAL(18,2)) AS haber_total,
       max(CASE WHEN rn_last = 1 THEN saldo END) AS saldo_final_ledger
FROM led_ord GROUP BY cliente
""")

cte("debt", ["recon"], "SELECT cliente, saldo_final_ledger AS saldo_actual FROM recon WHERE saldo_final_ledger > 0")

cte("lifo", ["led", "debt"], """
SELECT cliente, documento, fecha, venc, orden_origen, debe, saldo_actual,
       least(debe, saldo_actual - prev) AS tramo
FROM (
  SELECT l.cliente, l.documento, l.fecha, l.fecha_vencimiento AS venc, l.orden_origen, l.debe, d.saldo_actual,
         coalesce(sum(l.debe) OVER (PARTITION BY l.cliente
                                   ORDER BY l.fecha_vencimiento DESC NULLS LAST, l.fecha DESC NULLS LAST, l.orden_origen ASC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prev
  FROM led l JOIN debt d ON l.cliente = d.cliente
  WHERE l.tipo = 'Factura/Cargo' AND l.debe > 0
) WHERE saldo_actual - prev > 0
""")

cte("lifo_agg", ["lifo"], f"""
SELECT cliente,
       sum(CASE WHEN venc IS NOT NULL AND datediff('day', venc, {AS_OF}) > 0 THEN tramo END) AS vencido,
       sum(CASE WHEN venc IS NOT NULL AND datediff('day', venc, {AS_OF}) > 0 THEN tramo * datediff('day', venc, {AS_OF}) END) AS peso,
       max(CASE WHEN venc IS NOT NULL AND datediff('day', venc, {AS_OF}) > 0 THEN datediff('day', venc, {AS_OF}) END) AS dmax,
       min(CASE WHEN venc IS NOT NULL AND datediff('day', venc, {AS_OF}) > 0 THEN venc END) AS venc_min,
       min(CASE WHEN venc IS NOT NULL AND datediff('day', venc, {AS_OF}) <= 0 THEN venc END) AS prox
FROM lifo GROUP BY cliente
""")

cte("aging", ["debt", "lifo_agg"], f"""
SELECT d.cliente, d.saldo_actual AS saldo_pendiente_cc,
       CAST(coalesce(a.vencido, 0) AS DECIMAL(18,2)) AS saldo_vencido,
       CAST(greatest(d.saldo_actual - coalesce(a.vencido, 0), 0) AS DECIMAL(18,2)) AS saldo_por_vencer,
       a.venc_min AS venc, a.prox AS prox_vencimiento,
       CAST(coalesce({sql_div_half_even('a.peso', 'a.vencido', 0)}, 0) AS BIGINT) AS dias_vencido,
       coalesce(a.dmax, 0) AS dias_vencido_max,
       coalesce(a.venc_min, a.prox) AS venc_referencia
FROM debt d LEFT JOIN lifo_agg a ON d.cliente = a.cliente
""")

cte("bal", ["recon", "aging"], f"""
SELECT r.cliente, r.saldo_final_ledger AS saldo_actual, r.saldo_inicial, r.debe_total, r.haber_total,
       CAST(r.saldo_inicial + r.debe_total - r.haber_total AS DECIMAL(18,2)) AS saldo_reconstruido,
       r.saldo_final_ledger,
       CAST(r.saldo_final_ledger - (r.saldo_inicial + r.debe_total - r.haber_total) AS DECIMAL(18,2)) AS dif_conciliacion,
       abs(r.saldo_final_ledger - (r.saldo_inicial + r.debe_total - r.haber_total)) <= 1.0 AS conciliado,
       coalesce(a.saldo_pendiente_cc, r.saldo_final_ledger) AS saldo_pendiente_cc,
       coalesce(a.saldo_vencido, 0) AS saldo_vencido,
       greatest(coalesce(a.saldo_por_vencer, r.saldo_final_ledger - coalesce(a.saldo_vencido, 0)), 0) AS saldo_por_vencer,
       coalesce(a.venc_referencia, {AS_OF}) AS venc, a.prox_vencimiento,
       coalesce(a.dias_vencido, 0) AS dias_vencido, coalesce(a.dias_vencido_max, 0) AS dias_vencido_max,
       a.venc_referencia, 'cc_movimientos' AS fuente_aging,
       {sql_aging('coalesce(a.dias_vencido, 0)')} AS aging,
       r.debe_total AS total_facturado, r.haber_total AS total_cobrado,
       {sql_div_half_even('r.haber_total * 100', 'CASE WHEN r.debe_total = 0 THEN 1 ELSE r.debe_total END', 1)} AS ratio_cobranza
FROM recon r LEFT JOIN aging a ON r.cliente = a.cliente
WHERE r.saldo_final_ledger > 0
""")

_BAL_OUT = """
SELECT cliente, CAST(saldo_actual AS DOUBLE) AS saldo_actual, CAST(saldo_inicial AS DOUBLE) AS saldo_inicial,
       CAST(debe_total AS DOUBLE) AS debe_total, CAST(haber_total AS DOUBLE) AS haber_total,
       CAST(saldo_reconstruido AS DOUBLE) AS saldo_reconstruido, CAST(saldo_final_ledger AS DOUBLE) AS saldo_final_ledger,
       CAST(dif_conciliacion AS DOUBLE) AS dif_conciliacion, conciliado,
       CAST(saldo_pendiente_cc AS DOUBLE) AS saldo_pendiente_cc, CAST(saldo_vencido AS DOUBLE) AS saldo_vencido,
       CAST(saldo_por_vencer AS DOUBLE) AS saldo_por_vencer, venc, prox_vencimiento,
       CAST(dias_vencido AS BIGINT) AS dias_vencido, CAST(dias_vencido_max AS BIGINT) AS dias_vencido_max,
       venc_referencia, fuente_aging, aging,
       CAST(total_facturado AS DOUBLE) AS total_facturado, CAST(total_cobrado AS DOUBLE) AS total_cobrado, ratio_cobranza
"""

oracle("mov_classify", ["led"], """
SELECT tipo, count(*) AS movimientos, CAST(sum(debe) AS DOUBLE) AS debe, CAST(sum(haber) AS DOUBLE) AS haber
FROM led GROUP BY tipo
""")

oracle("ledger_running", ["led"], """
SELECT cliente, orden_origen, CAST(saldo AS DOUBLE) AS saldo,
       CAST(sum(CASE WHEN tipo = 'Saldo Inicial' THEN saldo ELSE debe - haber END)
            OVER (PARTITION BY cliente ORDER BY fecha ASC NULLS FIRST, orden_origen ASC
                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS saldo_recalculado
FROM led WHERE cliente IS NOT NULL AND cliente <> ''
""")

oracle("current_balance", ["recon"], """
SELECT cliente, CAST(saldo_final_ledger AS DOUBLE) AS saldo_actual FROM recon
""")

oracle("reconcile", ["recon"], """
SELECT cliente, CAST(saldo_inicial AS DOUBLE) AS saldo_inicial, CAST(debe_total AS DOUBLE) AS debe_total,
       CAST(haber_total AS DOUBLE) AS haber_total,
       CAST(saldo_inicial + debe_total - haber_total AS DOUBLE) AS saldo_reconstruido,
       CAST(saldo_final_ledger AS DOUBLE) AS saldo_final_ledger,
       CAST(saldo_final_ledger - (saldo_inicial + debe_total - haber_total) AS DOUBLE) AS dif_conciliacion,
       abs(saldo_final_ledger - (saldo_inicial + debe_total - haber_total)) <= 1.0 AS conciliado
FROM recon
""")

oracle("open_items_lifo", ["lifo"], f"""
SELECT cliente, {sql_key('cliente')} AS cliente_norm, documento AS documento_ref, venc AS venc_comp,
       CAST(tramo AS DOUBLE) AS saldo_abierto,
       coalesce(datediff('day', venc, {AS_OF}), 0) AS dias_vencido_item, 'Sin centro' AS centro_costo
FROM lifo
""")

ORACLE["sql_open_items"] = ORACLE["open_items_lifo"]

oracle("sql_scalars", ["led"], f"""
SELECT {sql_key('cliente')} AS clave, tipo, {sql_aging(f"datediff('day', fecha_vencimiento, {AS_OF})")} AS tramo, count(*) AS filas,
       CAST(sum(debe) AS DOUBLE) AS debe
FROM led GROUP BY ALL
""")

oracle("aging_by_client", ["aging"], f"""
SELECT cliente, CAST(saldo_pendiente_cc AS DOUBLE) AS saldo_pendiente_cc, CAST(saldo_vencido AS DOUBLE) AS saldo_vencido,
       CAST(saldo_por_vencer AS DOUBLE) AS saldo_por_vencer, venc, prox_vencimiento, dias_vencido,
       CAST(dias_vencido_max AS BIGINT) AS dias_vencido_max, venc_referencia, {sql_aging('dias_vencido')} AS aging
FROM aging
""")

oracle("client_balances", ["bal"], _BAL_OUT + " FROM bal")


# --- M4: composition -----------------------------------------------------------------
_ROLES = {
    "cliente": "cliente razon_social razonsocial",
    "centro": "centro_de_costo centro_costo centro linea_negocio nivel_1_dimension dim_valor",
    "saldo": "saldo_abierto saldo importe_pendiente pendiente deuda importe",
    "venc": "fecha_vencimiento vencimiento fecha_vto fecha_de_vencimiento",
    "doc": "documento comprobante factura numero_comprobante numero_factura",
}


def _role_values() -> str:
    rows = []
    for role, cands in ((r, c.split()) for r, c in _ROLES.items()):
        for i, c in enumerate(cands):
            rows.append(f"('{role}', {i}, '{c}')")
    return "VALUES " + ", ".join(rows)


cte("comp_cells", ["comp_raw"], " UNION ALL ".join(
    f"SELECT file, sheet, row_idx, {i} AS pos, c{i} AS cell FROM comp_raw" for i in range(5)))

cte("comp_hdr_cells", ["comp_cells"], f"""
SELECT file, sheet, row_idx, norm, min(pos) AS first_pos, max(pos) AS last_pos, arg_max(cell, pos) AS name
FROM (SELECT file, sheet, row_idx, pos, cell, {sql_header_key("coalesce(cell, 'nan')")} AS norm
      FROM comp_cells WHERE row_idx < 8)
GROUP BY file, sheet, row_idx, norm
""")

cte("comp_role_hits", ["comp_hdr_cells"], f"""
SELECT * FROM (
  SELECT h.file, h.sheet, h.row_idx, c.role, h.last_pos AS pos, h.name,
         row_number() OVER (PARTITION BY h.file, h.sheet, h.row_idx, c.role
                            ORDER BY CASE WHEN h.norm = c.cand THEN 0 ELSE 1 END,
                                     CASE WHEN h.norm = c.cand THEN c.prio ELSE h.first_pos END) AS rk
  FROM comp_hdr_cells h JOIN ({_role_values()}) AS c(role, prio, cand) ON contains(h.norm, c.cand)
) WHERE rk = 1
""")

cte("comp_hdr", ["comp_role_hits"], """
SELECT file, sheet, header_row,
       max(CASE WHEN role = 'cliente' THEN pos END) AS pos_cliente, max(CASE WHEN role = 'centro' THEN pos END) AS pos_centro,
       max(CASE WHEN role = 'saldo' THEN pos END) AS pos_saldo, max(CASE WHEN role = 'venc' THEN pos END) AS pos_venc,
       max(CASE WHEN role = 'doc' THEN pos END) AS pos_doc,
       max(CASE WHEN role = 'cliente' THEN name END) AS col_cliente, max(CASE WHEN role = 'centro' THEN name END) AS col_centro,
       max(CASE WHEN role = 'saldo' THEN name END) AS col_saldo, max(CASE WHEN role = 'venc' THEN name END) AS col_venc,
       max(CASE WHEN role = 'doc' THEN name END) AS col_doc
FROM (SELECT r.*, r.row_idx AS header_row FROM comp_role_hits r
      JOIN (SELECT file, sheet, min(row_idx) AS first_ok FROM (
              SELECT file, sheet, row_idx FROM comp_role_hits GROUP BY file, sheet, row_idx
              HAVING count(*) FILTER (WHERE role = 'cliente') > 0 AND count(*) FILTER (WHERE role = 'saldo') > 0)
            GROUP BY file, sheet) k
        ON r.file = k.file AND r.sheet = k.sheet AND r.row_idx = k.first_ok)
GROUP BY file, sheet, header_row
""")


def _pick(p: str) -> str:
    return f"(CASE g.{p} WHEN 0 THEN r.c0 WHEN 1 THEN r.c1 WHEN 2 THEN r.c2 WHEN 3 THEN r.c3 WHEN 4 THEN r.c4 END)"


cte("comp_rows", ["comp_raw", "comp_hdr"], f"""
SELECT r.file, r.sheet, r.row_idx, {_pick('pos_cliente')} AS cliente_raw, {_pick('pos_centro')} AS centro_raw,
       {_pick('pos_saldo')} AS saldo_raw, {_pick('pos_venc')} AS venc_raw, {_pick('pos_doc')} AS doc_raw,
       g.pos_centro IS NOT NULL AS has_centro, g.pos_doc IS NOT NULL AS has_doc
FROM comp_raw r JOIN comp_hdr g ON r.file = g.file AND r.sheet = g.sheet
WHERE r.row_idx > g.header_row
""")

cte("comp_filled", ["comp_rows"], """
SELECT file, sheet, row_idx,
       last_value(nullif(cliente_raw, '') IGNORE NULLS) OVER w AS cliente_raw,
       last_value(nullif(centro_raw, '') IGNORE NULLS) OVER w AS centro_raw,
       saldo_raw, venc_raw, doc_raw, has_centro, has_doc
FROM comp_rows
WINDOW w AS (PARTITION BY file, sheet ORDER BY row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")

cte("comp_items", ["comp_filled"], f"""
SELECT *, datediff('day', venc_comp, {AS_OF}) AS dias_vencido_item,
       coalesce(datediff('day', venc_comp, {AS_OF}), 0) > 0 AS esta_vencido
FROM (
  SELECT file, sheet, row_idx, {sql_title('cliente_raw')} AS cliente, {sql_key(sql_title('cliente_raw'))} AS cliente_norm,
         CASE WHEN has_centro THEN trim(centro_raw) ELSE 'Sin centro' END AS centro_costo,
         {sql_amount('saldo_raw')} AS saldo_abierto, {sql_dmy('venc_raw')} AS venc_comp,
         CASE WHEN has_doc THEN trim(doc_raw) ELSE '' END AS documento_ref
  FROM comp_filled)
WHERE cliente_norm <> '' AND saldo_abierto > 0
""")

cte("comp_centers", ["comp_items"], """
SELECT cliente,
       max(CASE WHEN rk = 1 THEN centro_costo END) AS centro_costo_principal,
       coalesce(string_agg(centro_costo, ' | ' ORDER BY saldo DESC, centro_costo ASC) FILTER (WHERE trim(centro_costo) <> ''), '') AS centros_costo
FROM (SELECT cliente, centro_costo, saldo,
             row_number() OVER (PARTITION BY cliente ORDER BY saldo DESC, centro_costo ASC) AS rk
      FROM (SELECT cliente, centro_costo, sum(saldo_abierto) AS saldo FROM comp_items
            WHERE centro_costo IS NOT NULL GROUP BY cliente, centro_costo))
GROUP BY cliente
""")

cte("comp_sum", ["comp_items", "comp_centers"], f"""
SELECT t.cliente, t.saldo_composicion, coalesce(v.vencido, 0) AS saldo_vencido_comp,
       greatest(t.saldo_composicion - coalesce(v.vencido, 0), 0) AS saldo_por_vencer_comp,
       CAST({sql_div_half_even('v.peso', 'v.vencido', 0, in_scale=6)} AS BIGINT) AS dias_vencido_comp,
       v.dmax AS dias_vencido_max_comp, v.vmin AS venc_comp_min,
       c.centro_costo_principal, c.centros_costo
FROM (SELECT cliente, sum(saldo_abierto) AS saldo_composicion FROM comp_items GROUP BY cliente) t
LEFT JOIN (SELECT cliente, sum(saldo_abierto) AS vencido, sum(saldo_abierto * dias_vencido_item) AS peso,
                  max(dias_vencido_item) AS dmax, min(venc_comp) AS vmin
           FROM comp_items WHERE esta_vencido GROUP BY cliente) v ON t.cliente = v.cliente
LEFT JOIN comp_centers c ON t.cliente = c.cliente
""")

cte("bal_comp", ["bal", "comp_sum"], f"""
SELECT b.cliente, b.saldo_actual, b.saldo_inicial, b.debe_total, b.haber_total, b.saldo_reconstruido, b.saldo_final_ledger,
       b.dif_conciliacion, b.conciliado, b.saldo_pendiente_cc,
       CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN coalesce(c.saldo_vencido_comp, 0) ELSE b.saldo_vencido END AS saldo_vencido,
       CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN coalesce(c.saldo_por_vencer_comp, 0) ELSE b.saldo_por_vencer END AS saldo_por_vencer,
       CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN coalesce(c.venc_comp_min, b.venc) ELSE b.venc END AS venc,
       b.prox_vencimiento,
       CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN coalesce(c.dias_vencido_comp, 0) ELSE b.dias_vencido END AS dias_vencido,
       CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN coalesce(c.dias_vencido_max_comp, 0) ELSE b.dias_vencido_max END AS dias_vencido_max,
       b.venc_referencia,
       CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN 'composicion' ELSE 'cc_movimientos' END AS fuente_aging,
       {sql_aging("CASE WHEN coalesce(c.saldo_composicion, 0) > 0 THEN coalesce(c.dias_vencido_comp, 0) ELSE b.dias_vencido END")} AS aging,
       b.total_facturado, b.total_cobrado, b.ratio_cobranza,
       c.saldo_composicion, c.saldo_vencido_comp, c.saldo_por_vencer_comp, c.dias_vencido_comp, c.dias_vencido_max_comp,
       c.venc_comp_min, c.centro_costo_principal, c.centros_costo
FROM bal b LEFT JOIN comp_sum c ON b.cliente = c.cliente
""")

# What the debt views add up: the composition balance where it is positive, else the ledger's.
cte("dbase", ["bal_comp"], f"""
SELECT cliente, deuda AS saldo_actual, vencido AS saldo_vencido, por_vencer AS saldo_por_vencer, dias AS dias_vencido, dias_max AS dias_vencido_max,
       {sql_aging('dias')} AS aging, fuente, ratio_cobranza
FROM (SELECT cliente, ratio_cobranza,
        CASE WHEN coalesce(saldo_composicion, 0) > 0 THEN CAST(saldo_composicion AS DECIMAL(24,6)) ELSE saldo_actual END AS deuda,
        CASE WHEN coalesce(saldo_composicion, 0) > 0 THEN CAST(coalesce(saldo_vencido_comp, 0) AS DECIMAL(24,6)) ELSE saldo_vencido END AS vencido,
        CASE WHEN coalesce(saldo_composicion, 0) > 0 THEN CAST(coalesce(saldo_por_vencer_comp, 0) AS DECIMAL(24,6)) ELSE saldo_por_vencer END AS por_vencer,
        CASE WHEN coalesce(saldo_composicion, 0) > 0 THEN coalesce(dias_vencido_comp, 0) ELSE dias_vencido END AS dias,
        CASE WHEN coalesce(saldo_composicion, 0) > 0 THEN coalesce(dias_vencido_max_comp, 0) ELSE dias_vencido_max END AS dias_max,
        CASE WHEN coalesce(saldo_composicion, 0) > 0 THEN 'composicion' ELSE 'cc_movimientos' END AS fuente
      FROM bal_comp)
""")

oracle("debt_base", ["dbase"], """
SELECT cliente, CAST(saldo_actual AS DOUBLE) AS saldo_deuda, CAST(saldo_vencido AS DOUBLE) AS saldo_vencido_base,
       CAST(saldo_por_vencer AS DOUBLE) AS saldo_por_vencer_base, CAST(dias_vencido AS BIGINT) AS dias_vencido_base,
       CAST(dias_vencido_max AS BIGINT) AS dias_vencido_max_base, aging AS aging_base, fuente AS fuente_cc_base
FROM dbase
""")

oracle("aging_source_count", ["dbase"], """
SELECT fuente AS fuente_cc_base, count(*) AS clientes, CAST(sum(saldo_actual) AS DOUBLE) AS saldo FROM dbase GROUP BY fuente
""")

oracle("comp_header_detect", ["comp_hdr"], """
SELECT file, sheet, CAST(header_row AS BIGINT) AS header_row, col_cliente, col_centro, col_saldo, col_venc, col_doc FROM comp_hdr
""")

oracle("comp_ffill", ["comp_filled"], """
SELECT file, sheet, CAST(row_idx AS BIGINT) AS row_idx, cliente_raw AS cliente, centro_raw AS centro_costo FROM comp_filled
""")

oracle("parse_local_amount", ["comp_rows"], f"""
SELECT file, sheet, CAST(row_idx AS BIGINT) AS row_idx, CAST({sql_amount('saldo_raw')} AS DOUBLE) AS monto FROM comp_rows
""")

oracle("comp_items", ["comp_items"], """
SELECT sheet, CAST(row_idx AS BIGINT) AS row_idx, cliente, cliente_norm, centro_costo, CAST(saldo_abierto AS DOUBLE) AS saldo_abierto,
       venc_comp, documento_ref, dias_vencido_item, esta_vencido
FROM comp_items
""")

oracle("export_grid", ["comp_raw"], "SELECT file, sheet, CAST(row_idx AS BIGINT) AS row_idx, c0, c1, c2, c3, c4 FROM comp_raw")

oracle("export_items", ["comp_items"], """
SELECT sheet, CAST(row_idx AS BIGINT) AS row_idx, cliente, cliente_norm, centro_costo, CAST(saldo_abierto AS DOUBLE) AS saldo_abierto,
       venc_comp, documento_ref, dias_vencido_item, esta_vencido
FROM comp_items WHERE lower(sheet) = 'hoja1'
""")

oracle("comp_centers", ["comp_centers"], "SELECT cliente, centro_costo_principal, centros_costo FROM comp_centers")

oracle("comp_by_center", ["comp_items"], """
SELECT centro_costo, CAST(sum(saldo_abierto) AS DOUBLE) AS saldo_abierto FROM comp_items GROUP BY centro_costo
""")

oracle("comp_summary", ["comp_sum"], """
SELECT cliente, CAST(saldo_composicion AS DOUBLE) AS saldo_composicion, CAST(saldo_vencido_comp AS DOUBLE) AS saldo_vencido_comp,
       CAST(saldo_por_vencer_comp AS DOUBLE) AS saldo_por_vencer_comp, dias_vencido_comp,
       CAST(dias_vencido_max_comp AS BIGINT) AS dias_vencido_max_comp, venc_comp_min, centro_costo_principal, centros_costo
FROM comp_sum
""")

oracle("client_balances_comp", ["bal_comp"], _BAL_OUT + """,
       CAST(saldo_composicion AS DOUBLE) AS saldo_composicion, CAST(saldo_vencido_comp AS DOUBLE) AS saldo_vencido_comp,
       CAST(saldo_por_vencer_comp AS DOUBLE) AS saldo_por_vencer_comp, dias_vencido_comp,
       CAST(dias_vencido_max_comp AS BIGINT) AS dias_vencido_max_comp, venc_comp_min, centro_costo_principal, centros_costo
FROM bal_comp""")

oracle("open_items_center", ["lifo", "comp_sum"], f"""
SELECT l.cliente, {sql_key('l.cliente')} AS cliente_norm, l.documento AS documento_ref, l.venc AS venc_comp,
       CAST(l.tramo AS DOUBLE) AS saldo_abierto, coalesce(datediff('day', l.venc, {AS_OF}), 0) AS dias_vencido_item,
       coalesce(c.centro_costo_principal, 'Sin centro') AS centro_costo
FROM lifo l LEFT JOIN comp_sum c ON l.cliente = c.cliente
""")


# --- M5: scope, permissions, options ---------------------------------------------------
oracle("date_window", ["inv"], """
WITH r AS (SELECT min(fecha) AS dmin, max(fecha) AS dmax FROM inv),
     b AS (SELECT greatest(dmin, make_date(year(dmax), 1, 1)) AS desde, dmax AS hasta FROM r)
SELECT b.desde, b.hasta, count(i.fecha) AS filas, CAST(coalesce(sum(i.monto_total_ars), 0) AS DOUBLE) AS total
FROM b LEFT JOIN inv i ON i.fecha BETWEEN b.desde AND b.hasta
GROUP BY b.desde, b.hasta
""")

_CLIENTS_SQL = "('Customer#000000002 S.A.U.', 'Customer#000000004 S.A.U.', 'Customer#000000007 S.A.U.')"

oracle("filter_clients_in", ["inv_s"], f"""
SELECT cliente, count(*) AS filas, CAST(sum(monto_total_ars) AS DOUBLE) AS monto
FROM inv_s WHERE cliente IN {_CLIENTS_SQL} GROUP BY cliente
""")

oracle("filter_clients_out", ["inv_s"], f"""
SELECT cliente, count(*) AS filas, CAST(sum(monto_total_ars) AS DOUBLE) AS monto
FROM inv_s WHERE cliente IS NULL OR cliente NOT IN {_CLIENTS_SQL} GROUP BY cliente
""")

oracle("filter_centers", ["inv_s"], """
SELECT linea_negocio AS linea, count(*) AS filas, CAST(sum(monto_total_ars) AS DOUBLE) AS monto
FROM inv_s WHERE trim(linea_negocio) IN ('ECONOMY', 'PROMO') GROUP BY linea_negocio
""")

oracle("row_permissions", ["inv_s"], """
WITH perm(usuario, is_super, cli, cli_inc, ctr, ctr_inc) AS (VALUES
  ('admin', true, NULL, NULL, NULL, NULL),
  ('u_excl', false, ['Customer#000000002 S.A.U.'], false, ['ECONOMY'], true),
  ('u_incl', false, ['Customer#000000004 S.A.U.'], true, NULL, NULL),
  ('u_none', false, ['No Existe'], true, NULL, NULL))
SELECT p.usuario, count(i.numero_comprobante) AS filas, CAST(coalesce(sum(i.monto_total_ars), 0) AS DOUBLE) AS monto
FROM perm p LEFT JOIN inv_s i ON (
  p.is_super OR (
    (p.cli IS NULL OR (CASE WHEN p.cli_inc THEN list_contains(p.cli, i.cliente) ELSE NOT list_contains(p.cli, i.cliente) END))
    AND (p.ctr IS NULL OR (CASE WHEN p.ctr_inc THEN list_contains(p.ctr, trim(i.linea_negocio)) ELSE NOT list_contains(p.ctr, trim(i.linea_negocio)) END))))
GROUP BY p.usuario
""")

oracle("policy_totals", ["inv"], """
WITH cube AS (SELECT cliente, trim(linea_negocio) AS linea, count(*) AS n, sum(monto_total_ars) AS m FROM inv GROUP BY ALL),
u AS (SELECT o_orderkey AS k, upper(c_name[1]) || lower(c_name[2:]) || ' S.A.U.' AS cli FROM orders JOIN customer ON o_custkey = c_custkey),
ct AS (SELECT DISTINCT l_orderkey AS k, p_type AS linea FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 3 <> 0),
t AS (SELECT sum(n) AS n, sum(m) AS m FROM cube),
mine AS (SELECT u.k, cube.linea, cube.n, cube.m, ct.k IS NOT NULL AS listed
         FROM u JOIN cube ON cube.cliente = u.cli LEFT JOIN ct ON ct.k = u.k AND ct.linea = cube.linea),
c AS (SELECT k, sum(n) AS c_n, sum(m) AS c_m, coalesce(sum(n) FILTER (listed), 0) AS cl_n, coalesce(sum(m) FILTER (listed), 0) AS cl_m FROM mine GROUP BY k),
l AS (SELECT ct.k, sum(x.n) AS l_n, sum(x.m) AS l_m FROM ct JOIN (SELECT linea, sum(n) AS n, sum(m) AS m FROM cube GROUP BY linea) x USING (linea) GROUP BY ct.k),
j AS (SELECT u.k, u.k % 2 = 0 AS c_in, u.k % 5 < 2 AS l_in, u.k IN (SELECT k FROM ct) AS has_l, t.n AS t_n, t.m AS t_m,
             coalesce(c_n, 0) AS c_n, coalesce(c_m, 0) AS c_m, coalesce(cl_n, 0) AS cl_n, coalesce(cl_m, 0) AS cl_m, coalesce(l_n, 0) AS l_n, coalesce(l_m, 0) AS l_m
      FROM u CROSS JOIN t LEFT JOIN c USING (k) LEFT JOIN l USING (k))
SELECT 'u' || k AS usuario,
       CAST(CASE WHEN NOT has_l THEN CASE WHEN c_in THEN c_n ELSE t_n - c_n END WHEN c_in AND l_in THEN cl_n WHEN c_in THEN c_n - cl_n
            WHEN l_in THEN l_n - cl_n ELSE t_n - c_n - l_n + cl_n END AS BIGINT) AS filas,
       CAST(CASE WHEN NOT has_l THEN CASE WHEN c_in THEN c_m ELSE t_m - c_m END WHEN c_in AND l_in THEN cl_m WHEN c_in THEN c_m - cl_m
            WHEN l_in THEN l_m - cl_m ELSE t_m - c_m - l_m + cl_m END AS DOUBLE) AS monto
FROM j
""")

oracle("landing_merge", ["inv_raw"], """
WITH r AS (SELECT *, right(fecha, 1) IN ('1', '3', '5', '7', '9') AS odd FROM inv_raw)
SELECT CASE WHEN odd THEN 'impar' ELSE 'par' END AS carpeta, right(fecha, 7) AS periodo, CASE WHEN odd THEN condicion_pago ELSE 'SIN DATO' END AS condicion_pago,
       count(comprobante) AS filas, CAST(sum(TRY_CAST(cantidad AS DECIMAL(14,4))) AS DOUBLE) AS cantidad,
       CAST(sum(CASE WHEN odd THEN TRY_CAST(iva AS DECIMAL(18,2)) ELSE 0 END) AS DOUBLE) AS iva
FROM r GROUP BY ALL
""")

oracle("center_semi_filter", ["inv_s", "comp_items", "bal"], """
SELECT cliente, CAST(saldo_actual AS DOUBLE) AS saldo_actual FROM bal
WHERE cliente IN (SELECT cliente FROM inv_s WHERE trim(linea_negocio) IN ('ECONOMY', '1-URGENT')
                  UNION SELECT cliente FROM comp_items WHERE trim(centro_costo) IN ('ECONOMY', '1-URGENT'))
""")

# Selection of the fixtures: three customers left out, then two centres; customers of a centre through invoices or items.
cte("sel_inv", ["inv_s"], f"""
SELECT * FROM inv_s WHERE (cliente IS NULL OR cliente NOT IN {_CLIENTS_SQL}) AND trim(linea_negocio) IN ('ECONOMY', '1-URGENT')
""")
cte("sel_items", ["comp_items"], f"""
SELECT * FROM comp_items WHERE cliente NOT IN {_CLIENTS_SQL} AND trim(centro_costo) IN ('ECONOMY', '1-URGENT')
""")
cte("sel_clients", ["sel_inv", "sel_items"], """
SELECT cliente FROM sel_inv WHERE cliente IS NOT NULL UNION SELECT cliente FROM sel_items
""")

oracle("scope_balances", ["sel_clients", "bal_comp"], f"""
SELECT cliente, CAST(saldo_actual AS DOUBLE) AS saldo_actual, CAST(saldo_vencido AS DOUBLE) AS saldo_vencido FROM bal_comp
WHERE cliente NOT IN {_CLIENTS_SQL} AND cliente IN (SELECT cliente FROM sel_clients)
""")

oracle("scope_movements", ["sel_clients", "led"], f"""
SELECT tipo, count(*) AS movimientos, CAST(sum(debe) AS DOUBLE) AS debe, CAST(sum(haber) AS DOUBLE) AS haber FROM led
WHERE cliente NOT IN {_CLIENTS_SQL} AND cliente IN (SELECT cliente FROM sel_clients) GROUP BY tipo
""")

oracle("scope_items", ["sel_items"], """
SELECT cliente, centro_costo, count(*) AS items, CAST(sum(saldo_abierto) AS DOUBLE) AS saldo FROM sel_items GROUP BY cliente, centro_costo
""")

oracle("permission_rows_visible", ["inv_s"], """
SELECT numero_comprobante, cliente, linea_negocio, CAST(monto_total_ars AS DOUBLE) AS monto FROM inv_s
WHERE (cliente IS NULL OR cliente <> 'Customer#000000002 S.A.U.') AND trim(linea_negocio) = 'ECONOMY'
""")

oracle("center_impact", ["inv"], """
SELECT trim(linea_negocio) AS centro, count(DISTINCT cliente) AS clientes FROM inv WHERE cliente IS NOT NULL GROUP BY 1
""")

oracle("center_impact_window", ["inv_s"], """
SELECT CAST(grouping(centro) AS BIGINT) AS es_total, centro, count(DISTINCT cliente) AS clientes
FROM (SELECT trim(linea_negocio) AS centro, cliente FROM inv_s WHERE cliente IS NOT NULL) GROUP BY GROUPING SETS ((centro), ())
""")

# The share comes from a join with the parent's row here.
oracle("billing_levels", ["inv"], """
WITH g AS (SELECT razon_social, linea_negocio, anio, mes, grouping(razon_social, linea_negocio, anio, mes) AS nivel,
                  count(*) AS filas, coalesce(sum(monto_total_ars), 0) AS ars, coalesce(sum(monto_usd), 0) AS usd
           FROM inv GROUP BY GROUPING SETS ((razon_social, linea_negocio, anio, mes), (razon_social, linea_negocio, anio),
                (razon_social, linea_negocio), (razon_social), (anio, mes), (anio), ())),
n(nivel, nombre_nivel, padre) AS (VALUES (0, 'MES', 1), (1, 'ANIO', 3), (3, 'LINEA', 7), (7, 'EMPRESA', 15),
                (12, 'PERIODO', 13), (13, 'EJERCICIO', 15), (15, 'TOTAL', 15))
SELECT g.razon_social, g.linea_negocio, CAST(g.anio AS BIGINT) AS anio, CAST(g.mes AS BIGINT) AS mes, CAST(g.nivel AS BIGINT) AS nivel, n.nombre_nivel,
       g.filas, CAST(g.ars AS DOUBLE) AS ars, CAST(g.usd AS DOUBLE) AS usd,
       CASE WHEN p.ars <> 0 THEN CAST(g.ars AS DOUBLE) / CAST(p.ars AS DOUBLE) END AS participacion
FROM g JOIN n ON n.nivel = g.nivel JOIN g p ON p.nivel = n.padre
     AND (p.nivel & 8 > 0 OR p.razon_social IS NOT DISTINCT FROM g.razon_social)
     AND (p.nivel & 4 > 0 OR p.linea_negocio IS NOT DISTINCT FROM g.linea_negocio)
     AND (p.nivel & 2 > 0 OR p.anio IS NOT DISTINCT FROM g.anio)
     AND (p.nivel & 1 > 0 OR p.mes IS NOT DISTINCT FROM g.mes)
""")

oracle("client_options", ["inv", "bal"], f"""
SELECT DISTINCT cliente FROM (SELECT {sql_title('cliente')} AS cliente FROM inv UNION ALL SELECT {sql_title('cliente')} FROM bal)
WHERE cliente IS NOT NULL AND cliente <> ''
""")

oracle("center_options", ["inv", "comp_items", "bal_comp"], """
SELECT DISTINCT centro FROM (SELECT trim(linea_negocio) AS centro FROM inv UNION ALL SELECT trim(centro_costo) FROM comp_items
                            UNION ALL SELECT trim(centro_costo_principal) FROM bal_comp)
WHERE centro IS NOT NULL AND centro <> ''
""")

# --- M1 / M6: views ----------------------------------------------------------------------
oracle("year_to_date", ["inv_d"], """
WITH m AS (SELECT razon_social, moneda_iso, linea_negocio, year(fecha) AS anio, month(fecha) AS mes, count(*) AS filas, sum(monto_total_ars) AS monto
           FROM inv_d GROUP BY ALL)
SELECT razon_social, moneda_iso, linea_negocio, anio, mes, filas, CAST(monto AS DOUBLE) AS monto,
       CAST(sum(filas) OVER y AS BIGINT) AS filas_anio, CAST(sum(monto) OVER y AS DOUBLE) AS monto_anio
FROM m WINDOW y AS (PARTITION BY razon_social, moneda_iso, linea_negocio, anio ORDER BY mes)
""")

oracle("billing_totals", ["inv_s"], """
SELECT CAST(coalesce(sum(monto_total_ars) FILTER (WHERE razon_social = 'Local'), 0) AS DOUBLE) AS total_local,
       CAST(coalesce(sum(monto_total_ars) FILTER (WHERE razon_social = 'Internacional'), 0) AS DOUBLE) AS total_intl,
       CAST(coalesce(sum(monto_usd), 0) AS DOUBLE) AS total_usd
FROM inv_s
""")

for _name, _where, _amt in [("monthly_local", "razon_social = 'Local' AND moneda_iso = 'ARS'", "monto_total_ars"),
                            ("monthly_intl", "razon_social = 'Internacional'", "monto_total_ars"),
                            ("monthly_usd", "true", "monto_usd")]:
    oracle(_name, ["inv_s"], f"""
SELECT anio, mes, mes_nombre, CAST(sum({_amt}) AS DOUBLE) AS monto FROM inv_s WHERE {_where} AND anio IS NOT NULL
GROUP BY anio, mes, mes_nombre
""")

oracle("period_line_share", ["inv_d"], f"""
WITH l AS (SELECT * FROM inv_d WHERE razon_social = 'Local'),
     y AS (SELECT count(DISTINCT anio) > 1 AS multi FROM l),
     g AS (SELECT CASE WHEN y.multi THEN CAST(anio AS VARCHAR) || '-' || lpad(CAST(mes AS VARCHAR), 2, '0') ELSE lpad(CAST(mes AS VARCHAR), 2, '0') END AS periodo,
                  CASE WHEN y.multi THEN mes_nombre || ' ''' || right(CAST(anio AS VARCHAR), 2) ELSE mes_nombre END AS etiqueta,
                  CASE WHEN trim(linea_negocio) = '' OR linea_negocio IS NULL THEN 'SIN LINEA' ELSE upper(trim(linea_negocio)) END AS linea,
                  sum(monto_total_ars) AS monto
           FROM l, y GROUP BY 1, 2, 3),
     t AS (SELECT periodo, sum(monto) AS total_periodo FROM g GROUP BY periodo)
SELECT g.periodo, g.etiqueta, g.linea, CAST(g.monto AS DOUBLE) AS monto, CAST(t.total_periodo AS DOUBLE) AS total_periodo,
       coalesce({sql_div_half_even('g.monto * 100', 't.total_periodo', 1)}, 0.0) AS pct
FROM g JOIN t ON g.periodo = t.periodo
""")

oracle("line_mix", ["inv_s"], """
SELECT CASE WHEN trim(linea_negocio) = '' OR linea_negocio IS NULL THEN 'SIN LINEA' ELSE upper(trim(linea_negocio)) END AS linea,
       CAST(sum(monto_total_ars) AS DOUBLE) AS monto
FROM inv_s WHERE moneda_iso = 'ARS' GROUP BY 1
""")

oracle("top_clients", ["inv_s"], """
SELECT cliente, CAST(sum(monto_total_ars) AS DOUBLE) AS monto FROM inv_s WHERE moneda_iso = 'ARS'
GROUP BY cliente ORDER BY sum(monto_total_ars) DESC, cliente LIMIT 10
""")

oracle("top_clients_line", ["inv_s"], """
WITH best AS (SELECT linea_negocio FROM inv_s WHERE moneda_iso = 'ARS' AND linea_negocio IS NOT NULL
              GROUP BY linea_negocio ORDER BY sum(monto_total_ars) DESC, linea_negocio LIMIT 1)
SELECT cliente, CAST(sum(monto_total_ars) AS DOUBLE) AS monto FROM inv_s
WHERE moneda_iso = 'ARS' AND linea_negocio = (SELECT linea_negocio FROM best)
GROUP BY cliente ORDER BY sum(monto_total_ars) DESC, cliente LIMIT 10
""")

oracle("title_case_names", ["inv_raw"], f"""
SELECT cliente_raw, {sql_title('cliente_raw')} AS cliente FROM (SELECT DISTINCT cliente AS cliente_raw FROM inv_raw)
""")

oracle("client_norm_key", ["inv_raw"], f"""
SELECT cliente_raw, {sql_key('cliente_raw')} AS cliente_norm FROM (SELECT DISTINCT cliente AS cliente_raw FROM inv_raw)
""")

oracle("aging_distribution", ["dbase"], f"""
SELECT aging, CAST({sql_aging_rank('aging')} AS BIGINT) AS orden, CAST(sum(saldo_actual) AS DOUBLE) AS saldo
FROM dbase GROUP BY aging
""")

oracle("billing_vs_debt", ["inv_s", "dbase"], """
WITH f AS (SELECT cliente, sum(monto_total_ars) AS facturado_ars FROM inv_s WHERE moneda_iso = 'ARS' AND cliente IS NOT NULL GROUP BY cliente)
SELECT coalesce(f.cliente, b.cliente) AS cliente, CAST(coalesce(f.facturado_ars, 0) AS DOUBLE) AS facturado_ars,
       CAST(coalesce(b.saldo_actual, 0) AS DOUBLE) AS deuda_ars, CAST(coalesce(b.saldo_vencido, 0) AS DOUBLE) AS saldo_vencido,
       coalesce(b.ratio_cobranza, 0.0) AS ratio_cobranza, coalesce(b.aging, 'Sin deuda') AS aging,
       CAST(coalesce(b.dias_vencido, 0) AS BIGINT) AS dias_vencido
FROM f FULL OUTER JOIN dbase b ON f.cliente = b.cliente
""")

cte("top10", ["dbase"], """
SELECT * FROM dbase ORDER BY saldo_actual DESC, saldo_vencido DESC, dias_vencido DESC, cliente LIMIT 10
""")

oracle("top_debtors", ["top10"], """
SELECT cliente, CAST(saldo_actual AS DOUBLE) AS saldo, CAST(saldo_vencido AS DOUBLE) AS vencido,
       CAST(dias_vencido AS BIGINT) AS dias_vencido, aging FROM top10
UNION ALL
SELECT 'TOTAL', CAST(sum(saldo_actual) AS DOUBLE), CAST(sum(saldo_vencido) AS DOUBLE), NULL, NULL FROM top10
""")

oracle("debt_totals", ["dbase"], f"""
WITH t AS (SELECT coalesce(sum(saldo_actual), 0) AS deuda_total, coalesce(sum(saldo_vencido), 0) AS deuda_vencida,
                  coalesce(sum(saldo_vencido) FILTER (WHERE aging = '+90 días'), 0) AS deuda_critica FROM dbase)
SELECT CAST(deuda_total AS DOUBLE) AS deuda_total, CAST(deuda_vencida AS DOUBLE) AS deuda_vencida,
       CAST(deuda_critica AS DOUBLE) AS deuda_critica, {sql_div_half_even('deuda_critica * 100', 'deuda_vencida', 2, in_scale=6)} AS pct_critica
FROM t
""")

oracle("open_items_drill", ["comp_items", "top10"], f"""
SELECT t.cliente, i.documento_ref, i.centro_costo, i.venc_comp AS venc, i.dias_vencido_item AS dias,
       {sql_aging('i.dias_vencido_item')} AS estado, CAST(i.saldo_abierto AS DOUBLE) AS saldo
FROM comp_items i JOIN top10 t ON i.cliente_norm = {sql_key('t.cliente')}
""")

oracle("open_items_drill_lifo", ["lifo", "top10"], f"""
SELECT t.cliente, l.documento AS documento_ref, 'Sin centro' AS centro_costo, l.venc,
       coalesce(datediff('day', l.venc, {AS_OF}), 0) AS dias,
       {sql_aging(f"coalesce(datediff('day', l.venc, {AS_OF}), 0)")} AS estado, CAST(l.tramo AS DOUBLE) AS saldo
FROM lifo l JOIN top10 t ON {sql_key('l.cliente')} = {sql_key('t.cliente')}
WHERE l.tramo > 0
""")

oracle("selection_totals", ["comp_items", "top10"], f"""
WITH i AS (SELECT sum(i.saldo_abierto) AS abierto, count(*) AS n FROM comp_items i JOIN top10 t ON i.cliente_norm = {sql_key('t.cliente')})
SELECT count(*) AS clientes, CAST(sum(saldo_actual) AS DOUBLE) AS saldo, CAST(sum(saldo_vencido) AS DOUBLE) AS vencido,
       CAST(max(dias_vencido) AS BIGINT) AS dias_vencido_max, any_value(i.n) AS items, CAST(any_value(i.abierto) AS DOUBLE) AS saldo_items
FROM top10, i
""")

cte("stmt_client", ["recon"], """
SELECT cliente FROM recon ORDER BY saldo_final_ledger DESC, cliente LIMIT 1
""")


def _fmt(x: str) -> str:
    return f"(CASE WHEN {x} = 0 THEN '' ELSE '$ ' || format('{{:,.0f}}', CAST({x} AS DOUBLE)) END)"


oracle("client_statement", ["led", "stmt_client"], f"""
SELECT orden_origen, fecha, documento, '' AS descripcion, fecha_vencimiento AS vencimiento, tipo,
       CAST(debe AS DOUBLE) AS debe, CAST(haber AS DOUBLE) AS haber, CAST(saldo AS DOUBLE) AS saldo,
       {_fmt('debe')} AS debe_fmt, {_fmt('haber')} AS haber_fmt, {_fmt('saldo')} AS saldo_fmt,
       strftime(fecha, '%d/%m/%Y') AS fecha_fmt
FROM led WHERE cliente = (SELECT cliente FROM stmt_client)
""")

oracle("client_statement_totals", ["led_ord", "stmt_client"], """
SELECT CAST(sum(debe) AS DOUBLE) AS debe_total, CAST(sum(haber) AS DOUBLE) AS haber_total,
       CAST(max(CASE WHEN rn_last = 1 THEN saldo END) AS DOUBLE) AS saldo_final
FROM led_ord WHERE cliente = (SELECT cliente FROM stmt_client)
""")

oracle("kpi_financial", ["inv_s", "dbase"], """
WITH b AS (SELECT CAST(coalesce(sum(saldo_actual), 0) AS DOUBLE) AS deuda, CAST(coalesce(sum(saldo_vencido), 0) AS DOUBLE) AS venc,
                  CAST(coalesce(sum(saldo_vencido) FILTER (WHERE dias_vencido <= 30), 0) AS DOUBLE) AS v30 FROM dbase),
     t5 AS (SELECT CAST(coalesce(sum(saldo_actual), 0) AS DOUBLE) AS top5 FROM (SELECT saldo_actual FROM dbase ORDER BY saldo_actual DESC LIMIT 5)),
     f AS (SELECT CAST(coalesce(sum(monto_total_ars), 0) AS DOUBLE) AS f90 FROM inv_s
           WHERE fecha >= (SELECT max(fecha) FROM inv_s) - INTERVAL 89 DAY)
SELECT CASE WHEN f90 / 90.0 > 0 THEN deuda / (f90 / 90.0) ELSE 0.0 END AS dso,
       CASE WHEN deuda > 0 THEN venc / deuda * 100.0 ELSE 0.0 END AS overdue_ratio,
       CASE WHEN deuda > 0 THEN top5 / deuda * 100.0 ELSE 0.0 END AS top5_concentracion,
       CASE WHEN venc > 0 THEN v30 / venc * 100.0 ELSE 0.0 END AS cobertura_30d,
       f90 AS facturacion_90d
FROM b, t5, f
""")

oracle("briefing", ["inv_s", "dbase"], """
SELECT 'facturacion' AS seccion, 'total' AS metrica, '' AS clave, CAST(sum(monto_total_ars) AS DOUBLE) AS valor FROM inv_s
UNION ALL SELECT 'facturacion', 'total_neto', '', CAST(sum(monto_neto_ars) AS DOUBLE) FROM inv_s
UNION ALL SELECT 'facturacion', 'cantidad_facturas', '', CAST(count(*) AS DOUBLE) FROM inv_s
UNION ALL SELECT 'facturacion', 'clientes_activos', '', CAST(count(DISTINCT cliente) AS DOUBLE) FROM inv_s
UNION ALL (SELECT 'facturacion', 'top_clientes', cliente, CAST(sum(monto_total_ars) AS DOUBLE) FROM inv_s WHERE cliente IS NOT NULL
           GROUP BY cliente ORDER BY sum(monto_total_ars) DESC, cliente LIMIT 5)
UNION ALL (SELECT 'facturacion', 'evolucion_mensual', CAST(anio AS VARCHAR) || '-' || lpad(CAST(mes AS VARCHAR), 2, '0'),
                  CAST(sum(monto_total_ars) AS DOUBLE) FROM inv_s WHERE anio IS NOT NULL
           GROUP BY anio, mes ORDER BY anio DESC, mes DESC LIMIT 12)
UNION ALL SELECT 'cuentas_corrientes', 'deuda_total', '', CAST(sum(saldo_actual) AS DOUBLE) FROM dbase
UNION ALL SELECT 'cuentas_corrientes', 'al_dia', '', CAST(coalesce(sum(saldo_actual) FILTER (WHERE aging = 'Al día'), 0) AS DOUBLE) FROM dbase
UNION ALL SELECT 'cuentas_corrientes', 'vencido', '', CAST(sum(saldo_actual) - coalesce(sum(saldo_actual) FILTER (WHERE aging = 'Al día'), 0) AS DOUBLE) FROM dbase
UNION ALL SELECT 'cuentas_corrientes', 'aging', aging, CAST(sum(saldo_actual) AS DOUBLE) FROM dbase GROUP BY aging
UNION ALL (SELECT 'cuentas_corrientes', 'top_deudores', cliente, CAST(sum(saldo_actual) AS DOUBLE) FROM dbase
           GROUP BY cliente ORDER BY sum(saldo_actual) DESC, cliente LIMIT 5)
UNION ALL (SELECT 'cuentas_corrientes', 'criticos', cliente, CAST(sum(saldo_actual) AS DOUBLE) FROM dbase WHERE dias_vencido > 60
           GROUP BY cliente ORDER BY sum(saldo_actual) DESC, cliente LIMIT 10)
""")

cte("rej", ["inv_raw"], " UNION ALL ".join(
    ["SELECT 'facturas' AS dataset, comprobante AS referencia, 'fecha' AS columna, fecha AS valor, 'fecha_no_leida' AS motivo "
     f"FROM inv_raw WHERE trim(fecha) <> '' AND {sql_dmy('fecha')} IS NULL"]
    + [f"SELECT 'facturas', comprobante, '{c}', {c}, CASE WHEN TRY_CAST({c} AS DOUBLE) IS NULL THEN 'importe_no_leido' ELSE 'importe_excede' END "
       f"FROM inv_raw WHERE trim({c}) <> '' AND TRY_CAST({c} AS DECIMAL(28,2)) IS NULL"
       for c in ("gravado", "no_gravado", "importe_principal", "imp_usd", "importe_pendiente", "iva", "cantidad")]))

oracle("rejects", ["rej"], "SELECT * FROM rej")

oracle("reject_summary", ["rej"], """
SELECT dataset, columna, motivo, count(*) AS valores, min(valor) AS ejemplo FROM rej GROUP BY dataset, columna, motivo
""")

oracle("quality_report", ["inv", "bal", "comp_items", "rej"], """
WITH fi AS (SELECT count(*) AS n, CAST(sum(monto_total_ars) AS DECIMAL(38,2)) AS total FROM inv),
     fb AS (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(saldo_vencido, 0) > coalesce(saldo_actual, 0) + 1e-6) AS over,
                   count(*) FILTER (WHERE coalesce(dias_vencido, 0) < 0) AS neg,
                   CAST(max(abs(coalesce(dif_conciliacion, 0))) AS DECIMAL(38,2)) AS maxdif FROM bal),
     fc AS (SELECT count(*) AS n, CAST(sum(saldo_abierto) AS DECIMAL(38,2)) AS total FROM comp_items),
     r AS (
       SELECT 'Q1_facturas_presentes' AS check_id, n > 0 AS passed, CAST(n AS VARCHAR) AS detail FROM fi
       UNION ALL SELECT 'Q2_facturas_columnas', true, '' FROM fi
       UNION ALL SELECT 'Q3_facturacion_positiva', coalesce(total > 0, false), CAST(total AS VARCHAR) FROM fi
       UNION ALL SELECT 'Q1_saldos_presentes', n > 0, CAST(n AS VARCHAR) FROM fb
       UNION ALL SELECT 'Q2_saldos_columnas', true, '' FROM fb
       UNION ALL SELECT 'Q4_vencido_menor_saldo', over = 0, CAST(over AS VARCHAR) FROM fb
       UNION ALL SELECT 'Q5_dias_no_negativos', neg = 0, CAST(neg AS VARCHAR) FROM fb
       UNION ALL SELECT 'Q6_conciliacion_tolerancia', coalesce(maxdif <= 1.0, true), CAST(maxdif AS VARCHAR) FROM fb
       UNION ALL SELECT 'Q2_composicion_columnas', true, '' FROM fc
       UNION ALL SELECT 'valores_no_leidos', count(*) FILTER (WHERE motivo = 'importe_excede') = 0, CAST(count(*) AS VARCHAR) FROM rej
       UNION ALL SELECT 'Q7_composicion_positiva', coalesce(total > 0, false), CAST(total AS VARCHAR) FROM fc)
SELECT * FROM r
UNION ALL SELECT 'Q8_estado_general', bool_and(passed), CAST(count(*) FILTER (WHERE NOT passed) AS VARCHAR) FROM r
""")

oracle("run_meta", ["inv"], """
SELECT 'filas' AS clave, CAST(count(*) AS VARCHAR) AS valor FROM inv
UNION ALL SELECT 'ultima_actualizacion', '2001-09-01'
""")

oracle("comp_flexible_check", ["comp_cells"], """
WITH k AS (SELECT file, sheet, row_idx, lower(regexp_replace(strip_accents(trim(cell)), '[^\\p{L}\\p{N}]', '', 'g')) AS k
           FROM comp_cells WHERE row_idx < 6 AND cell IS NOT NULL AND trim(cell) <> ''),
     r AS (SELECT file, sheet, row_idx,
                  bool_or(contains(k, 'cliente') OR contains(k, 'razonsocial') OR contains(k, 'razon') OR contains(k, 'social')) AS c,
                  bool_or(contains(k, 'saldoabierto') OR contains(k, 'saldo') OR contains(k, 'importependiente')
                          OR contains(k, 'pendiente') OR contains(k, 'deuda') OR contains(k, 'importe')) AS b
           FROM k GROUP BY file, sheet, row_idx),
     s AS (SELECT DISTINCT file, sheet FROM comp_cells)
SELECT s.file, s.sheet, coalesce(bool_or(r.c AND r.b), false) AS ok
FROM s LEFT JOIN r ON s.file = r.file AND s.sheet = r.sheet
GROUP BY s.file, s.sheet
""")
