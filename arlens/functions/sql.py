"""The library's functions callable from SQL.

``register`` creates temporary SQL functions. Spark inlines their bodies into the query
that calls them, so they run like any other expression: no Python, pruning and pushdown
as usual. The scalars take columns; ``partidas_abiertas`` is a table function over the
views ``movimientos`` (a cleaned ledger) and ``saldos`` (customer, current balance), which
``register_views`` makes of any two frames.

Defined results are those of the column functions of the same meaning: null customer ->
empty key, blank document -> opening, null days -> null bucket, unreadable amount -> 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arlens.functions.constants import AGING_BUCKETS, COLLECTION_PREFIXES, MOV_CHARGE, MOV_COLLECTION, MOV_OPENING, NO_CENTER
from arlens.functions.text import accent_table, whitespace_chars

MOVEMENTS, BALANCES = "movimientos", "saldos"


def quoted(text: str) -> str:
    """``text`` as an SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _strip(x: str) -> str:
    return f"btrim({x}, {quoted(whitespace_chars())})"


def _client_key() -> str:
    plain = f"translate(nombre, {', '.join(quoted(s) for s in accent_table())})"
    words = rf"trim(regexp_replace(upper(regexp_replace({plain}, '[^A-Za-z0-9 ]+', ' ')), r'\s+', ' '))"
    return f"CASE WHEN nombre IS NULL OR lower({_strip('nombre')}) IN ('', 'nan', 'none') THEN '' ELSE {words} END"


def _movement_type() -> str:
    text = f"coalesce({_strip('documento')}, '')"
    prefix = f"upper({_strip(f'split({text}, {quoted(" - ")}, 2)[0]')})"
    collection = " OR ".join(f"startswith({prefix}, {quoted(p)})" for p in COLLECTION_PREFIXES)
    return (f"CASE WHEN {text} IN ('', {quoted(MOV_OPENING)}) THEN {quoted(MOV_OPENING)} "
            f"WHEN {collection} THEN {quoted(MOV_COLLECTION)} ELSE {quoted(MOV_CHARGE)} END")


def _aging_bucket() -> str:
    cases = " ".join(f"WHEN dias <= {upper} THEN {quoted(label)}" for upper, label in AGING_BUCKETS if upper is not None)
    return f"CASE WHEN dias IS NULL THEN NULL {cases} ELSE {quoted(AGING_BUCKETS[-1][1])} END"


def _local_amount() -> str:
    blank = f"texto IS NULL OR {_strip('texto')} IN ('', 'nan', 'None')"
    digits = rf"regexp_replace(CASE WHEN {blank} THEN '0' ELSE {_strip('texto')} END, r'[^0-9,.\-]', '')"
    plain = (f"CASE WHEN instr({digits}, ',') > 0 AND instr({digits}, '.') > 0 THEN replace(replace({digits}, '.', ''), ',', '.') "
             f"ELSE replace({digits}, ',', '.') END")
    return f"coalesce(try_cast({plain} AS DECIMAL(24,6)), CAST(0 AS DECIMAL(24,6)))"


#: name, parameters, result and body of each scalar function
SCALARS = [
    ("clave_cliente", "nombre STRING", "STRING", _client_key),
    ("tipo_movimiento", "documento STRING", "STRING", _movement_type),
    ("dias_vencido", "corte DATE, vence DATE", "INT", lambda: "datediff(corte, vence)"),
    ("tramo_antiguedad", "dias INT", "STRING", _aging_bucket),
    ("monto_local", "texto STRING", "DECIMAL(24,6)", _local_amount),
]

#: Months of charges are added up first; only those that newer ones have not used up meet the charges.
OPEN_ITEMS = f"""
WITH cargos AS (
  SELECT cliente, documento, fecha, fecha_vencimiento, orden_origen, debe, trunc(fecha_vencimiento, 'MM') AS mes
  FROM {MOVEMENTS} WHERE tipo = {quoted(MOV_CHARGE)} AND cliente IS NOT NULL AND cliente <> '' AND debe > 0),
meses AS (SELECT cliente, mes, sum(debe) AS total FROM cargos GROUP BY cliente, mes),
previos AS (
  SELECT cliente, mes, coalesce(sum(total) OVER (PARTITION BY cliente ORDER BY mes DESC NULLS LAST
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previo FROM meses),
vivos AS (
  SELECT p.cliente, p.mes, p.previo, s.saldo_actual FROM previos p JOIN {BALANCES} s ON p.cliente = s.cliente
  WHERE s.saldo_actual > 0 AND p.previo < s.saldo_actual),
restos AS (
  SELECT c.*, v.saldo_actual - v.previo - coalesce(sum(c.debe) OVER (PARTITION BY c.cliente, c.mes
         ORDER BY c.fecha_vencimiento DESC NULLS LAST, c.fecha DESC NULLS LAST, c.orden_origen
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS resto
  FROM cargos c JOIN vivos v ON c.cliente = v.cliente AND c.mes <=> v.mes)
SELECT cliente, clave_cliente(cliente) AS cliente_norm, documento AS documento_ref, fecha_vencimiento AS venc_comp,
       CAST(least(debe, resto) AS DECIMAL(28,2)) AS saldo_abierto,
       coalesce(dias_vencido(corte, fecha_vencimiento), 0) AS dias_vencido_item, {quoted(NO_CENTER)} AS centro_costo
FROM restos WHERE resto > 0
"""
OPEN_ITEMS_TYPE = ("cliente STRING, cliente_norm STRING, documento_ref STRING, venc_comp DATE, saldo_abierto DECIMAL(28,2), "
                   "dias_vencido_item INT, centro_costo STRING")


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the scalar functions of the session; their names."""
    for name, params, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {result} RETURN {body()}")
    return [s[0] for s in SCALARS]


def register_views(movements: DataFrame, balances: DataFrame) -> str:
    """Name the two inputs of the table function and create it."""
    spark = movements.sparkSession
    register(spark)
    movements.createOrReplaceTempView(MOVEMENTS)
    balances.createOrReplaceTempView(BALANCES)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION partidas_abiertas(corte DATE) RETURNS TABLE ({OPEN_ITEMS_TYPE}) RETURN {OPEN_ITEMS}")
    return "partidas_abiertas"
