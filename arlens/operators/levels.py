"""Totals at every level of company, business line and period (U5 A12) in one aggregate.

Grouping sets over the daily rollup give the cells, the subtotals of each level and the
TOTAL row. A key that is null in the data and a key that is left out of a level both show
null, so each row says by ``nivel`` (the ``grouping_id``) and ``nombre_nivel`` which keys
it has; ``participacion`` is the share of its parent: the row with the last key left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.amounts import MONEY

KEYS = ["razon_social", "linea_negocio", "anio", "mes"]
#: Keys of each level, from the cells up to the TOTAL row.
LEVELS = {"MES": KEYS, "ANIO": KEYS[:3], "LINEA": KEYS[:2], "EMPRESA": KEYS[:1],
          "PERIODO": ["anio", "mes"], "EJERCICIO": ["anio"], "TOTAL": []}
PARENT = {"MES": "ANIO", "ANIO": "LINEA", "LINEA": "EMPRESA", "EMPRESA": "TOTAL", "PERIODO": "EJERCICIO", "EJERCICIO": "TOTAL"}


def level_id(keys: list[str]) -> int:
    """``grouping_id`` of a level: a bit, the first key's highest, for each key left out."""
    return sum(1 << (len(KEYS) - 1 - i) for i, k in enumerate(KEYS) if k not in keys)


def billing_levels(rollup: DataFrame) -> DataFrame:
    """``nivel``, ``nombre_nivel``, KEYS, rows, ARS and USD billed, share of the parent's ARS.

    The input is the daily rollup, so the sets expand days, not invoices. Undated rows have
    null periods, which are cells like any other. Without input there is no row, not even TOTAL."""
    name = F.create_map(*[F.lit(x) for n, keys in LEVELS.items() for x in (level_id(keys), n)])
    zero = F.lit(0).cast(MONEY)
    # Days become months first: the sets then expand months.
    months = rollup.groupBy(*KEYS).agg(F.sum("filas").alias("filas"), F.sum("ars").alias("ars"), F.sum("usd").alias("usd"))
    out = months.groupingSets(list(LEVELS.values()), *KEYS).agg(
        F.grouping_id(*KEYS).cast("int").alias("nivel"), F.coalesce(F.sum("filas"), F.lit(0)).cast("long").alias("filas"),
        F.coalesce(F.sum("ars"), zero).cast(MONEY).alias("ars"), F.coalesce(F.sum("usd"), zero).cast(MONEY).alias("usd"))
    return out.withColumn("nombre_nivel", name[F.col("nivel")])


def with_share(levels: DataFrame) -> DataFrame:
    """Add ``participacion``: the row's ARS over its parent's, null where that is 0.

    Siblings add up to their parent, so it is one window over the siblings and no join:
    they share the level and those keys that their parent has."""
    level = F.col("nivel")
    siblings = Window.partitionBy("nivel", *[
        F.when(level.isin([level_id(LEVELS[n]) for n, up in PARENT.items() if k in LEVELS[up]]), F.col(k)) for k in KEYS])
    whole = F.sum("ars").over(siblings)
    return levels.withColumn("participacion", F.when(whole != 0, F.col("ars").cast("double") / whole.cast("double")))
