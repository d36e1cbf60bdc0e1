"""Exact distinct customers of any date window (A17) from mergeable bitmaps.

Customers are numbered once; a centre's customers of a day or a month are the set bits of
bitmaps kept in words of 64 numbers each, a BIGINT a word. A window is the union of the
bitmaps of its whole months and of the days left over at its ends, so a count is exact,
needs no invoice and reads, per centre, at most 62 days beside the months. Unlike sums,
distinct counts cannot be differences of running totals; unions they can be.

Few customers buy from a centre on one day, so a bitmap of many numbers is nearly empty:
words without a customer are not kept, there are never more words than invoices, and
unions are hash aggregates over 8 bytes.

Both tables grow by append. New customers get numbers after the old ones, and bitmaps of
new invoices are united with those there, in any order and however often a batch comes.

Defined results: rows without a customer count nowhere; rows without a date are of level
``u`` and in no window, but in the counts over all rows; a null centre is one of its own;
repeated rows set a bit again; a window without customers has no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.functions.text import strip

#: Customers are numbered bucket by bucket of their hash, so no task sorts them all.
BUCKETS = 256
LEVELS = {"mes": "m", "dia": "d", "sin fecha": "u"}


def word(numero: str) -> Column:
    """The word of 64 numbers that ``numero`` is in."""
    return F.shiftright(numero, 6)


def word_bit(numero: str) -> Column:
    """A word with the bit of ``numero`` set."""
    return F.expr(f"shiftleft(1L, CAST({numero} & 63 AS INT))")


def client_numbers(clients: DataFrame, known: DataFrame | None = None, col: str = "cliente") -> DataFrame:
    """``(cliente, numero)`` of the distinct customers in ``clients``: numbers from 1 without
    gaps. Those in ``known`` keep theirs and come first; the rest follow them."""
    names = clients.select(F.col(col).alias("cliente")).filter(F.col("cliente").isNotNull()).distinct()
    first = F.lit(0).cast("long")
    if known is not None:
        names = names.join(known, "cliente", "left_anti")
        first = F.coalesce(known.agg(F.max("numero")).scalar(), first)
    names = names.withColumn("_b", F.pmod(F.xxhash64("cliente"), F.lit(BUCKETS)).cast("int"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # One row a bucket: the window over them has BUCKETS rows, whatever the number of customers.
    starts = names.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")).select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("cliente"))
    new = names.withColumn("_place", place).join(starts, "_b").select("cliente", (first + F.col("_start") + F.col("_place")).cast("long").alias("numero"))
    return new if known is None else known.select("cliente", "numero").unionByName(new)


def client_bitmaps(inv: DataFrame, numbers: DataFrame) -> DataFrame:
    """``(nivel, fecha, centro, tramo, mapa)``: which customers of word ``tramo`` a
    centre billed on a day (``d``), in a month (``m``, its first day) or undated (``u``)."""
    seen = inv.filter(F.col("cliente").isNotNull()).select(strip("linea_negocio").alias("centro"), "fecha", "cliente").distinct()
    bits = seen.join(numbers, "cliente").select("centro", "fecha", word("numero").alias("tramo"), word_bit("numero").alias("_bit"))

    def at(level: str, day) -> Column:
        return F.struct(F.lit(LEVELS[level]).alias("nivel"), day.cast("date").alias("fecha"))

    levels = F.when(F.col("fecha").isNull(), F.array(at("sin fecha", F.lit(None)))).otherwise(
        F.array(at("dia", F.col("fecha")), at("mes", F.trunc("fecha", "month"))))
    return (bits.select(F.explode(levels).alias("_at"), "centro", "tramo", "_bit").select("_at.*", "centro", "tramo", "_bit")
                .groupBy("nivel", "fecha", "centro", "tramo").agg(F.bit_or("_bit").alias("mapa")))


def append_bitmaps(have: DataFrame, more: DataFrame) -> DataFrame:
    """Bitmaps of both: a union, so a batch that comes twice changes nothing."""
    return have.unionByName(more).groupBy("nivel", "fecha", "centro", "tramo").agg(F.bit_or("mapa").alias("mapa"))


def in_window(lo: Column, hi: Column) -> Column:
    """Which bitmaps make up the window: whole months, and the days of broken ones."""
    def whole(first: Column) -> Column:
        return (first >= lo) & (F.last_day(first) <= hi)

    level, day = F.col("nivel"), F.col("fecha")
    return ((level == LEVELS["mes"]) & whole(day)) | ((level == LEVELS["dia"]) & day.between(lo, hi) & ~whole(F.trunc(day, "month")))


def distinct_clients(maps: DataFrame, lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """``(es_total, centro, clientes)``: distinct customers per centre and, in one row more,
    of all centres together, inside the window; without one, over all rows."""
    inside = F.col("nivel") != LEVELS["dia"] if lo is None or hi is None else in_window(lo, hi)
    united = maps.filter(inside).groupingSets([["centro", "tramo"], ["tramo"]], "centro", "tramo").agg(
        F.grouping("centro").cast("int").alias("es_total"), F.bit_count(F.bit_or("mapa")).alias("n"))
    return united.groupBy("es_total", "centro").agg(F.sum("n").alias("clientes"))


def center_impact(maps: DataFrame) -> DataFrame:
    """Distinct customers billed per centre, over all rows."""
    return distinct_clients(maps).filter("es_total = 0").select("centro", "clientes")
