"""Ordered per-group computations that survive a hot group.

A plain ``Window.partitionBy(group).orderBy(...)`` puts every row of a group in
one task; if one customer (or one sheet) holds a third of the rows, that task
holds a third of the data. The helpers here split each group into *slices* that
come from the data (a month, a block of row numbers), so they need no sampling
pass and are the same on every evaluation:

1. ``slice_by`` must not fall along the order of the rows.
2. Per (group, slice) totals are partial aggregates; a window over these few
   rows gives each slice the carry from the slices before it.
3. The rows are shuffled once, by (group, slice); the window inside a slice and
   the join with the carry both use that partitioning.

Group columns must not be null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"


def _cols(cols) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def month_slice(date: str, latest_first: bool = False) -> Column:
    """Calendar month of ``date`` as a slice; a missing date is in the first
    slice, or in the last one if the latest month comes first."""
    month = F.year(date) * 12 + F.month(date)
    return F.coalesce(-month, F.lit(10_000_000)) if latest_first else F.coalesce(month, F.lit(-10_000_000))


def slice_carry(rows: DataFrame, group_cols: Sequence[str], value: str) -> DataFrame:
    """(group, slice, _carry): sum of ``value`` in the group's earlier slices."""
    parts = rows.groupBy(*group_cols, SLICE).agg(F.sum(value).alias("_part"))
    before = Window.partitionBy(*group_cols).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    return parts.select(*group_cols, SLICE, F.coalesce(F.sum("_part").over(before), F.lit(0)).alias("_carry"))


def running_sum(df: DataFrame, group_cols: Sequence[str], order: Sequence, value, out: str, slice_by: Column,
                exclusive: bool = False) -> DataFrame:
    """Add ``out`` = running sum of ``value`` within each group in ``order``.

    ``exclusive=True`` sums only the rows before the current one (0 for the
    first row). ``order`` must make rows unique inside a group.
    """
    rows = df.withColumn("_rs_value", value if isinstance(value, Column) else F.col(value)).withColumn(SLICE, slice_by)
    w = (Window.partitionBy(*group_cols, SLICE).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0))
    local = rows.withColumn("_local", F.coalesce(F.sum("_rs_value").over(w), F.lit(0)))
    carry = slice_carry(rows, group_cols, "_rs_value")
    total = F.col("_local") + F.col("_carry")
    return local.join(carry, [*group_cols, SLICE]).select(*df.columns, total.alias(out))


def row_number(df: DataFrame, group_cols: Sequence[str], order: Sequence, out: str, slice_by: Column) -> DataFrame:
    """1-based position of each row inside its group in ``order``."""
    res = running_sum(df, group_cols, order, F.lit(1).cast("long"), out, slice_by)
    return res.withColumn(out, F.col(out).cast("long"))


def forward_fill(df: DataFrame, group_cols: Sequence[str], order: Sequence, cols: Sequence[str],
                 slice_by: Column) -> DataFrame:
    """Replace nulls in ``cols`` by the last non-null value earlier in the group."""
    rows = df.withColumn(SLICE, slice_by)
    w = (Window.partitionBy(*group_cols, SLICE).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, 0))
    local = rows
    for c in cols:
        local = local.withColumn(c, F.last(c, ignorenulls=True).over(w))
    # Last non-null values of each slice, then of the slices before it: one carry for all columns.
    key = F.struct(*_cols(order))
    parts = rows.groupBy(*group_cols, SLICE).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), key)).alias(f"_last_{c}") for c in cols])
    before = Window.partitionBy(*group_cols).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select(*group_cols, SLICE, *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in cols])
    filled = local.join(carry, [*group_cols, SLICE])
    return filled.select(*[F.coalesce(c, f"_carry_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])
