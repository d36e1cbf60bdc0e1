"""Date expressions: day-first parsing, month labels, days overdue, aging."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, StringType, TimestampNTZType, TimestampType

from arlens.functions.constants import AGING_BUCKETS
from arlens.functions.text import strip

# Day-first text layouts accepted, tried in order.
DAYFIRST_PATTERNS = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy", "d.M.yy", "yyyy-MM-dd", "yyyy/M/d",
                     "d/M/yyyy H:mm", "d/M/yyyy H:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss",
                     "yyyy-MM-dd'T'HH:mm:ss.SSS", "d/M/yyyy h:mm a", "d/M/yyyy h:mm:ss a", "d-MMM-yyyy", "d MMM yyyy", "d/MMM/yyyy", "d-MMM-yy"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_dayfirst(c, source_type: DataType | None = None, stripped: bool = False) -> Column:
    """Parse a day-first date; anything unparseable -> null (never raises). ``stripped``
    text has no blanks at its ends: the pattern list then holds no trim per pattern."""
    col = _col(c)
    if isinstance(source_type, (DateType,)):
        return col
    if isinstance(source_type, (TimestampType, TimestampNTZType)):
        return F.to_date(col)
    txt = col if stripped else strip(col.cast("string") if source_type is not None and not isinstance(source_type, StringType) else col)
    return F.to_date(F.coalesce(*[F.try_to_timestamp(txt, F.lit(p)) for p in DAYFIRST_PATTERNS]))


def month_label(c) -> Column:
    """``Jan 2024`` style label (English month abbreviations)."""
    return F.date_format(_col(c), "MMM yyyy")


def as_of_lit(as_of) -> Column:
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of).cast("date")


def days_overdue(as_of, due) -> Column:
    """Days from ``due`` to the as-of date (negative when not yet due)."""
    return F.datediff(as_of_lit(as_of), _col(due))


def aging_bucket(days) -> Column:
    """Aging bucket of a days-overdue value (<=0, 1-30, 31-60, 61-90, >90)."""
    d = _col(days)
    expr = None
    for upper, label in AGING_BUCKETS:
        if upper is None:
            expr = expr.otherwise(F.lit(label))
        elif expr is None:
            expr = F.when(d <= upper, F.lit(label))
        else:
            expr = expr.when(d <= upper, F.lit(label))
    return F.when(d.isNull(), F.lit(None).cast("string")).otherwise(expr)


def aging_rank(label) -> Column:
    """Display position (1..5) of an aging label."""
    lab = _col(label)
    expr = None
    for i, (_, name) in enumerate(AGING_BUCKETS, start=1):
        expr = F.when(lab == name, F.lit(i)) if expr is None else expr.when(lab == name, F.lit(i))
    return expr
