"""Money expressions.

Money is ``DECIMAL(28,2)`` inside every plan (exact sums, exact LIFO slices)
and is cast to ``DOUBLE`` only in the final projection of a product.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from arlens.functions.text import strip

MONEY = DecimalType(28, 2)
RATE = DecimalType(24, 10)
# Free-text amounts keep up to 6 decimals (``"1.234"`` is 1.234, not 1.23).
AMOUNT = DecimalType(24, 6)
WIDE = DecimalType(38, 0)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_money(c) -> Column:
    """Coerce to money; unparseable or null -> 0 (never raises under ANSI).
    ``operators.rejects`` keeps the values this turns into 0."""
    return F.coalesce(_col(c).try_cast(MONEY), F.lit(0).cast(MONEY))


def to_rate(c) -> Column:
    """Exchange rate with ten decimals; unparseable or null -> 0."""
    return F.coalesce(_col(c).try_cast(RATE), F.lit(0).cast(RATE))


def local_amount_text(c) -> Column:
    """The text of an amount with local separators as a plain number.

    Keep ``[0-9,.-]``; with both separators ``.`` is thousands and ``,``
    decimal; with only ``,`` it is the decimal mark; with only ``.`` it is the
    decimal mark. Blank, ``nan`` and ``None`` are 0.
    """
    txt = strip(c if isinstance(c, str) else c.cast("string"))
    txt = F.when(txt.isNull() | txt.isin("", "nan", "None"), F.lit("0")).otherwise(txt)
    txt = F.regexp_replace(txt, r"[^0-9,.\-]", "")
    has_comma = F.instr(txt, ",") > 0
    has_dot = F.instr(txt, ".") > 0
    return (F.when(has_comma & has_dot, F.replace(F.replace(txt, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(has_comma, F.replace(txt, F.lit(","), F.lit(".")))
            .otherwise(txt))


def parse_local_amount(c) -> Column:
    """Parse amounts written with local separators; anything unparseable -> 0."""
    return F.coalesce(local_amount_text(c).try_cast(AMOUNT), F.lit(0).cast(AMOUNT))


def clamp0(c) -> Column:
    return F.greatest(_col(c), F.lit(0))


def div_half_even(num, den, scale: int, in_scale: int = 2) -> Column:
    """Exact ``round_half_even(num / den, scale)`` for decimals with at most
    ``in_scale`` fractional digits. Null when ``den`` is 0 or null.

    Works on exact integers (no binary floating point, no 6-digit decimal
    quotient), so the result is the same in any engine that does integer
    arithmetic. Returned as DOUBLE.
    """
    n = (_col(num) * F.lit(10 ** (in_scale + scale))).cast(WIDE)
    d = (_col(den) * F.lit(10 ** in_scale)).cast(WIDE)
    sign = F.when((n < 0) != (d < 0), F.lit(-1)).otherwise(F.lit(1))
    an, ad = F.abs(n), F.abs(d)
    r = an % ad
    q = ((an - r) / ad).cast(WIDE)
    bump = (F.when(r * 2 > ad, F.lit(1))
            .when((r * 2 == ad) & (q % 2 == 1), F.lit(1))
            .otherwise(F.lit(0)))
    res = (q + bump) * sign
    return F.when(d == 0, F.lit(None).cast("double")).otherwise(res.cast("double") / F.lit(float(10 ** scale)))
