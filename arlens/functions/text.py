"""Text expressions: title case, match keys, header keys, line labels.

All are built-in Column expressions (JVM-side, inside whole-stage codegen);
no Python UDF is involved.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from arlens.functions.constants import NO_LINE


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(source, target) strings for ``translate`` that strip diacritics.

    Built by rule, not by hand: every code point in the Latin-1 Supplement,
    Latin Extended-A/B, Latin Extended Additional and the fullwidth ASCII
    block whose compatibility decomposition (NFKD) minus combining marks is a
    single ASCII character maps to that character; combining marks (a base
    letter followed by its accent) are deleted.
    """
    ranges = [(0x00A0, 0x024F), (0x1E00, 0x1EFF), (0xFF01, 0xFF5E)]
    src, dst = [], []
    for lo, hi in ranges:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
            if len(base) == 1 and ord(base) < 128 and base != ch:
                src.append(ch)
                dst.append(base)
    # Combining marks have no counterpart in the target, so ``translate`` removes them.
    marks = "".join(chr(cp) for cp in range(0x0300, 0x0370))
    return "".join(src) + marks, "".join(dst)


@lru_cache(maxsize=1)
def whitespace_chars() -> str:
    """Every character a Python ``str.strip()`` removes (built by rule)."""
    return "".join(chr(cp) for cp in range(0x110000) if chr(cp).isspace())


def strip(c) -> Column:
    """Remove leading/trailing whitespace of any kind (``trim`` only removes
    spaces). Null stays null.

    A column given by name that begins and ends with printable ASCII is returned as it
    is: ``btrim`` looks each end up in the list of blanks and costs several times that test."""
    if not isinstance(c, str):
        return F.btrim(c, F.lit(whitespace_chars()))
    txt = F.col(c).cast("string")
    return F.when(txt.between("!", "~") & F.substring(txt, -1, 1).between("!", "~"), txt).otherwise(F.btrim(txt, F.lit(whitespace_chars())))


def strip_accents(c) -> Column:
    src, dst = accent_table()
    return F.translate(_col(c), src, dst)


def title_case(c) -> Column:
    """Trim + title case where every letter that follows a non-letter is upper
    case and the rest lower case (``"payway s.a.u."`` -> ``"Payway S.A.U."``).

    ``initcap`` capitalises after spaces only, so a mark and a space go before
    each letter that is not preceded by a letter, and away again afterwards:
    one pattern and no array, inside generated code. Null stays null.
    """
    mark = "\u0001 "
    marked = F.regexp_replace(F.lower(strip(_col(c))), r"(?<!\p{L})(?=\p{L})", mark)
    return F.replace(F.initcap(marked), F.lit(mark), F.lit(""))


def client_key(c) -> Column:
    """Customer match key: no accents, non-alphanumerics -> space, upper case,
    single spaces, trimmed. Null, blank, ``nan`` and ``none`` give ``""``."""
    raw = _col(c)
    lowered = F.lower(strip(c))
    key = F.trim(F.regexp_replace(
        F.upper(F.regexp_replace(strip_accents(raw), r"[^A-Za-z0-9 ]+", " ")), r"\s+", " "))
    return (F.when(raw.isNull() | lowered.isin("", "nan", "none"), F.lit(""))
            .otherwise(key))


def header_key(c) -> Column:
    """Header key: no accents, runs of non-alphanumerics -> ``_``, outer ``_``
    removed, lower case (``"Razón Social"`` -> ``"razon_social"``)."""
    k = F.regexp_replace(strip_accents(_col(c)), r"[^a-zA-Z0-9]+", "_")
    return F.lower(F.regexp_replace(k, r"^_+|_+$", ""))


def header_key_alnum(c) -> Column:
    """Header key for the upload check: no accents, letters/digits only, lower."""
    return F.lower(F.regexp_replace(strip_accents(strip(c)), r"[^\p{L}\p{N}]", ""))


def line_label(c) -> Column:
    """Business-line label: trimmed upper case, blank -> ``SIN LINEA``."""
    t = strip(c)
    return F.when(t.isNull() | (t == ""), F.lit(NO_LINE)).otherwise(F.upper(t))
