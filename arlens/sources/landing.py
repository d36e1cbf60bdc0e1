"""Landing folders whose exports drift in their columns (P19 U1 S9).

Every year's folder may lack columns, have more of them or hold one under another type.
``merge_landings`` gives them one schema: the union of the columns, each in the narrowest
type that holds all of them, with a default where a folder lacks one. It is one plan: a
projection per folder below a union, so pruning and filters reach each folder's scan, and
the rows are not shuffled.

Types widen along integers, decimals and doubles, and from dates to timestamps; whatever
has no common type becomes text, which loses nothing. Names that differ only in case or
accents are one column, named as in the first folder that has it.

Defined results: a folder that holds a column as nulls only widens to any type; an empty
folder adds its columns and no rows; without a default a missing column is null; two
columns of one folder with the same key are an error, as is a call without folders.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Integer types and the digits they take.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_MOST_DIGITS = 38


def column_key(name: str) -> str:
    """What two spellings of a column share: letters and digits, no accents, lower case."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    return "_".join("".join(c if c.isalnum() else " " for c in plain).lower().split())


def _as_decimal(t: T.DataType) -> tuple[int, int] | None:
    """(digits before the point, digits after it) of an exact number type."""
    if isinstance(t, T.DecimalType):
        return t.precision - t.scale, t.scale
    digits = _DIGITS.get(type(t))
    return None if digits is None else (digits, 0)


def wider(a: T.DataType, b: T.DataType) -> T.DataType:
    """The narrowest type that holds every value of both; text if there is none."""
    if a == b:
        return a
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.NullType):
            return y
    if type(a) in _DIGITS and type(b) in _DIGITS:
        return a if _DIGITS[type(a)] >= _DIGITS[type(b)] else b
    da, db = _as_decimal(a), _as_decimal(b)
    if da and db:
        whole, scale = max(da[0], db[0]), max(da[1], db[1])
        return T.DecimalType(whole + scale, scale) if whole + scale <= _MOST_DIGITS else T.StringType()
    floats = (T.FloatType, T.DoubleType)
    if isinstance(a, floats) or isinstance(b, floats):
        # A double holds 15 digits of an exact number; beyond them text keeps the value.
        if all(isinstance(t, floats) or (_as_decimal(t) and sum(_as_decimal(t)) <= 15) for t in (a, b)):
            return T.DoubleType()
        return T.StringType()
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return T.TimestampType() if T.TimestampType() in (a, b) else T.TimestampNTZType()
    return T.StringType()


def merged_schema(schemas: Sequence[T.StructType]) -> T.StructType:
    """One schema for all: columns in the order in which they first occur."""
    if not schemas:
        raise ValueError("no landing folder was given")
    names: dict[str, str] = {}
    kinds: dict[str, T.DataType] = {}
    for schema in schemas:
        keys = [column_key(f.name) for f in schema]
        twice = sorted({k for k in keys if keys.count(k) > 1})
        if twice:
            raise ValueError(f"columns of one folder that are the same but for spelling: {', '.join(twice)}")
        for key, f in zip(keys, schema, strict=True):
            names.setdefault(key, f.name)
            kinds[key] = wider(kinds[key], f.dataType) if key in kinds else f.dataType
    return T.StructType([T.StructField(names[k], T.StringType() if isinstance(t, T.NullType) else t) for k, t in kinds.items()])


def conform(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` with the columns of ``schema``: its own ones widened, missing ones by default."""
    own = {column_key(f.name): f.name for f in df.schema}
    given = {column_key(k): v for k, v in (defaults or {}).items()}

    def value(field: T.StructField) -> Column:
        key = column_key(field.name)
        c = F.col(f"`{own[key]}`") if key in own else F.lit(given.get(key))
        return c.cast(field.dataType).alias(field.name)

    return df.select(*[value(f) for f in schema])


def merge_landings(frames: Mapping[str, DataFrame], defaults: Mapping[str, object] | None = None, origin: str | None = None) -> DataFrame:
    """The rows of all ``frames`` under their merged schema; with ``origin`` also a column of
    that name with the frame's key, such as the year of its folder."""
    schema = merged_schema([df.schema for df in frames.values()])
    out = None
    for name, df in frames.items():
        rows = conform(df, schema, defaults)
        rows = rows if origin is None else rows.withColumn(origin, F.lit(name))
        out = rows if out is None else out.unionAll(rows)
    return out


def schema_drift(frames: Mapping[str, DataFrame]) -> list[tuple[str, str, str, str | None, str]]:
    """``(frame, column, what, its type, merged type)`` of every column a frame lacks
    (``falta``) or holds in a narrower type (``tipo``). Reads schemas only."""
    schema = merged_schema([df.schema for df in frames.values()])
    out = []
    for name, df in frames.items():
        own = {column_key(f.name): f.dataType for f in df.schema}
        for f in schema:
            have = own.get(column_key(f.name))
            if have is None:
                out.append((name, f.name, "falta", None, f.dataType.simpleString()))
            elif have != f.dataType:
                out.append((name, f.name, "tipo", have.simpleString(), f.dataType.simpleString()))
    return out


def read_landings(spark: SparkSession, folders: Mapping[str, str], defaults: Mapping[str, object] | None = None, origin: str | None = None) -> DataFrame:
    """``merge_landings`` of Parquet folders, each read by its own schema."""
    return merge_landings({name: spark.read.parquet(path) for name, path in folders.items()}, defaults, origin)
