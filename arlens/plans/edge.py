"""Output edge of a product: exact decimals become DOUBLE, small ints BIGINT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DecimalType, IntegerType, ShortType


def to_edge(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Project ``columns`` (default: all) with money as DOUBLE and integers as
    BIGINT, the types the published products use."""
    fields = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for name in columns or df.columns:
        t = fields[name]
        if isinstance(t, DecimalType):
            out.append(F.col(name).cast("double").alias(name))
        elif isinstance(t, (IntegerType, ShortType, ByteType)):
            out.append(F.col(name).cast("bigint").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
