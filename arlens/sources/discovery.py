"""Source discovery (S1 S4) and staleness (S13 a) from file metadata.

File listings come from Spark's ``binaryFile`` source with only the
metadata columns selected (``path``, ``modificationTime``), so file contents
are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arlens.functions.constants import COMPOSITION_FILE_NAMES, COMPOSITION_FILE_PATTERNS, LEDGER_FILE_NAME


def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``(path, name, modified)`` of the files directly under ``folder``."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "false").load(folder))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                     F.col("modificationTime").alias("modified"))


def _glob_to_regex(pattern: str) -> str:
    out = []
    for ch in pattern:
        out.append(".*" if ch == "*" else "." if ch == "?" else ("\\" + ch if ch in ".^$+()[]{}|\\" else ch))
    return "^" + "".join(out) + "$"


def composition_rank(name: Column) -> Column:
    """Discovery rank of a composition workbook name: exact names first (in
    order), then the glob patterns (in order); null when not a candidate or
    when it is the ledger workbook."""
    expr = None
    for i, n in enumerate(COMPOSITION_FILE_NAMES):
        expr = F.when(name == n, F.lit(i)) if expr is None else expr.when(name == n, F.lit(i))
    base = len(COMPOSITION_FILE_NAMES)
    for j, p in enumerate(COMPOSITION_FILE_PATTERNS):
        expr = expr.when(name.rlike(_glob_to_regex(p)) & (F.lower(name) != LEDGER_FILE_NAME), F.lit(base + j))
    return expr


def pick_composition_source(files: DataFrame) -> DataFrame:
    """The composition workbook to load: best rank, then name order (one row
    or none)."""
    ranked = files.withColumn("rank", composition_rank(F.col("name"))).filter(F.col("rank").isNotNull())
    return ranked.orderBy("rank", "name").limit(1).select("path", "name")


def pick_sheet(grid: DataFrame) -> DataFrame:
    """Rows of the sheet named ``hoja1`` (any case) of each file, else of the
    file's first sheet (``sheet_ordinal`` = 0)."""
    sheets = grid.select("file", "sheet", "sheet_ordinal").distinct()
    chosen = sheets.groupBy("file").agg(
        F.coalesce(F.min(F.when(F.lower("sheet") == "hoja1", F.col("sheet"))),
                   F.min_by("sheet", "sheet_ordinal")).alias("sheet"))
    return grid.join(chosen, ["file", "sheet"], "left_semi")


def staleness(raw: DataFrame, processed: DataFrame) -> DataFrame:
    """One row ``stale``: raw files exist and the newest is newer than the
    newest processed output, or no processed output exists. No raw file ->
    not stale."""
    r = raw.agg(F.max("modified").alias("raw_max"))
    p = processed.agg(F.max("modified").alias("out_max"))
    stale = (F.when(F.col("raw_max").isNull(), F.lit(False))
              .when(F.col("out_max").isNull(), F.lit(True))
              .otherwise(F.col("raw_max") > F.col("out_max")))
    return r.select("raw_max", p.select("out_max").scalar().alias("out_max")).select(
        stale.alias("stale"), "raw_max", "out_max")
