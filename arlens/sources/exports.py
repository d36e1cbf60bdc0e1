"""Delimited exports as a cell grid: a Python data source with a partition per file.

A workbook is a folder ``file=<workbook>/orden=<n>/sheet=<name>/part=<k>`` of delimited
files; a long sheet is cut into parts. Rows come back as the grid
``(file, sheet, sheet_ordinal, row_idx, cells)``: the row's place in its whole sheet, and
its cells as they are, of any number. An unquoted empty field is null, a quoted one an
empty text, a blank line a row without cells. Quoted fields may hold line ends.

Each file is read by one task, line by line, and handed on in batches of rows. A
file that can't be read (not there any more, other encoding, a quote that never ends)
gives the rows before the fault, left out by :func:`grid`, and one status row, so a load can go on and
report it. Paths go through pyarrow's file systems: local and mounted folders, HDFS and
object stores that it knows.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from urllib.parse import unquote

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

FORMAT = "delimited_exports"
OK, UNREADABLE = "ok", "unreadable"
SCHEMA = StructType([
    StructField("file", StringType()), StructField("sheet", StringType()), StructField("sheet_ordinal", IntegerType()), StructField("part", IntegerType()),
    StructField("row_in_part", LongType()), StructField("cells", ArrayType(StringType())), StructField("status", StringType()), StructField("reason", StringType())])
LAYOUT = re.compile(r"file=([^/]*)/orden=(\d+)/sheet=([^/]*)/part=(\d+)/([^/_.][^/]*)$")
#: Rows of a part when a grid is written.
PART_ROWS = 250_000
BATCH_ROWS = 4096
#: Lines of a longer cell, in characters, are taken for a quote that never ends.
MAX_CELL = 1 << 27


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^[a-z0-9]+:", path) else (fs.LocalFileSystem(), path)


class ExportFile(InputPartition):
    """One file of an export and where it belongs."""

    def __init__(self, path: str, file: str, ordinal: int, sheet: str, part: int):
        self.path, self.file, self.ordinal, self.sheet, self.part = path, file, ordinal, sheet, part


def parse_rows(lines: Iterator[str], delimiter: str) -> Iterator[list[str | None]]:
    """Cells of each row of a delimited text. Python's reader can't tell an empty field
    from a quoted empty one in every version, so fields are told apart here; a quote that
    is open at the end is an error."""
    field: list[str] = []
    row: list[str | None] = []
    quoted = opened = seen = False
    size = 0
    plain = re.compile(f'[^"{re.escape(delimiter)}\r\n]+')
    for line in lines:
        at, end = 0, len(line)
        while at < end:
            c = line[at]
            if opened:
                stop = line.find('"', at)
                if stop < 0:
                    field.append(line[at:])
                    at = end
                elif line.startswith('""', stop):
                    field.append(line[at:stop + 1])
                    at = stop + 2
                else:
                    field.append(line[at:stop])
                    at, opened = stop + 1, False
            elif c == '"' and not field and not quoted:
                quoted = opened = seen = True
                at += 1
            elif c == delimiter:
                row.append("".join(field) if field or quoted else None)
                field, quoted, seen = [], False, True
                at += 1
            elif c == "\n" or line[at:] == "\r\n":
                at = end
            else:
                run = plain.match(line, at)
                field.append(run[0] if run else c)
                at, seen = at + len(run[0] if run else c), True
        size = size + end if opened else 0
        if size > MAX_CELL:
            raise csv.Error("a cell is too long, or its quote never ends")
        if not opened:
            yield row + ["".join(field) if field or quoted else None] if seen else []
            field, row, quoted, seen = [], [], False, False
    if opened:
        raise csv.Error("a quote never ends")


class ExportReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        self.delimiter = options.get("delimiter", ",")
        self.encoding = options.get("encoding", "utf-8")

    def partitions(self) -> list[ExportFile]:
        from pyarrow import fs

        system, root = _filesystem(self.root)
        found = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=True)):
            place = LAYOUT.search(info.path)
            if info.type == fs.FileType.File and place:
                file, ordinal, sheet, part, _ = place.groups()
                found.append(ExportFile(info.path, unquote(file), int(ordinal), unquote(sheet), int(part)))
        return sorted(found, key=lambda f: f.path)

    def read(self, partition: ExportFile | None) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition is None:       # Spark's stand-in where no file was found
            return
        where = [partition.file, partition.sheet, partition.ordinal, partition.part]
        schema = to_arrow_schema(SCHEMA)

        def batch(first: int, rows: list, status: str, reason: str | None):
            n = len(rows)
            columns = [[x] * n for x in where] + [list(range(first, first + n)), rows, [status] * n, [reason] * n]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        rows, done = [], 0
        try:
            system, _ = _filesystem(self.root)
            with system.open_input_stream(partition.path) as raw:
                for row in parse_rows(io.TextIOWrapper(io.BufferedReader(raw), self.encoding, newline="\n"), self.delimiter):
                    rows.append(row)
                    if len(rows) == BATCH_ROWS:
                        yield batch(done, rows, OK, None)
                        done, rows = done + len(rows), []
            fault = None
        except (OSError, UnicodeError, csv.Error) as e:
            fault = f"{type(e).__name__}: {e}"[:500]
        if rows:
            yield batch(done, rows, OK, None)
        if fault is not None:
            yield batch(done + len(rows), [None], UNREADABLE, fault)


class DelimitedExports(DataSource):
    """``spark.read.format("delimited_exports").option("delimiter", ";").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema) -> ExportReader:
        return ExportReader(dict(self.options))


def read_exports(spark: SparkSession, folder: str, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """All rows of the exports in ``folder``, status rows included."""
    import sys

    # Executors need not have this package: the class travels with the query.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        spark.dataSource.register(DelimitedExports)
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    return spark.read.format(FORMAT).option("delimiter", delimiter).option("encoding", encoding).load(folder)


def grid(rows: DataFrame) -> DataFrame:
    """The cell grid of the sheets that could be read whole: parts follow each other, so a
    row's ordinal is its place in its part after the rows of the parts before. A sheet
    with an unreadable part is left out; :func:`failures` reports it."""
    sheet = ["file", "sheet", "sheet_ordinal"]
    bad = F.max(F.when(F.col("status") != OK, 1).otherwise(0))
    # One row a part; the window runs over the parts of a sheet, not its rows.
    parts = rows.groupBy(*sheet, "part").agg(F.count(F.lit(1)).alias("_n"), bad.alias("_bad"))
    before = Window.partitionBy(*sheet).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*sheet, "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.max("_bad").over(Window.partitionBy(*sheet)).alias("_bad"))
    return (rows.join(parts.filter("_bad = 0"), [*sheet, "part"])
                .select(*sheet, (F.col("_before") + F.col("row_in_part")).cast("int").alias("row_idx"), "cells"))


def failures(rows: DataFrame) -> DataFrame:
    """Parts that could not be read, with the rows read before the fault and the reason."""
    return rows.filter(F.col("status") != OK).select("file", "sheet", "sheet_ordinal", "part", F.col("row_in_part").alias("rows_before"), "reason")


def write_exports(cells: DataFrame, folder: str, sheet_ordinals: DataFrame, delimiter: str = ",", part_rows: int = PART_ROWS) -> None:
    """Write a grid ``(file, sheet, row_idx, cells)`` as exports, a sheet's rows in parts
    of ``part_rows`` row numbers. Row numbers that a sheet lacks become blank lines, so
    ordinals are kept; so does a row of one null cell. ``sheet_ordinals`` has one row a
    sheet: (file, sheet, sheet_ordinal). Names of files and sheets may not be null or empty."""
    quoted = F.transform("cells", lambda x: F.coalesce(F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"')), F.lit("")))
    line = F.array_join(quoted, delimiter)
    key = ["file", "sheet"]
    part = F.floor(F.col("row_idx") / part_rows).cast("int")
    rows = cells.select(*key, part.alias("part"), "row_idx", line.alias("value"))
    last = rows.groupBy(*key).agg(F.max("row_idx").alias("last"))
    # Rows that are missing: of each part from its first possible number to its last.
    have = rows.groupBy(*key, "part").agg(F.count_distinct("row_idx").alias("n"))
    parts = last.select(*key, "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / part_rows).cast("int"))).alias("part"))
    lo = F.col("part") * part_rows
    hi = F.least(F.col("last"), lo + part_rows - 1)
    gappy = parts.join(have, [*key, "part"], "left").filter(F.coalesce("n", F.lit(0)) < hi - lo + 1)
    blank = gappy.select(*key, "part", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))).alias("row_idx")).join(
        rows.select(*key, "part", "row_idx"), [*key, "part", "row_idx"], "left_anti").withColumn("value", F.lit(""))
    out = rows.unionByName(blank).join(sheet_ordinals.withColumnRenamed("sheet_ordinal", "orden"), key)
    place = ["file", "orden", "sheet", "part"]
    # Columns that can't be null: else the writer puts a sort of its own after this one.
    out = out.select(*[F.coalesce(c, F.lit("-")).alias(c) for c in key], F.coalesce("orden", F.lit(0)).alias("orden"),
                     F.coalesce("part", F.lit(0)).alias("part"), "row_idx", "value")
    (out.repartition(*place).sortWithinPartitions(*place, "row_idx").select(*place, "value")
        .write.partitionBy(*place).text(folder))
