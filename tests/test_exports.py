"""Exports as files: the grid comes back cell by cell, and bad files are reported."""

import csv
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from arlens.sources import discovery, exports

CELL = st.none() | st.text(st.characters(codec="utf-8", exclude_categories=["Cs"]) | st.sampled_from('",;\n\r ñ'), max_size=8)


def line(cells, delimiter):
    return delimiter.join("" if c is None else '"' + c.replace('"', '""') + '"' for c in cells) + "\n"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(CELL, max_size=5).filter(lambda r: r != [None]), max_size=6), st.sampled_from(",;\t|"))
def test_quoted_rows_round_trip(rows, delimiter):
    text = "".join(line(r, delimiter) for r in rows)
    lines = text.split("\n")
    assert list(exports.parse_rows(iter([x + "\n" for x in lines[:-1]]), delimiter)) == rows


@pytest.mark.parametrize("text, rows", [
    ("a,b\r\n,\r\n\r\n", [["a", "b"], [None, None], []]), ('"",x\n', [["", "x"]]), ('a"b,c\n', [['a"b', "c"]]), ('"a""b"c,d', [['a"bc', "d"]]),
    ("a,b", [["a", "b"]]), ("a\rb,c\n", [["a\rb", "c"]]), ('"x\ny",z\n', [["x\ny", "z"]]), (" ,\n", [[" ", None]]), ("", [])])
def test_rows(text, rows):
    assert list(exports.parse_rows(iter(text.splitlines(keepends=True) if "\r" not in text else [x + "\n" for x in text.split("\n")[:-1]]), ",")) == rows


def test_quote_that_never_ends():
    with pytest.raises(csv.Error):
        list(exports.parse_rows(iter(['"a\n', "b\n"]), ","))


def put(folder, place, data):
    os.makedirs(f"{folder}/{place}")
    with open(f"{folder}/{place}/x.csv", "wb") as f:
        f.write(data)


def test_grid_written_and_read_back(spark, scratch):
    cells = [[None, "x"], ["a", "", None], ["ñ;\"q\"", None, None, "l1\nl2"], ["only"], ["", ""]]
    rows = [("w 1%", s, i, cells[(i * 7 + len(s)) % 5]) for s in ("Hoja1", "Otra/hoja") for i in range(2, 5003) if i % 11]
    df = spark.createDataFrame(rows, "file string, sheet string, row_idx int, cells array<string>").repartition(7)
    order = spark.createDataFrame([("w 1%", "Hoja1", 1), ("w 1%", "Otra/hoja", 0)], "file string, sheet string, sheet_ordinal int")
    exports.write_exports(df, f"{scratch}/e", order, ";", part_rows=1000)
    raw = exports.read_exports(spark, f"{scratch}/e", ";")
    assert raw.rdd.getNumPartitions() == 12                       # a partition a file
    back = exports.grid(raw)
    got = sorted((((r["file"], r["sheet"], r["row_idx"]), r["cells"]) for r in back.filter(F.size("cells") > 0).collect()), key=lambda x: x[0])
    assert [k for k, _ in got] == sorted(r[:3] for r in rows) and dict(got) == {r[:3]: r[3] for r in rows}
    assert back.filter(F.size("cells") == 0).count() == 2 * (5003 - len(rows) // 2)
    picked = discovery.pick_sheet(back)
    assert {r["sheet"] for r in picked.select("sheet").distinct().collect()} == {"Hoja1"}
    assert {r["sheet"] for r in discovery.pick_sheet(back.filter("sheet <> 'Hoja1'")).select("sheet").distinct().collect()} == {"Otra/hoja"}


def test_bad_files_give_a_status_row(spark, scratch):
    put(scratch, "file=a/orden=0/sheet=Hoja1/part=0", b"x,y\n1,2\n")
    put(scratch, "file=a/orden=1/sheet=B/part=0", b"x,y\n")
    put(scratch, "file=a/orden=1/sheet=B/part=1", "z\nEspaña\n".encode("latin-1"))
    put(scratch, "file=b/orden=0/sheet=C/part=0", b'ok,ok\nr,"never ends\n')
    put(scratch, "file=b/orden=1/sheet=Empty/part=0", b"")
    put(scratch, "file=b/orden=1/sheet=Empty/other", b"no part of the layout")
    raw = exports.read_exports(spark, scratch)
    bad = {(r["file"], r["sheet"], r["part"]): (r["rows_before"], r["reason"].split(":")[0]) for r in exports.failures(raw).collect()}
    assert set(bad) == {("a", "B", 1), ("b", "C", 0)}
    assert bad["a", "B", 1][1] == "UnicodeDecodeError" and bad["b", "C", 0] == (1, "Error")
    # The sheet with an unreadable part is left out whole; the others are there.
    assert sorted((r["sheet"], r["row_idx"], r["cells"]) for r in exports.grid(raw).collect()) == [("Hoja1", 0, ["x", "y"]), ("Hoja1", 1, ["1", "2"])]
    latin = exports.grid(exports.read_exports(spark, scratch, encoding="latin-1")).filter("sheet = 'B'").orderBy("row_idx").collect()
    assert [(r["row_idx"], r["cells"]) for r in latin] == [(0, ["x", "y"]), (1, ["z"]), (2, ["España"])]


def test_no_files(spark, scratch):
    assert exports.grid(exports.read_exports(spark, scratch)).count() == 0
