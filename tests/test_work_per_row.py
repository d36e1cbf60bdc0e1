"""What a row costs: no shuffle to meet a selection, and text read once."""

import datetime as dt

from pyspark.sql import functions as F

from arlens.functions.text import strip, whitespace_chars
from arlens.operators import composition as comp
from arlens.operators.ledger import movement_type
from arlens.operators.scope import EXCLUDE, INCLUDE, in_list


def _plan(df, step):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_a_selection_shuffles_no_rows(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.concat(F.lit("c"), (F.col("id") % 10).cast("string"))).alias("cliente"), "id")
    for mode, want in ((INCLUDE, 200), (EXCLUDE, 800)):
        out = in_list(rows, "cliente", ["c1", "c2", "c2", "zz"], mode)
        assert "hashpartitioning" not in _plan(out, "executedPlan")
        assert out.count() == want          # rows without a name are not in the list


def _grid(spark):
    rows = [("f", "s", 0, ["Cliente", "Centro de Costo", "Saldo", "Vencimiento", "Comprobante"]),
            ("f", "s", 1, [None, "c0", "9", "01/02/2001", "d0"]),            # no customer yet
            ("f", "s", 2, ["  juan pérez ", " c1 ", "1.234,50", "01/02/2001", " d1 "]),
            ("f", "s", 3, [None, None, "10", "", "d2"]),
            ("f", "s", 4, ["", "", "-3", "01/02/2001", "d3"]),                # not positive
            ("f", "s", 5, ["   ", "c2", "7", "01/02/2001", "d4"]),            # blank, not empty: a customer without a key
            ("f", "s", 6, [None, None, "8", "01/02/2001", "d5"]),
            ("f", "s", 7, ["NaN", None, "8", "01/02/2001", "d6"]),
            ("f", "s", 8, ["ana", None, "$ 2,5", "2001-08-31"])]
    return spark.createDataFrame(rows, "file string, sheet string, row_idx int, cells array<string>")


def test_cells_are_read_before_the_fill(spark):
    items = comp.composition_items(_grid(spark), dt.date(2001, 9, 1))
    got = [tuple(r) for r in items.orderBy("row_idx").select(
        "row_idx", "cliente", "cliente_norm", "centro_costo", F.col("saldo_abierto").cast("double"), "documento_ref", "dias_vencido_item").collect()]
    assert got == [(2, "Juan Pérez", "JUAN PEREZ", "c1", 1234.5, "d1", 212), (3, "Juan Pérez", "JUAN PEREZ", "c1", 10.0, "d2", None),
                   (8, "Ana", "ANA", "c2", 2.5, None, 1)]
    above = _plan(items, "optimizedPlan").split("Window")[0]
    assert "regexp_replace" not in above and "gettimestamp" not in above.lower()


def test_generated_methods_of_the_items_can_be_compiled(spark):
    items = comp.composition_items(_grid(spark), dt.date(2001, 9, 1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        items = items.select("*")
        stages = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(items._jdf.queryExecution().debug().codegenToSeq())
        assert max(s._3().maxMethodCodeSize() for s in stages) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_type_of_a_movement_takes_no_pattern_per_row(spark):
    docs = ["", "  ", None, "Saldo Inicial", " saldo inicial", "cobranza_fce - 7", "NCVEE", "ncvee  - 1", "xNCVEE - 1", "FACVTA - COBRANZA - 2",
            " - COBRANZA", "FCEVCTA-3", " cobranza - 1 ", "FCENCVTAELEC\t- 1"]
    kind = {d: t for d, t in spark.createDataFrame([(d,) for d in docs], "d string").select("d", movement_type("d")).collect()}
    charges = {" saldo inicial", "xNCVEE - 1", "FACVTA - COBRANZA - 2", " - COBRANZA"}
    openings = {"", "  ", None, "Saldo Inicial"}
    assert {d for d, t in kind.items() if t == "Factura/Cargo"} == charges
    assert {d for d, t in kind.items() if t == "Saldo Inicial"} == openings
    assert "split(" not in str(movement_type("d"))


def test_strip_of_a_named_column_equals_python(spark):
    ends = ["", "a", "~", "!", "é", "\x7f", "　", " ", "\x1f", *whitespace_chars()[:9], "\U0001F600"]
    texts = [None, *{a + m + b for a in ends for b in ends for m in ("", "x", " y ")}]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip("t"), strip(F.col("t"))).collect()
    assert all(one == two == (None if t is None else t.strip()) for t, one, two in rows)
    assert spark.range(3).select(strip("id").alias("s")).collect()[2].s == "2"
