"""Op 2: code lengths against a plain implementation, and hard cases."""

import math
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from arlens.llm import ppm_language as ppm


def bits(text: str, train: list[str], order: int) -> float:
    seen = [defaultdict(Counter) for _ in range(order + 1)]
    pad = b"\n" * order
    for t in train:
        raw = pad + t.lower().encode()
        for i in range(order, len(raw)):
            for k in range(order + 1):
                seen[k][raw[i - k:i]][raw[i]] += 1
    raw, total = pad + text.lower().encode(), 0.0
    for i in range(order, len(raw)):
        for k in range(order, -1, -1):
            c = seen[k].get(raw[i - k:i])
            if c is None:
                continue
            n = sum(c.values()) + len(c)
            if raw[i] in c:
                total -= math.log2(c[raw[i]] / n)
                break
            total -= math.log2(len(c) / n)
        else:
            total += 8.0
    return total


def test_code_lengths(spark, prose):
    train = [(i, prose(i, 60, la), la) for i, la in enumerate(["en", "de"] * 4)]
    model = ppm.train(spark.createDataFrame(train, "doc_id long, text string, lang string"), order=3)
    tests = [prose(50, 9, "en"), prose(51, 9, "de"), "Ünseen Zeichen, 漢字!", "q"]
    got = ppm.predict(spark.createDataFrame([(t,) for t in tests], "text string"), model, into="r").collect()
    for row in got:
        want = {la: bits(row["text"], [t for _, t, x in train if x == la], 3) for la in ("de", "en")}
        best = min(want, key=lambda x: (want[x], x))
        size = len(row["text"].lower().encode())
        assert row["r"]["lang"] == best
        assert math.isclose(row["r"]["bits_per_byte"], want[best] / size, rel_tol=1e-9)
        assert math.isclose(row["r"]["score"], 1 / sum(2 ** (want[best] - x) for x in want.values()), rel_tol=1e-9)


def test_hard_rows(hard, hard_rows):
    model = ppm.train(hard)
    rows = ppm.predict(hard, model, into="r").collect()
    assert len(rows) == len(hard_rows)
    for r in rows:
        if r["doc_id"] in (100, 101, 102, 103):
            assert (r["r"]["lang"], r["r"]["score"]) == ("und", 0.0)
        elif r["lang"] is not None and r["doc_id"] != 5:
            assert r["r"]["lang"] == r["lang"]
    kept = ppm.language_filter(hard)
    assert kept.columns == hard.columns
    assert kept.count() == len(hard_rows) - 4


def test_nothing_learned(hard, nothing):
    model = ppm.train(nothing)
    assert ppm.predict(hard, model, into="r").filter(F.col("r.lang") != "und").count() == 0
    assert ppm.language_filter(nothing).count() == 0


def test_held_out_accuracy(spark):
    from arlens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_ppm_language"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right / n > 0.98


def test_a_language_of_few_long_documents_is_learned(spark, prose):
    long = [(i, prose(i, 30_000, "de"), "de") for i in range(3)]
    rows = long + [(100 + i, prose(100 + i, 400), "en") for i in range(200)]
    model = ppm.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample_bytes=8192)
    asked = spark.createDataFrame([(1, prose(900, 80, "de")), (2, prose(901, 80))], "doc_id long, text string")
    got = {r["doc_id"]: r["_r"] for r in ppm.predict(asked, model, into="_r").collect()}
    assert got[1]["lang"] == "de" and got[2]["lang"] == "en"
    assert max(r["bits_per_byte"] for r in got.values()) < 4, "a language without a sample costs 8"
