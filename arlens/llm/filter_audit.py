"""Interaction audit of quality filters by contraction of contingency tensors.

Five filters, and when a text fails them:

A  fewer than MIN_WORDS words
B  fewer distinct words than half of its words
C  more than 3 % of its characters are A to Z
D  it holds one of SYMBOLS
E  it is identical to the text of a smaller doc_id anywhere in the table

1. Every row becomes its part (language; a null is the empty string), the outcome of
   A to D, the digest of its text and its labels. Outcomes are facts of the text, so
   equal texts are added up by digest, part and label before E is decided: of each
   digest only the row of the smallest doc_id passes E. No row travels back to its
   group, and a text of a third of all rows is a few entries per task.
2. A part's counts over the 32 outcomes are a 2 x 2 x 2 x 2 x 2 tensor, and so are
   those of its good and its toxic documents.
3. Every number of the audit is a contraction of a tensor with one vector per axis:
   PASS, FAIL or ALL. Kept after a step: PASS along the filters so far, ALL along the
   others. Removed: PASS along the earlier filters, FAIL along this one. Redundant:
   all that fail this one less those removed. Only this one: PASS along all others.

The tensors are tiny (32 cells a part), the parts are independent: one task contracts
one part for all orders of the filters.

Defined results: a null text is empty (it fails A, passes B, C and D). A null id has
no smaller one, so it passes E; rows that repeat the smallest id of a text all pass
E. A document is good or toxic if any of its label rows says so. Every part of the
table has all its rows, zeros included. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import WHITE, stored

FILTERS = "ABCDE"
MIN_WORDS = 200
SYMBOLS = "#$%&*|"
#: vectors along an axis (passes, fails)
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def outcomes(text: str = "text") -> Column:
    """Bits 1 (A) to 8 (D) of the filters that look at one text only."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WHITE + "+"), "")
    few = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) < MIN_WORDS, 1).otherwise(0)
                            + F.when(100 * F.size(F.array_distinct(w)) < 50 * F.size(w), 2).otherwise(0)), F.lit(0))
    chars = F.length(t)
    upper = chars - F.length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    marks = chars - F.length(F.translate(t, SYMBOLS, ""))
    return few + F.when(100 * upper.cast("long") > 3 * chars.cast("long"), 4).otherwise(0) + F.when(marks > 0, 8).otherwise(0)


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, cell, n, good, toxic): documents per part and outcome, the E bit being 16."""
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(part), F.lit("")).alias("part"), outcomes(text).alias("bits"),
                       F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    # Rows that repeat an id and a text become one entry.
    rows = stored(rows.groupBy("id", "part", "bits", "digest").agg(F.count(F.lit(1)).alias("n")), "outcomes")
    marked = labels.filter("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    none = F.lit(False)
    some = rows.filter("id IS NOT NULL").join(marked, "id", "left").withColumns({"good": F.coalesce("good", none), "toxic": F.coalesce("toxic", none)})
    # Rows without an id have no label and take no part in the join.
    rows = some.unionByName(rows.filter("id IS NULL").withColumns({"good": none, "toxic": none}))
    kinds = rows.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("loose"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("least"))
    # One digest has as many entries here as parts and labels, however many rows it has.
    first = F.min("least.id").over(Window.partitionBy("digest"))
    passed = F.col("loose") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    split = F.array(F.struct(F.col("bits").alias("cell"), passed.alias("m")), F.struct((F.col("bits") + 16).alias("cell"), (F.col("n") - passed).alias("m")))
    long = kinds.select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", F.inline("s"))
    return long.groupBy("part", "cell").agg(F.sum("m").alias("n"), F.sum(F.when(F.col("good"), F.col("m")).otherwise(0)).alias("good"),
                                            F.sum(F.when(F.col("toxic"), F.col("m")).otherwise(0)).alias("toxic"))


def tensor(cell: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Counts by cell number as a tensor with one axis per filter, A first."""
    flat = np.zeros(1 << len(FILTERS), np.int64)
    np.add.at(flat, cell.astype(int), count.astype(np.int64))
    return flat.reshape([2] * len(FILTERS)).transpose(range(len(FILTERS) - 1, -1, -1))  # bit 1 is the last axis of reshape


def contract(counts: np.ndarray, **along: tuple[int, int]) -> int:
    """Contract ``counts`` with the vector named for each filter, ALL where none is."""
    vectors = [np.array(along.get(f, ALL), np.int64) for f in FILTERS]
    return int(np.einsum("abcde,a,b,c,d,e->", counts, *vectors))


def audit(part: str, n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> pd.DataFrame:
    """All orders and steps of one part."""
    out, removed_by = [], dict.fromkeys(FILTERS, 0)
    fails = {f: contract(n, **{f: FAIL}) for f in FILTERS}
    only = {f: contract(n, **{**dict.fromkeys(FILTERS, PASS), f: FAIL}) for f in FILTERS}
    for order in permutations(FILTERS):
        for step, f in enumerate(order):
            before = dict.fromkeys(order[:step], PASS)
            here = {**before, f: FAIL}
            removed = contract(n, **here)
            removed_by[f] += removed
            out.append((part, "".join(order), step + 1, contract(n, **before, **{f: PASS}), removed, fails[f] - removed, only[f],
                        contract(good, **here), contract(toxic, **here), f))
    return pd.DataFrame([(*r[:-1], removed_by[r[-1]]) for r in out], columns=[c.split()[0] for c in RESULT.split(", ")])


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step."""
    def run(cell: pd.DataFrame) -> pd.DataFrame:
        at = cell["cell"].to_numpy()
        return audit(cell["part"].iloc[0], *(tensor(at, cell[c].to_numpy()) for c in ("n", "good", "toxic")))

    return cells(docs, labels, text, part).groupBy("part").applyInPandas(run, RESULT)
