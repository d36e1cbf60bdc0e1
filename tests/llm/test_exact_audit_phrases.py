"""Ops 11, 12 and 13 against plain Python, and their hard cases."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from arlens.llm import collocations as co
from arlens.llm import digest_merge as dm
from arlens.llm import filter_audit as fa

WHITE = re.compile(r"[\x20\x09-\x0D]+")


# --- op 11 ---------------------------------------------------------------------------


def groups_of(rows):
    out = defaultdict(list)
    for r in rows:
        out[WHITE.sub(" ", r[1] or "")].append(r[0])
    return out


@pytest.mark.parametrize("levels", [1, 2])
def test_groups_of_hard_rows(hard, hard_rows, levels):
    got = dm.exact_groups(hard, tuple(hard.columns), levels=levels).collect()
    want = groups_of(hard_rows)
    assert len(got) == len(hard_rows)
    kept = Counter()
    for r in got:
        text = WHITE.sub(" ", r["row"]["text"] or "")
        ids = want[text]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == min((i for i in ids if i is not None), default=None)
        assert r["text_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        kept[text] += r["kept"]
        if r["kept"]:
            assert r["row"]["doc_id"] == r["keep_id"]
    assert set(kept.values()) == {1} and len(kept) == len(want)


def test_deduplicated_keeps_columns_and_one_row_each(hard, hard_rows, nothing):
    kept = dm.deduplicated(hard)
    assert kept.columns == hard.columns
    assert kept.count() == len(groups_of(hard_rows))
    assert dm.exact_groups(nothing).count() == 0


def test_a_hot_text_is_few_entries_per_level(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    signed = dm.digests(rows, ("doc_id",), "text", "doc_id", 64)
    first, last = dm.merged(signed, 2)
    hot = F.unhex(F.sha2(F.lit("hot"), 256))
    assert first.filter(F.col("digest") == hot).count() <= 64
    assert last.filter(F.col("digest") == hot).select("n", "least.id").collect() == [(1000, 0)]
    # After the last round a slot's number is its digests' first bits.
    assert last.filter(F.col("slot") != F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(63))).count() == 0
    assert last.count() == 2001


def test_a_lost_run_is_noticed(spark, monkeypatch):
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    real = dm._run
    monkeypatch.setattr(dm, "_run", lambda x: real(x).filter("slot <> 3"))
    with pytest.raises(RuntimeError, match="round 1"):
        dm.exact_groups(rows, levels=1)


def test_only_native_operators(spark, hard):
    plan = dm.exact_groups(hard)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- op 12 ---------------------------------------------------------------------------


def bits_of(rows):
    first = {}
    for r in rows:
        t = r[1] or ""
        if r[0] is not None:
            first[t] = min(first.get(t, r[0]), r[0])
    out = []
    for r in rows:
        t = r[1] or ""
        w = [x for x in WHITE.split(t) if x]
        fails = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 any(c in fa.SYMBOLS for c in t), r[0] is not None and r[0] > first[t])
        out.append(tuple(map(bool, fails)))
    return out


def audit_of(rows, labels):
    good, toxic = ({d for d, q, x in labels if (q, x)[k] == 1 and d is not None} for k in (0, 1))
    parts = defaultdict(list)
    for r, b in zip(rows, bits_of(rows), strict=True):
        parts[r[2] or ""].append((b, r[0] in good, r[0] in toxic))
    out = {}
    for part, docs in parts.items():
        by = Counter()
        here = {}
        for order in permutations("ABCDE"):
            left, gone = docs, []
            for step, f in enumerate(order, 1):
                i = "ABCDE".index(f)
                cut = [d for d in left if d[0][i]]
                left = [d for d in left if not d[0][i]]
                here["".join(order), step] = (len(left), len(cut), sum(d[0][i] for d in gone), sum(d[0] == tuple(k == i for k in range(5)) for d in docs),
                                              sum(d[1] for d in cut), sum(d[2] for d in cut))
                gone = gone + cut
                by[f] += len(cut)
        for (order, step), v in here.items():
            out[part, order, step] = (*v, by[order[step - 1]])
    return out


def test_audit_against_plain_filters(spark, hard, hard_rows):
    rows = [*hard_rows, (300, "word " * 250, "en", "s", None, None, None, None), (301, "A# " * 40, None, "s", None, None, None, None),
            (302, "A# " * 40, "", "s", None, None, None, None), (2, "word " * 250, "fr", "s", None, None, None, None),
            (None, "A# " * 40, "de", "s", None, None, None, None)]
    labels = [(d, d % 2, d % 3 % 2) for d in range(0, 303, 1)] + [(300, 1, None), (None, 1, 1), (301, None, 1), (5, 1, 0), (5, 0, 1)]
    docs = spark.createDataFrame(rows, hard.schema).withColumns({"cell": F.lit(1), "quality": F.lit("x"), "n": F.lit(2)}).repartition(4)
    got = fa.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit_of(rows, labels)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in got} == want
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in rows})


def test_audit_of_nothing(spark, nothing):
    assert fa.filter_audit(nothing, spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_contractions_are_sums_over_cells():
    rng = np.random.default_rng(2)
    cell, n = np.arange(32), rng.integers(0, 50, 32)
    t = fa.tensor(cell, n)
    assert fa.contract(t) == n.sum()
    assert fa.contract(t, A=fa.PASS, D=fa.FAIL) == n[(cell & 1 == 0) & (cell & 8 > 0)].sum()
    assert fa.contract(t, **dict.fromkeys("ABCD", fa.PASS), E=fa.FAIL) == n[16]


# --- op 13 ---------------------------------------------------------------------------


def mined(rows, top, least):
    f, n = defaultdict(Counter), Counter()
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in f.items():
        cover, found = Counter(), []
        for p, a in c.items():
            if len(p) == 3 and a >= least:
                for q in (p[:2], p[1:]):
                    cover[q] = max(cover[q], a)
        for p, a in c.items():
            if len(p) > 1 and a >= least and not (len(p) == 2 and cover[p] and 100 * cover[p] >= 50 * a):
                score, _, l, r = min((10 ** 6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def phrase_rows():
    rng = np.random.default_rng(11)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "éßstuvw"]
    rows = []
    for lang in ("en", "fr", None, "und", ""):
        weight = 1 / np.arange(1, len(words) + 1)
        pick = rng.choice(words, 6000, p=weight / weight.sum())
        for i in range(0, 6000, 120):
            w = list(pick[i:i + 120])
            for j in range(0, 120, 17):
                w[j:j + 3] = [["New", "YORK", "City"], ["of", "the", "Éa"], ["rare", f"x{i}", "one"]][(i + j) % 3]
            rows.append((" ".join(x + str(rng.choice(["", "", "", ",", ".\n", "\t", " ; "])) for x in w), lang))
    rows += [(None, "en"), ("", "fr"), (" \t\n ", None), ("*** !!! 123", "de"), ("one two three " * 30, "de"), ("one two three " * 30, "de"),
             ("same " * 4000, "xx"), ("a b c d e " * 12, "zz")]
    return rows


@pytest.mark.parametrize(("top", "least"), [(2000, 10), (25, 10), (3, 2), (1, 12)])
def test_phrases_against_counting_all(spark, phrase_rows, top, least):
    docs = spark.createDataFrame(phrase_rows, "text string, lang string").withColumns({"n": F.lit(1), "score": F.lit("x"), "phrase": F.lit(None)}).repartition(4)
    got = sorted(tuple(r) for r in co.collocations(docs, top=top, least=least).collect())
    assert got == mined(phrase_rows, top, least)


def test_growth_stops_at_the_level(spark, phrase_rows, monkeypatch):
    counted = []
    real = co.Bitmap.__init__

    def spy(self, rows, words):
        counted.append((words, rows.count()))
        real(self, rows, words)

    monkeypatch.setattr(co.Bitmap, "__init__", spy)
    docs = spark.createDataFrame(phrase_rows, "text string, lang string")
    co.collocations(docs, top=10).collect()
    few = sum(n for words, n in counted if words == 2)
    counted.clear()
    co.collocations(docs).collect()
    assert few < 0.75 * sum(n for words, n in counted if words == 2), "prefixes below the level are not grown"


def test_products_beyond_64_bits(spark):
    big = 4_000_000_000_000
    words = spark.createDataFrame([("en", "a", big), ("en", "b", big + 1)], co.COUNTED)
    pair = spark.createDataFrame([("en", "a b", big - 1)], co.COUNTED)
    row = co.scored(pair, words).collect()[0]
    assert row["score"] == 10 ** 6 * (big - 1) ** 2 // (big * (big + 1))


def test_phrases_of_nothing(nothing):
    assert co.collocations(nothing).count() == 0


def test_keys_beyond_63_bits_are_told_apart():
    keys = [np.array([0, 0, 1, 1, 0]), np.array([5, 5, 5, 2 ** 40, 5]), np.array([7, 7, 2 ** 40 - 1, 7, 8])]
    rows, n = co._unique(keys, [2, 2 ** 41, 2 ** 40])
    assert Counter({tuple(int(k[i]) for k in rows): int(n[i]) for i in range(len(n))}) == Counter(zip(*(k.tolist() for k in keys), strict=True))
