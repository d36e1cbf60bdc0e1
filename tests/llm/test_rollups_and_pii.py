"""Ops 5 and 1: brute-force counts, idempotent commits, surrogates that keep
type, format, coreference and distinctness; hard cases."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arlens.llm import pii_surrogates as pii
from arlens.llm import token_rollups as tr
from arlens.llm.common import shared_path
from arlens.llm.queries import QUERIES, TOKENIZERS

FILES = {"v1": f"{TOKENIZERS}/byte_bpe_50k.tiktoken"}


def _totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["documents"], r["tokens"], r["bytes"]) for r in rollup.totals().collect()}


def test_rollup_of_hard_rows(spark, hard, hard_rows, nothing):
    with open(FILES["v1"], "rb") as f:
        encoder = tr._encoder(f.read())
    counted = tr.count_tokens(hard, FILES).withColumn("_bytes", tr.bytes_of("text"))
    rollup = tr.Rollup(spark, shared_path(spark, "t"))
    assert rollup.totals().count() == 0
    assert rollup.commit("a", tr.changes(counted, 1)) is True
    assert rollup.commit("a", tr.changes(counted, 1)) is False
    want = {}
    for r in hard_rows:
        t = r[1] or ""
        d, n, b = want.get((r[3], r[2], "v1"), (0, 0, 0))
        want[r[3], r[2], "v1"] = (d + 1, n + len(encoder.encode_ordinary(t)), b + len(t.encode()))
    assert _totals(rollup) == want
    rollup.commit("b", tr.changes(counted.filter("source = 's0'"), -1))
    rollup.commit("c", tr.changes(tr.count_tokens(nothing, FILES).withColumn("_bytes", tr.bytes_of("text")), 1))
    want = {k: v for k, v in want.items() if k[0] != "s0"}
    assert _totals(rollup) == want
    assert rollup.compact("1") and not rollup.compact("1")
    assert rollup.committed() == ["base-1"] and _totals(rollup) == want
    assert rollup.commit("b", tr.changes(counted, 1)) is False, "a folded batch stays committed"


def test_a_batch_without_marker_is_written_again(spark, hard):
    counted = tr.count_tokens(hard, FILES).withColumn("_bytes", tr.bytes_of("text"))
    rollup = tr.Rollup(spark, shared_path(spark, "t"))
    tr.changes(counted, 1).groupBy(*tr.KEYS).agg(*[F.sum(m).alias(m) for m in tr.MEASURES]).write.parquet(f"{rollup.path}/deltas/batch=x")
    assert rollup.totals().count() == 0
    rollup.commit("x", tr.changes(counted, 1))
    assert sum(v[0] for v in _totals(rollup).values()) == hard.count()


def test_pieces_change_no_token():
    with open(FILES["v1"], "rb") as f:
        encoder = tr._encoder(f.read())
    text = "\n".join(["some words\n\nmore  words", " indented", "x", "line 12", "é\n", "end "] * 4000)
    parts = list(tr.pieces(text))
    assert len(parts) > 1 and "".join(parts) == text
    assert sum(len(encoder.encode_ordinary(p)) for p in parts) == len(encoder.encode_ordinary(text))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    first = {}
    for r in rows:
        first[r["text"]] = min(first.get(r["text"], r["doc_id"]), r["doc_id"])
    want = Counter()
    for version in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        with open(f"{TOKENIZERS}/{version}.tiktoken", "rb") as f:
            encoder = tr._encoder(f.read())
        for r in rows:
            if first[r["text"]] == r["doc_id"]:
                t = re.sub(r"[ \t]+", " ", r["text"])
                k = (r["source"], r["lang"], version)
                want[k, "d"] += 1
                want[k, "t"] += len(encoder.encode_ordinary(t))
                want[k, "b"] += len(t.encode())
    got = Counter()
    for r in QUERIES["op5_token_rollups"](spark, sf).collect():
        k = (r["source"], r["lang"], r["tokenizer_version"])
        got[k, "d"], got[k, "t"], got[k, "b"] = r["documents"], r["tokens"], r["bytes"]
    assert got == want


ENTITIES = [("email", "anna.b2@Mail.example.org"), ("phone", "+1 (499) 555-6503"), ("ip", "108.51.216.133"), ("card", "4952 9359 0025 3052"),
            ("card", "4952935900253052"), ("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6"), ("iban", "GB82 WEST 1234 5698 7654 32"),
            ("ssn", "123-45-6789"), ("name", "Anna Smith"), ("name", "АННА ИВАНОВА")]
TEXT = ('Mrs. Anna Smith wrote to anna.b2@Mail.example.org, ANNA.B2@MAIL.EXAMPLE.ORG; call +1 (499) 555-6503### from 108.51.216.133. '
        'Card 4952 9359 0025 3052 or 4952935900253052, order 9807915762804490. token = "1eb9c654e721b4f812088970e66a6345cee33dd6" '
        'IBAN GB82 WEST 1234 5698 7654 32 and 123-45-6789. Госпожа АННА ИВАНОВА. Version 4.0 of 2024.')


def test_surrogates_keep_format(spark):
    rows = [(1, TEXT), (2, "again anna.b2@mail.example.org"), (3, None), (4, ""), (5, "order 9807915762804490, 12.5 and 1.2.3")]
    got = {r["doc_id"]: r for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    new = got[1]["text"]
    for _, found in ENTITIES:
        assert found not in new
    assert "order 9807915762804490" in new and "Version 4.0 of 2024." in new and got[1]["n_entities"] == 11
    mail = re.search(r"wrote to (\S+), (\S+);", new)
    assert mail[1].upper() == mail[2].upper() and got[2]["text"] == f"again {mail[1]}"
    cards = re.search(r"Card (4\d{3} \d{4} \d{4} \d{4}) or (4\d{15}),", new)
    assert cards[1].replace(" ", "") == cards[2] and pii.luhn(cards[2])
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}###", new)
    assert re.search(r'token = "[0-9a-f]{40}"', new)
    iban = re.search(r"IBAN (GB\d{2} [A-Z]{4} \d{4} \d{4} \d{4} \d{2})", new)[1]
    assert pii._iban_rest(iban.replace(" ", "")) == 1
    assert re.search(r"Mrs\. [A-Z][a-z]*a [A-Z][a-z]+ wrote", new) and re.search(r"Госпожа [А-Я]*А [А-Я]+\.", new)
    assert got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1] and got[5]["n_entities"] == 0


def test_no_text_with_an_entity_is_passed_over(spark):
    texts = [None, "", "plain words", "password = Abcdefghijklmnop1", "API-Key: 'Qwertyuiopasdfghj7'", "ACCESS_KEY=abcdefghijklmnopq2 end",
             "to\u212aen = Abcdefghijklmnop3", "pa\u017fswd: Abcdefghijklmnop4", "ap\u0131key: Abcdefghijklmnop5", "AP\u0130_KEY: Abcdefghijklmnop6",
             "call \u0664\u0669\u0669 \u0665\u0665\u0665 \u0666\u0665\u0660\u0663 now", "\U0001d7d0\U0001d7d1\U0001d7d2-\U0001d7d0\U0001d7d1-\U0001d7d0\U0001d7d1\U0001d7d0\U0001d7d1",
             "Dr Brown", "a@b.example.org", "token of thanks 12"]
    found = {i for i, t in enumerate(texts) if t and next(pii.find(t), None)}
    assert {3, 4, 5, 10, 11} <= found and found <= set(pii._suspects(pii.pa.array(texts)).tolist())
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.pseudonymise(rows, "k").collect()}
    assert {i for i, r in got.items() if r["n_entities"]} == found
    assert all((r["text"] != texts[i]) == (i in found) for i, r in got.items())
    assert re.fullmatch(r"call [\u0660-\u0669]{3} [\u0660-\u0669]{3} [\u0660-\u0669]{4} now", got[10]["text"])


def test_long_numbers_keep_their_digits(spark):
    """A card of 19 digits and an IBAN of 18 digits after its check digits: their digits are no hexadecimal."""
    cards = [body + next(c for c in "0123456789" if pii.luhn(body + c)) for body in (f"4{i:017d}" for i in range(1, 41))]
    ibans = ["DE89 3704 0044 0532 0130 00", "DE\u0668\u0669370400440532013000"]
    texts = [f"Card {c}." for c in cards] + [f"IBAN {i}" for i in ibans]
    rows = pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()
    got = {r["doc_id"]: r["text"] for r in rows}
    new = [re.fullmatch(r"Card (4[0-9]{18})\.", got[i])[1] for i in range(len(cards))]
    assert all(map(pii.luhn, new)) and len(set(new)) == len(cards) and not set(new) & set(cards)
    a = re.fullmatch(r"IBAN (DE\d{2} \d{4} \d{4} \d{4} \d{4} \d{2})", got[len(cards)])[1]
    b = re.fullmatch(r"IBAN (DE[\u0660-\u0669]{2}[0-9]{18})", got[len(cards) + 1])[1]
    assert pii.ascii_digits(b) == a.replace(" ", "") != ibans[0].replace(" ", "") and pii._iban_rest(pii.ascii_digits(b)) == 1


def test_mails_that_fill_their_format_settle(spark):
    """All 100 local parts of two digits at one host: the last of them finds no such part free."""
    found = spark.createDataFrame([("email", f"{i:02d}@mail.example.org") for i in range(100)], "type string, what string")
    rows = pii.settled(found, b"k", rounds=25).collect()
    assert len({r["core"] for r in rows}) == 100
    assert all(re.fullmatch(r"\d\d[a-z]{0,2}@[a-z]{10}\.example\.org", r["core"]) for r in rows)
    assert all(len(r["core"].split("@")[0]) == 2 + r["attempt"] // pii.GROW for r in rows)


def test_collisions_are_redrawn(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, what, attempt=0: str(sum(map(int, what)) % 3 + 5 * attempt))
    found = spark.createDataFrame([("ssn", str(100 + i)) for i in range(12)] + [("ssn", "2")], "type string, what string")
    real = pii.surrogate
    import sys
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[pii.__name__])
    try:
        rows = pii.settled(found, b"k").collect()
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[pii.__name__])
    cores = [r["core"] for r in rows]
    assert len(set(cores)) == len(cores) == 13 and not set(cores) & {r["what"] for r in rows}
    assert all(real(b"k", "ssn", r["what"], r["attempt"]) == r["core"] for r in rows)


def test_redrawn_surrogates_reach_their_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "ip 10.0.0.1"), (2, "ip 10.0.0.2 and 10.0.0.1"), (None, "ip 10.0.0.2")], "doc_id long, text string")
    plain = {r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    real = pii.settled
    monkeypatch.setattr(pii, "settled", lambda found, key: real(found, key).withColumn("attempt", F.when(F.col("what") == "10.0.0.1", 3).otherwise(0)))
    moved = {r["doc_id"]: r["text"] for r in pii.pseudonymise(docs, "k").collect()}
    a = pii.surrogate(b"k", "ip", "10.0.0.1", 3)
    assert moved[1] == f"ip {a}" and moved[2].endswith(f"and {a}") and moved[None] in plain


def test_hard_rows(hard, hard_rows, nothing):
    got = pii.pseudonymise(hard, "k")
    assert got.columns == [*hard.columns, "n_entities"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted((r[0] or -1, r[1] or "") for r in hard_rows)
    assert pii.pseudonymise(nothing, "k").count() == 0


@pytest.mark.parametrize("text", ["4952935900253053", "999.1.1.1", "a@b", "1.2.3.4.5", "20240101 1234"])
def test_lookalikes_stay(text):
    assert list(pii.find(f"x {text} y")) == []
