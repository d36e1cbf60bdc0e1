"""Names that are mentioned again, and the address and number forms added to the search."""

import pytest

from arlens.llm import pii_surrogates as pii
from arlens.llm import rendezvous

KEY = b"k"


def rewritten(text):
    out, at = [], 0
    for kind, a, b, what in pii.find(text):
        out += [text[at:a], pii.render(kind, text[a:b], pii.surrogate(KEY, kind, what))]
        at = b
    return "".join(out) + text[at:]


@pytest.mark.parametrize("text, kind", [("call +14155552671 now", "phone"), ("tel +33 1 23 45 67 89.", "phone"), ("(+49 30 1234 5678)", "phone"),
                                        ("host 2001:db8::1 up", "ip6"), ("2001:0db8:0000:0000:0000:ff00:0042:8329", "ip6")])
def test_forms_found_whole(text, kind):
    found = list(pii.find(text))
    assert [f[0] for f in found] == [kind]
    new = rewritten(text)
    assert new != text and [f[0] for f in pii.find(new)] in ([kind], []) and len(text[found[0][1]:found[0][2]]) >= 11


@pytest.mark.parametrize("text", ["at 12:30:45 and 10:20", "std::vector a::b", "x = dead::beef", "1 + 23 45", "+1 2 3", "", "Mr", "Smith and Jones left"])
def test_nothing_found(text):
    assert list(pii.find(text)) == []


def test_spellings_of_an_address_are_one_entity():
    a, b = (next(iter(pii.find(t)))[3] for t in ("2001:0DB8::0001", "2001:db8:0:0:0:0:0:1"))
    assert a == b == "2001:db8::1"


def test_bare_mentions_follow_the_name():
    text = "Mr John Smith said. John Smith left. Mr Smith too, and Smith again. Smithers stays; smith stays."
    new = rewritten(text)
    full = pii.surrogate(KEY, "name", "m:john smith").split(":")[1].title()
    last = full.split(" ")[-1]
    assert new == f"Mr {full} said. {full} left. Mr {last} too, and {last} again. Smithers stays; smith stays."


def test_addresses_without_gender_join_the_only_one_that_has():
    whats = [f[3] for f in pii.find("Dr Ana Ruiz met Mrs Ana Ruiz. Dr Ruiz spoke.")]
    assert whats == ["f:ana ruiz"] * 3


def test_a_surname_of_two_people_stays_their_own():
    found = list(pii.find("Mr Paul Weber and Mrs Eva Weber. Mr Weber, Mrs Weber, Dr Weber. Weber."))
    assert [f[3] for f in found] == ["m:paul weber", "f:eva weber", "m:paul weber", "f:eva weber", "n:weber"]


def test_count_keeps_an_input_column_of_its_name(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org", 77), (2, None, 78), (3, "plain", None)], "doc_id long, text string, n_entities int")
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs, "k").collect()}
    assert {i: (r["n_entities"], r["n_entities_"]) for i, r in got.items()} == {1: (77, 1), 2: (78, 0), 3: (None, 0)}
    assert got[1]["text"] != "mail a.b@c.org" and got[3]["text"] == "plain"


def test_sharding_keeps_size_and_crc_columns(spark):
    docs = spark.createDataFrame([(i % 40, f"t{i}", "own", -i) for i in range(100)], "doc_id long, text string, size string, text_crc32 int")
    got = rendezvous.shard_documents(docs, 4)
    assert got.columns == [*docs.columns, "shard", "slot"]
    assert got.select(docs.columns).exceptAll(docs).count() == 0
    plain = rendezvous.shard_documents(docs.drop("size", "text_crc32"), 4)
    assert got.select("doc_id", "text", "shard", "slot").exceptAll(plain.select("doc_id", "text", "shard", "slot")).count() == 0
    slots = {}
    for r in got.collect():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
