"""Ops 3 and 6 against plain Python, and their hard cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

from arlens.llm import rendezvous, source_mix
from arlens.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def u52(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_weighted_choice_and_movement(spark):
    rows = spark.range(4000).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'t' AS text")
    weights = [1.0, 2.0, 0.0, 1.0]
    got = rendezvous.assign(rows, weights, new_weight=2.0).collect()

    def choose(k, ws):
        s = [(w / -math.log((u52(f"{k}/{i}") + 0.5) / 2 ** 52), -i) if w else (-1.0, -i) for i, w in enumerate(ws)]
        return -max(s)[1]

    for r in got:
        assert r["shard"] == choose(r["doc_id"], weights)
        assert r["grown_shard"] in (r["shard"], 4)
    share = Counter(r["shard"] for r in got)
    assert 2 not in share and abs(share[1] / 4000 - 0.5) < 0.04
    moved = sum(r["grown_shard"] == 4 for r in got) / 4000
    assert abs(moved - 2 / 6) < 0.04


def test_shards_of_hard_rows(hard, hard_rows, nothing):
    got = rendezvous.with_slots(rendezvous.assign(hard, [1.0] * 16)).collect()
    assert len(got) == len(hard_rows)
    slots = defaultdict(list)
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert rendezvous.shard_documents(nothing).count() == 0


def test_targets_water_filling():
    sizes = [("b", 10), ("a", 1000), (None, 5), ("c", 400)]
    got = {s.name: s for s in source_mix.targets(sizes)}
    # Plain rounds: share by weight, stop at three times the size, share the excess again.
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {n: 1 + i % 3 for i, (n, _) in enumerate(order)}
    cap, target, open_ = {n: 3 * s for n, s in sizes}, {}, {n for n, _ in sizes}
    left = sum(s for _, s in sizes)
    while True:
        shares = sum(weight[n] for n in open_)
        over = {n for n in open_ if weight[n] * left / shares > cap[n]}
        if not over:
            target |= {n: weight[n] * left / shares for n in open_}
            break
        for n in over:
            target[n] = cap[n]
            left -= cap[n]
        open_ -= over
    for n, t in target.items():
        assert math.isclose(got[n].target, t)


def test_tree_quotas():
    counts = np.array([100, 7, 0, 33])
    a, b = (source_mix.split_tree(counts, 5, 17) for _ in range(2))
    assert (a == b).all() and (a.sum(axis=0) == counts).all()
    assert a.sum(axis=1).max() - a.sum(axis=1).min() <= 3


def test_mix_of_hard_rows(spark, hard, hard_rows, nothing):
    units = stored(source_mix.keyed(hard).withColumn("n", source_mix.word_count()).selectExpr(
        "doc_id", "n AS size", "_mix_source", "_mix_key", "_mix_hash", "_mix_block"), "t")
    rows = source_mix.apply_plan(units, source_mix.plan(units, shards=3)).collect()
    assert len(rows) == len(hard_rows)
    sizes = Counter()
    for r in hard_rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want = {s.name: s for s in source_mix.targets(list(sizes.items()))}
    taken, largest = Counter(), Counter()
    for r in rows:
        name = r["_mix_source"][1:] if r["_mix_source"] != "n" else None
        assert r["source_size"] == sizes[name] and r["target"] == want[name].target
        assert len(r["mix_shards"]) <= 3 and all(0 <= x < 3 for x in r["mix_shards"])
        taken[name] += r["size"] * len(r["mix_shards"])
        largest[name] = max(largest[name], r["size"])
    for name, s in want.items():
        assert abs(taken[name] - s.target) <= max(largest[name], 1)
    mixed = source_mix.mix_documents(hard, shards=3)
    assert mixed.columns == hard.columns
    first, second = (Counter(tuple(r) for r in source_mix.mix_documents(hard, shards=3).collect()) for _ in range(2))
    assert first == second and sum(first.values()) == sum(len(r["mix_shards"]) for r in rows)
    assert source_mix.mix_documents(nothing).count() == 0


def test_exact_block_quotas(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "concat('w ', id) AS text", "concat('s', id % 3) AS source")
    units = stored(source_mix.keyed(rows).selectExpr("*", "2L AS size"), "t")
    planned = source_mix.plan(units, shards=4).collect()
    got = defaultdict(Counter)
    for r in planned:
        got[r["_mix_source"]].update(r["shards"])
    totals = np.array([sum(got[f"s{n}"].values()) for n in ("s0", "s1", "s2")])
    quotas = source_mix.split_tree(totals, 4, 17)
    for i, n in enumerate(("s0", "s1", "s2")):
        assert [got[f"s{n}"][m] for m in range(4)] == quotas[:, i].tolist()
