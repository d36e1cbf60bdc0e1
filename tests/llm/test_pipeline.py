"""The pipeline's stages: each works on all that the one before kept."""

from collections import Counter

import corpus_pipeline as cp
from arlens.llm import decontaminate, order_minhash, source_mix

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns, seen = docs.columns, {}
    for name, stage in cp.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        seen[name] = docs
        if name != "sharding":
            assert docs.columns == columns, name
        if name in ("language_id", "near_duplicates", "decontamination"):
            assert not Counter(tuple(r) for r in docs.collect()) - Counter(tuple(r) for r in before.collect())
    clean = seen["near_duplicates"]
    assert order_minhash.near_duplicates(clean).filter("NOT first").count() == 0
    leaked = {r["doc_id"] for r in decontaminate.leaks(clean, benchmark).collect()}
    assert {r["doc_id"] for r in clean.collect()} - {r["doc_id"] for r in seen["decontamination"].collect()} == leaked
    sizes = Counter({r["source"]: r["n"] for r in seen["decontamination"].groupBy("source").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()})
    assert max(Counter(r["doc_id"] for r in seen["source_mix"].collect()).values()) <= source_mix.MOST_TIMES
    assert set(r["source"] for r in seen["source_mix"].collect()) <= set(sizes)
    last = seen["sharding"].collect()
    assert len(last) == seen["source_mix"].count()
    for s in range(cp.SHARDS):
        slots = sorted(r["slot"] for r in last if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_hard_and_empty_tables(spark, hard, nothing):
    for start in (hard, nothing):
        docs = start
        for _, stage in cp.STAGES[:2] + cp.STAGES[3:]:
            docs = stage(spark, docs, SF)
        assert docs.count() <= 3 * start.count()
