"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

1. Every source is cut into blocks by a hash of the record key, and its blocks
   get a permuted order. Block totals come from one partial aggregation.
2. Water-filling over the few source totals gives each source its target in
   words. The quota is exact at block level: all blocks as often as the source
   fits whole into its target, then blocks in permuted order, and of the block
   that crosses the target the documents whose middle word is still inside.
3. The drawn blocks of all sources are shared among the output shards by a tree:
   each node draws, without replacement, how many of its blocks of every source
   go left (multivariate hypergeometric, seeded by the node), the others go
   right. A leaf holds a shard's exact quota of blocks of every source.
4. A second permutation deals disjoint runs of a source's drawn blocks to the
   shards by those quotas, and rows are shuffled by hash inside their shard.

The driver sees one row per source; the plan has sources * BLOCKS rows at most
and is joined as a stored table. All permutations are hashes of keys, so reruns
agree. A hot source only adds rows to its blocks; the running sum that cuts a
block reads one block of each source.

Defined results: null or wordless texts have size 0; null is a source of its
own, after all others; rows of one source that repeat a key are drawn together;
an empty table gives an empty mix; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arlens.llm.common import WORD, id_text, stored
from arlens.llm.rendezvous import HASH_BITS, hash52

BLOCKS = 1024
MOST_TIMES = 3


class Source(NamedTuple):
    name: str | None
    size: int
    target: float
    times: int      # whole passes over the source
    rest: float     # words still to be drawn after them


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def cycled(place: int) -> int:
    """Weights 1, 2, 3, 1, 2, 3, ... for sources in order."""
    return 1 + place % 3


def targets(sizes: list[tuple[str | None, int]], weight: Callable[[int], int] = cycled,
            most: int = MOST_TIMES) -> list[Source]:
    """Share the total of all sizes by weight; what a source cannot hold (``most``
    times its size) is shared again among the others by weight."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [(name, size, weight(i)) for i, (name, size) in enumerate(order)]
    left, shares = sum(size for _, size, _ in rows), sum(w for _, _, w in rows)
    got: dict[str | None, float] = {}
    open_rows = sorted(rows, key=lambda r: most * r[1] / r[2])
    while open_rows and most * open_rows[0][1] * shares <= open_rows[0][2] * left:
        name, size, w = open_rows.pop(0)
        got[name] = float(most * size)
        left, shares = left - most * size, shares - w
    got |= {name: w * left / shares for name, _, w in open_rows}
    out = []
    for name, size, _ in rows:
        times = min(most, int(got[name] // size)) if size else 0
        out.append(Source(name, size, got[name], times, got[name] - times * size if size else 0.0))
    return out


def split_tree(counts: np.ndarray, shards: int, seed: int, node: int = 1) -> np.ndarray:
    """Quotas (shards x sources) of ``counts`` blocks per source, drawn node by node."""
    if shards == 1:
        return counts[None, :]
    left = shards // 2
    total = int(counts.sum())
    drawn = np.random.default_rng([seed, node]).multivariate_hypergeometric(counts, total * left // shards) if total else counts
    return np.vstack([split_tree(drawn, left, seed, 2 * node), split_tree(counts - drawn, shards - left, seed, 2 * node + 1)])


def _source_key(col: str) -> Column:
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(col)))


def keyed(docs: DataFrame, source: str = "source") -> DataFrame:
    """Add the columns the plan joins on: _mix_source, _mix_hash, _mix_block, _mix_key."""
    key = id_text()
    h = hash52(F.concat(F.lit("mix/"), key))
    return docs.withColumns({"_mix_source": _source_key(source), "_mix_key": key, "_mix_hash": h,
                             "_mix_block": F.shiftright(h, HASH_BITS - (BLOCKS.bit_length() - 1)).cast("int")})


PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("source_size", T.LongType()),
                     T.StructField("target", T.DoubleType()), T.StructField("times", T.IntegerType()),
                     T.StructField("rest", T.DoubleType()), T.StructField("quotas", T.ArrayType(T.LongType()))])


def plan(units: DataFrame, shards: int = 16, seed: int = 17) -> DataFrame:
    """One row per source and block: source totals and target, the cut of the
    block that crosses the target, and ``shards``, the shard of each copy.

    ``units`` holds _mix_source, _mix_key, _mix_hash, _mix_block and size.
    """
    spark = units.sparkSession
    blocks = stored(units.groupBy("_mix_source", "_mix_block").agg(F.sum("size").alias("words")).withColumn(
        "draw", hash52(F.concat_ws("/", F.lit("block"), "_mix_source", F.col("_mix_block").cast("string")))), "mix-blocks")
    per_source = blocks.groupBy("_mix_source").agg(F.sum("words").alias("size")).collect()
    sources = targets([(r["_mix_source"][1:] if r["_mix_source"][0] == "s" else None, r["size"]) for r in per_source])

    def table(quotas: np.ndarray | None) -> DataFrame:
        rows = [("n" if s.name is None else "s" + s.name, s.size, s.target, s.times, s.rest,
                 None if quotas is None else [int(x) for x in quotas[:, i]]) for i, s in enumerate(sources)]
        return spark.createDataFrame(rows, PLAN).withColumnRenamed("source", "_mix_source")

    inside = Window.partitionBy("_mix_source").orderBy("draw", "_mix_block")
    ranked = blocks.join(table(None).drop("quotas"), "_mix_source").withColumn("before", F.sum("words").over(inside) - F.col("words"))
    state = F.when((F.col("rest") <= 0) | (F.col("before") >= F.col("rest")), "none").when(
        F.col("before") + F.col("words") <= F.col("rest"), "all").otherwise("cut")
    ranked = stored(ranked.withColumn("state", state), "mix-ranked")

    # The crossing block of each source: keep units up to the last whose middle is inside.
    order = Window.partitionBy("_mix_source").orderBy("_mix_hash", "_mix_key")
    crossing = ranked.filter("state = 'cut'").select("_mix_source", "_mix_block", "before", "rest")
    inner = (units.join(crossing, ["_mix_source", "_mix_block"]).groupBy("_mix_source", "_mix_hash", "_mix_key", "before", "rest")
             .agg(F.sum("size").alias("size")).withColumn("upto", F.sum("size").over(order)))
    cuts = inner.filter(2 * (F.col("before") + F.col("upto")) - F.col("size") <= 2 * F.col("rest")).groupBy("_mix_source").agg(
        F.max(F.struct("_mix_hash", "_mix_key")).alias("last"))

    copies = F.col("times") + F.when(F.col("state") == "none", 0).otherwise(1)
    totals = {r["_mix_source"]: r["n"] for r in ranked.groupBy("_mix_source").agg(F.sum(copies).alias("n")).collect()}
    counts = np.array([totals["n" if s.name is None else "s" + s.name] for s in sources], dtype=np.int64)
    quotas = table(split_tree(counts, shards, seed) if len(sources) else None).select("_mix_source", "quotas")

    # A second permutation of the drawn blocks, dealt to the shards in runs of the quotas' lengths.
    dealt = Window.partitionBy("_mix_source").orderBy("deal", "_mix_block", "pass")
    passes = F.slice(F.array(*[F.lit(i) for i in range(MOST_TIMES + 1)]), F.lit(1), copies.cast("int"))
    deals = ranked.withColumn("pass", F.explode(passes)).withColumn(
        "deal", hash52(F.concat_ws("/", F.lit("deal"), "_mix_source", F.col("_mix_block").cast("string"), F.col("pass").cast("string"))))
    deals = deals.withColumn("place", F.row_number().over(dealt)).join(quotas, "_mix_source")
    upto = F.transform("quotas", lambda q, i: F.aggregate(F.slice("quotas", 1, i + 1), F.lit(0).cast("long"), lambda a, b: a + b))
    shard = F.size(F.filter(upto, lambda x: x < F.col("place")))
    lists = deals.withColumn("shard", shard.cast("int")).groupBy("_mix_source", "_mix_block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))
    done = (ranked.join(lists, ["_mix_source", "_mix_block"], "left").join(cuts, "_mix_source", "left")
            .select("_mix_source", "_mix_block", "source_size", "target", "state",
                    F.coalesce(F.col("dealt")["shard"], F.array().cast("array<int>")).alias("shards"), "last"))
    return stored(done, "mix-plan")


def apply_plan(docs: DataFrame, planned: DataFrame) -> DataFrame:
    """``docs`` (with the columns of ``keyed``) with source_size, target and
    mix_shards, the shards that get a copy of the row; empty if none does."""
    here = F.struct("_mix_hash", "_mix_key") <= F.col("last")
    cut = (F.col("state") == "cut") & ~F.coalesce(here, F.lit(False))
    last = F.greatest(F.size("shards") - 1, F.lit(0))
    return (docs.join(planned, ["_mix_source", "_mix_block"]).withColumn(
        "mix_shards", F.when(cut, F.slice("shards", F.lit(1), last)).otherwise(F.col("shards"))).drop("state", "shards", "last"))


def mix_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is drawn, dealt to its
    shards and shuffled inside them; columns unchanged."""
    columns = docs.columns
    rows = keyed(docs)
    planned = plan(stored(rows.select("_mix_source", "_mix_key", "_mix_hash", "_mix_block", word_count().alias("size")), "mix-units"), shards)
    packed = rows.select(F.struct(*columns).alias("_mix_row"), "_mix_source", "_mix_key", "_mix_hash", "_mix_block")
    drawn = apply_plan(packed, planned).select("_mix_row", "_mix_key", F.posexplode("mix_shards").alias("_mix_copy", "_mix_shard"))
    order = F.xxhash64("_mix_key", "_mix_copy", F.lit("shuffle"))
    # A shard is dealt in chunks, so that a large one is not the work of one task.
    chunk = F.pmod(F.xxhash64("_mix_key", "_mix_copy"), F.lit(16))
    return (drawn.repartition("_mix_shard", chunk).withColumn("_mix_order", order)
            .sortWithinPartitions("_mix_shard", "_mix_order").select("_mix_row.*"))
