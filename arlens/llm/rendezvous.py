"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every (key, shard) pair has a hash u in (0, 1); a record goes to the shard with
the largest weight / -ln(u). The choice depends on the key, the shard numbers
and their weights alone, so adding a shard takes records only into the new
shard, in proportion to its weight, and moves none between the old ones.

``slot`` numbers a shard's records without gaps. A shard is cut into
``SLOT_BUCKETS`` ranges of a second hash (of key and text), whose counts give
each range its first slot; rows are numbered inside a range. No task holds a
shard, and the table of first slots has at most shards * SLOT_BUCKETS rows,
which is why it may be broadcast.

Only DataFrame functions are used. Defined results: a null key hashes as the
empty string; a null text has size 1 and the crc of the empty text; repeated
rows share a shard and get slots of their own; an empty table gives an empty
table; columns an operator adds replace input columns of the same name, and
``shard_documents`` adds shard and slot only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import id_text

SLOT_BUCKETS = 1024
HASH_BITS = 52


def hash52(text: Column) -> Column:
    """The first 52 bits of the MD5 of ``text``: the same in every engine with an MD5."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def _score(key: Column, shard: int, weight: float) -> Column:
    u = (hash52(F.concat(key, F.lit(f"/{shard}"))) + F.lit(0.5)) / F.lit(float(1 << HASH_BITS))
    return F.lit(float(weight)) / -F.log(u)


def choose_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key``; the lower number on a tie."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be above 0")
    best = F.array_max(F.array(*[F.struct(_score(key, i, w).alias("s"), F.lit(-i).alias("n")) for i, w in enumerate(weights) if w > 0]))
    return (-best["n"]).cast("int")


def assign(docs: DataFrame, weights: Sequence[float], key: Column | None = None, text: str = "text",
           new_weight: float | None = None) -> DataFrame:
    """``docs`` with size, text_crc32 and shard; with ``new_weight`` also
    grown_shard, the shard if one of that weight came last."""
    key = id_text() if key is None else key
    content = F.coalesce(F.col(text), F.lit(""))
    new = {"size": F.octet_length(content).cast("long") + F.lit(1).cast("long"), "text_crc32": F.crc32(content),
           "shard": choose_shard(key, weights)}
    if new_weight is not None:
        new["grown_shard"] = choose_shard(key, [*weights, new_weight])
    # One projection, so nothing is read back from a column this replaces.
    return docs.withColumns({**new, "_slot_order": hash52(F.concat_ws("#", key, F.crc32(content)))})


def with_slots(assigned: DataFrame, order: Sequence[str] = ("doc_id",),
               ties: Sequence[str] = ("size", "text_crc32")) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, by hash and then ``order`` and ``ties``."""
    rows = assigned.withColumn("_bucket", F.shiftright("_slot_order", HASH_BITS - (SLOT_BUCKETS.bit_length() - 1)).cast("int"))
    starts = (rows.groupBy(F.col("shard").alias("_shard"), F.col("_bucket").alias("_start_bucket")).agg(F.count(F.lit(1)).alias("_n"))
              .select("_shard", "_start_bucket", F.coalesce(F.sum("_n").over(
                  Window.partitionBy("_shard").orderBy("_start_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start")))
    inside = Window.partitionBy("shard", "_bucket").orderBy("_slot_order", *order, *ties)
    return (rows.withColumn("_place", F.row_number().over(inside) - 1)
            .join(F.broadcast(starts), (F.col("shard") == F.col("_shard")) & (F.col("_bucket") == F.col("_start_bucket")))
            .withColumn("slot", F.col("_start") + F.col("_place"))
            .drop("_shard", "_start_bucket", "_start", "_place", "_bucket", "_slot_order"))


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """``docs`` with shard and slot over shards of equal weight, keyed by doc_id; all
    other columns stay, those named like ``assign``'s too."""
    content = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns({"shard": choose_shard(id_text(), [1.0] * shards), "_slot_order": hash52(F.concat_ws("#", id_text(), F.crc32(content))),
                             "_shard_size": F.octet_length(content), "_shard_crc": F.crc32(content)})
    return with_slots(rows, ties=("_shard_size", "_shard_crc")).drop("_shard_size", "_shard_crc")
