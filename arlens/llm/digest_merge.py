"""Exact duplicates by a tree-merge of sorted digest runs.

1. Every row gets the digest of its normalised text (each run of ASCII white
   space becomes one space): SHA-256, and beside it the text's length and a 64-bit
   hash by another function. Two rows count as equal only if all three agree.
2. Rows are dealt evenly to 2 ** (FAN_BITS * levels) slots. A slot's rows, aggregated and sorted by digest, are a run: one
   entry per digest with its smallest identifier and its number of rows.
3. Runs are exchanged in rounds, as in a binomial tree: in round k the 2 ** FAN_BITS
   slots that differ only in the k-th group of bits of their number meet. Each of
   them takes the entries whose digest has its own number in that group, merges the
   sorted runs it receives, and keeps the smallest identifier of each digest. After
   the last round a slot's number is the first bits of its digests, so that each
   digest is one entry in one slot, and no slot ever holds more than its share.
4. At every level the number of rows the entries stand for must be the number of
   rows of the table, or the job stops: no run may be lost or merged twice.
5. The verdicts go down again over the first level's entries (slot, digest), so a
   digest of a third of all rows is spread over all slots on its way back.

Merging at every level is what keeps a hot text cheap: it is one entry per slot
after the first level, and a 2 ** FAN_BITS-th of that after each round.

Defined results: a null text is an empty one. ids are compared as numbers; a null
id counts as larger than any other, and keep_id is null if no row of the group has
an id. Exactly one row of a group is kept: of rows that repeat the smallest id,
one of them. An empty table gives an empty result. All columns of the input may
have any name; they travel as one struct.

Everything is DataFrame functions; each level is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import WHITE, stored

FAN_BITS = 3
KEY = ("digest", "chars", "check")


def normalised(text: str = "text") -> Column:
    """``text`` with each run of white space as one space; a null is empty."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), WHITE + "+", " ")


def levels_for(partitions: int) -> int:
    """Rounds that give at least as many slots as the session shuffles into."""
    return max(1, -(-max(partitions - 1, 1).bit_length() // FAN_BITS))


def digests(docs: DataFrame, keep: tuple[str, ...], text: str, doc_id: str, slots: int) -> DataFrame:
    """The stored rows: ``row`` (the columns ``keep``), the key, the id, the slot and
    ``mark``, a number that tells even whole repeats apart."""
    clean = docs.select(F.struct(*keep).alias("row"), F.col(doc_id).alias("id"), normalised(text).alias("t"), F.monotonically_increasing_id().alias("mark"))
    return stored(clean.select(
        "row", "id", F.unhex(F.sha2("t", 256)).alias("digest"), F.length("t").alias("chars"), F.xxhash64("t").alias("check"),
        F.pmod(F.xxhash64("mark"), F.lit(slots)).cast("int").alias("slot"), "mark"), "digests")


def _smallest() -> Column:
    return F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least")


def _run(rows: DataFrame) -> DataFrame:
    """Merge the entries of each slot: exchanged by slot, sorted by digest, one left per digest."""
    return (rows.repartition("slot").sortWithinPartitions("slot", *KEY)
            .groupBy("slot", *KEY).agg(F.min("least").alias("least"), F.sum("n").alias("n")))


def _total(runs: DataFrame) -> int:
    return runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def merged(rows: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(first, last): the entries of the first level and those after the last round."""
    # Partial aggregation: a task hands on one entry per slot and digest.
    first = stored(rows.groupBy("slot", *KEY).agg(_smallest(), F.count(F.lit(1)).alias("n")), "run-0")
    want = _total(first)
    # The first bits of the digest: where its entries end.
    goal = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long")
    now = first
    for k in range(levels):
        mask = ((1 << FAN_BITS) - 1) << (FAN_BITS * k)
        to = F.col("slot").bitwiseAND(F.lit(~mask)).bitwiseOR(goal.bitwiseAND(F.lit(mask)).cast("int"))
        now = stored(_run(now.withColumn("slot", to)), f"run-{k + 1}")
        got = _total(now)
        if got != want:
            raise RuntimeError(f"round {k + 1} stands for {got} rows, not {want}")
    return first, now


def exact_groups(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", doc_id: str = "doc_id", levels: int | None = None) -> DataFrame:
    """(row, keep_id, group_size, kept, text_sha256) of every row of ``docs``; ``row`` is a
    struct of the columns ``keep``."""
    if levels is None:
        levels = levels_for(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = digests(docs, keep, text, doc_id, 1 << (FAN_BITS * levels))
    first, last = merged(rows, levels)
    heads = last.select(*KEY, F.col("least").alias("head"), F.col("n").alias("group_size"))
    down = stored(first.select("slot", *KEY).join(heads, list(KEY)), "verdicts")
    return rows.join(down, ["slot", *KEY]).select(
        "row", F.col("head.id").alias("keep_id"), "group_size", (F.col("mark") == F.col("head.mark")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with the kept row of each group; columns unchanged."""
    return exact_groups(docs, tuple(docs.columns), text, doc_id).filter("kept").select("row.*")
