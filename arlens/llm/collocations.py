"""Phrase collocations per language by best-first branch-and-bound growth.

Texts are lower-cased (A to Z), split into pieces at ENDS and those into words at
blanks. A phrase is a run of 2 or 3 words of one piece that occurs MIN_COUNT times or
more in a language. Cut after its first k words, its score is
floor(SCALE * a * a / (l * r)): a, l and r count the phrase, its first part and the
rest. The lowest-scoring cut counts. A phrase is dropped if a longer one that occurs
at least half as often contains it. Wanted are the first TOP survivors of each
language and whoever ties with the last of them.

Growth: words, then pairs of words, then words behind pairs.

1. Words are counted exactly. A bitmap of the frequent ones (fixed size, hashed, so it
   may hold more but never fewer) keeps pairs with a rare word from being counted.
2. Pairs are counted exactly and scored. A pair is also the prefix of longer phrases:
   such a phrase p w has a <= f(p), and its cut after the first word v leaves a rest
   that occurs at least a times, so its score is at most SCALE * f(p) / f(v). That
   bound from prefix counts is admissible: no phrase behind the prefix scores more.
3. The frontier is worked off best-first: with a level per language, the prefixes whose
   bound reaches the level are grown, and the pairs whose score reaches it are grown in
   both directions, as only longer phrases can drop them. All phrases that can
   score the level or more are then counted exactly, as is whatever drops one of them.
   If a language has TOP survivors at its level, its result is settled, ties included;
   else its level goes down and only what newly reaches it is grown. At level 0
   everything has been grown.

A growth pass reads the texts once and counts what the bitmaps of the frontier let
through; a phrase's every occurrence passes or none, so its count is exact and a hash
clash costs work only.

Exactness: counts are sums of longs; products are taken in 38 decimal digits.

Defined results: a null text is empty; a null language is ``und``. Ties of a cut go to
the first. Rank is by score, then a, then the phrase's UTF-8 bytes. Repeated rows count
as often as they occur. Languages without a candidate have no row. An empty table
gives an empty result; other columns are ignored.

Memory: a task works on slices of at most SLICE bytes (or one text) and adds up equal
phrases of a slice before they are shuffled. Bitmaps have at most 2 ** MOST_BITS bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import slices, stored, text_buffer

ENDS = ".,;:!?\n\v\f\r"
MIN_COUNT = 10
TOP = 2000
SCALE = 1_000_000
COVER = 50              # per cent of a phrase's count at which a longer one drops it
SLICE = 2 << 20
MOST_BITS = 28
PARTS = 64
COUNTED = "lang string, phrase string, n long"
# Odd multipliers below 2 ** 29: three products of 32-bit numbers add up within 63 bits.
_MIX = (0x1B873593, 0x0B7E1517, 0x19E3779B)


def _place(first, second, lang):
    """Bit of a phrase's first and second word (0: none); numbers, arrays or columns of crc32."""
    return first * _MIX[0] + second * _MIX[1] + lang * _MIX[2]


class Bitmap:
    """A set of phrases of one or two words as hashed bits; it may hold more, never fewer."""

    def __init__(self, rows: DataFrame, words: int):
        spark = rows.sparkSession
        self.bits = min(MOST_BITS, max(15, (16 * rows.count()).bit_length()))
        part = F.split("phrase", " ")
        crc = [F.crc32(part[i]).cast("long") if i < words else F.lit(0).cast("long") for i in range(2)]
        at = F.shiftright(_place(crc[0], crc[1], F.crc32(F.col("lang")).cast("long")), 24).bitwiseAND(F.lit((1 << self.bits) - 1)) + 1  # Spark's bitmaps count from 1
        # At most 2 ** (bits - 15) rows of 4 KiB reach the driver.
        found = (rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number(F.col("at")).alias("bucket"))
                 .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("at"))).alias("bits")))
        whole = np.zeros(1 << (self.bits - 3), np.uint8)
        for r in found.toLocalIterator():
            part_bits = np.frombuffer(r["bits"], np.uint8)
            start = (r["bucket"] - 1) * 4096
            whole[start:start + len(part_bits)] = part_bits
        self.sent = spark.sparkContext.broadcast(whole)

    def has(self, first: np.ndarray, second: np.ndarray | int, lang: np.ndarray) -> np.ndarray:
        at = (_place(first, second, lang) >> 24) & ((1 << self.bits) - 1)
        return (self.sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


class Slice:
    """The words of a slice of texts: codes into a dictionary, piece and language of each."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lang: np.ndarray):
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        ends = np.zeros(256, bool)
        ends[[ord(c) for c in ENDS]] = True
        gap = ends.copy()
        gap[[9, 32]] = True
        inside, stop = ~gap[low], ends[low]
        n = len(low)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        if n:
            before[1:], after[:-1] = inside[:-1], inside[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        start = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        doc = np.searchsorted(off, start, "right") - 1
        piece = np.cumsum(stop)[start] if n else np.zeros(0, int)
        size = np.append(0, np.cumsum(end - start)).astype(np.int32)
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(size), pa.py_buffer(low[inside])).dictionary_encode()
        self.code = words.indices.to_numpy().astype(np.int64)
        self.words = words.dictionary
        #: whether the word before is of the same piece
        self.joined = np.zeros(len(start), bool)
        if len(start):
            self.joined[1:] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
        self.lang = lang[doc]

    def crc(self) -> np.ndarray:
        return np.array([zlib.crc32(w.encode()) for w in self.words.to_pylist()], np.int64) if len(self.words) else np.zeros(0, np.int64)


def _unique(keys: list[np.ndarray], bases: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``keys`` (each below its base) and their counts."""
    flat = keys[0].astype(np.int64)
    done = [flat]
    room = bases[0]
    for k, b in zip(keys[1:], bases[1:], strict=True):
        if room > (1 << 62) // max(b, 1):  # numbers would pass 63 bits: name the rows so far anew
            _, flat = np.unique(flat, return_inverse=True)
            room = int(flat.max(initial=0)) + 1
        flat, room = flat * b + k, room * b
        done.append(k)
    _, lead, count = np.unique(flat, return_index=True, return_counts=True)
    return [k[lead] for k in keys], count


def _counter(length: int, words: Bitmap | None = None, prefix: Bitmap | None = None, suffix: Bitmap | None = None):
    """A mapInArrow function that counts the phrases of ``length`` words of each slice:
    all words of ``words`` if given; for three words, their first two in ``prefix`` or
    their last two in ``suffix``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = text_buffer(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            lang_of = langs.indices.to_numpy()
            names = langs.dictionary
            name_crc = np.array([zlib.crc32(x.encode()) for x in names.to_pylist()], np.int64)
            for i, j in slices(off, SLICE):
                s = Slice(data[off[i]:off[j]], off[i:j + 1] - off[i], lang_of[i:j])
                if not len(s.code):
                    continue
                at = np.arange(len(s.code) - length + 1)
                for k in range(1, length):
                    at = at[s.joined[at + k]]
                lang = s.lang[at].astype(np.int64)
                key = [s.code[at + k] for k in range(length)]
                if words is not None or prefix is not None:
                    crc, by_lang = s.crc(), name_crc[lang]
                    if words is not None:
                        ok = np.logical_and.reduce([words.has(crc[k], 0, by_lang) for k in key])
                    else:
                        ok = prefix.has(crc[key[0]], crc[key[1]], by_lang) | suffix.has(crc[key[1]], crc[key[2]], by_lang)
                    lang, key = lang[ok], [k[ok] for k in key]
                if not len(lang):
                    continue
                (lang, *key), n = _unique([lang, *key], [len(names)] + [len(s.words)] * length)
                parts = [s.words.take(pa.array(k)) for k in key]
                phrase = parts[0] if length == 1 else pc.binary_join_element_wise(*parts, " ")
                for lo in range(0, len(n), 1 << 17):
                    cut = slice(lo, lo + (1 << 17))
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(lang[cut])).cast(pa.string()), phrase[cut].cast(pa.string()), pa.array(n[cut])], ["lang", "phrase", "n"])

    return run


def _count(texts: DataFrame, name: str, length: int, least: int, **sets: Bitmap) -> DataFrame:
    """(lang, phrase, n) of the phrases that occur ``least`` times, stored.

    Slices have added up what repeats. Of longer phrases another partial sum before the
    shuffle would save little and fill the memory, so their rows are dealt as they are:
    a frequent phrase is one row per slice at most."""
    counted = texts.mapInArrow(_counter(length, **sets), COUNTED)
    if length > 1:
        counted = counted.repartition("lang", "phrase")
    counted = counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    return stored(counted.filter(F.col("n") >= least), name)


def _div(top: Column, low: Column) -> Column:
    """floor(top / low) of two columns of 38 decimal digits."""
    return F.call_function("div", top.cast("decimal(38,0)"), low.cast("decimal(38,0)")).cast("long")


def _cut(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (left * right)), exact."""
    a, left, right = (c.cast("decimal(19,0)") for c in (a, left, right))
    return _div(a * a * F.lit(SCALE).cast("decimal(7,0)"), left * right)


def scored(phrases: DataFrame, words: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``phrases`` (of two words, or of three if ``pairs`` are given) with l, r and score."""
    part = F.split("phrase", " ")

    def count(table: DataFrame, into: str) -> DataFrame:
        return table.select(F.col("lang"), F.col("phrase").alias(f"_{into}"), F.col("n").alias(into))

    rows = phrases.select("lang", "phrase", F.col("n").alias("a"))
    if pairs is None:
        rows = rows.withColumns({"_l": part[0], "_r": part[1]})
        rows = rows.join(count(words, "l"), ["lang", "_l"]).join(count(words, "r"), ["lang", "_r"])
        return rows.select("lang", "phrase", "a", "l", "r", _cut(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    rows = rows.withColumns({"_l1": part[0], "_r1": F.concat_ws(" ", part[1], part[2]), "_l2": F.concat_ws(" ", part[0], part[1]), "_r2": part[2]})
    for table, into in ((words, "l1"), (pairs, "r1"), (pairs, "l2"), (words, "r2")):
        rows = rows.join(count(table, into), ["lang", f"_{into}"])
    cuts = [F.struct(_cut(F.col("a"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    return rows.withColumn("c", F.least(*cuts)).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def _level(rows: DataFrame, rank: int) -> DataFrame:
    """(lang, level): the ``rank``-th highest score of each language, 0 if it has fewer;
    found on counts by score, of which a language has SCALE + 1 at most."""
    by_score = rows.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy(F.desc("score")))
    reached = by_score.withColumn("upto", upto).groupBy("lang").agg(F.max(F.when(F.col("upto") >= rank, F.col("score"))).alias("level"))
    return reached.select("lang", F.coalesce("level", F.lit(0)).cast("long").alias("level"))


def _first(rows: DataFrame, top: int) -> DataFrame:
    """The first ``top`` rows of each language with their rank: first within PARTS of it."""
    order = (F.desc("score"), F.desc("a"), "phrase")
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order)))
    near = near.filter(F.col("rank") <= top).drop("_part")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def covers(phrases: DataFrame) -> DataFrame:
    """(lang, phrase, cover): the pairs inside three-word phrases and the highest count of one."""
    part = F.split("phrase", " ")
    inner = F.explode(F.array(F.concat_ws(" ", part[0], part[1]), F.concat_ws(" ", part[1], part[2])))
    return phrases.select("lang", inner.alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("cover"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, least: int = MIN_COUNT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` survivors."""
    texts = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    every = _count(texts, "words", 1, 1)
    totals = stored(every.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    words = stored(every.filter(F.col("n") >= least), "frequent-words")
    pairs = _count(texts, "pairs", 2, least, words=Bitmap(words, 1))
    # bound: no phrase behind this pair scores more.
    bound = _div(F.col("a").cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(7,0)"), F.col("l"))
    nodes = stored(scored(pairs, words).withColumn("bound", bound), "nodes")

    state = stored(_level(nodes, 2 * top).withColumn("old", F.lit(SCALE + 1).cast("long")), "levels")
    longer: DataFrame | None = None
    rank = 2 * top
    while True:
        # What reaches the level now and did not before.
        at = nodes.join(state, "lang")
        grow, inside = (stored(at.filter((F.col(c) >= F.col("level")) & (F.col(c) < F.col("old"))).select("lang", "phrase"), "frontier")
                        for c in ("bound", "score"))
        found = _count(texts, "longer", 3, least, prefix=Bitmap(grow, 2), suffix=Bitmap(inside, 2))
        if longer is not None:
            found = stored(found.unionByName(longer).groupBy("lang", "phrase").agg(F.max("n").alias("n")), "longer")
        longer = found
        triples = scored(longer, words, pairs)
        alone = nodes.join(covers(longer), ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("cover") < COVER * F.col("a"), F.lit(True)))
        both = alone.select("lang", "phrase", "a", "l", "r", "score").unionByName(triples)
        survivors = stored(both.join(state.select("lang", "level"), "lang").filter("score >= level").drop("level"), "survivors")
        enough = stored(state.join(survivors.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "lang", "left")
                        .withColumn("settled", (F.col("level") == 0) | F.coalesce(F.col("n") >= top, F.lit(False))), "settled")
        if not enough.filter("NOT settled").limit(1).count():
            break
        rank *= 4
        lower = _level(nodes, rank).withColumnRenamed("level", "_next")
        state = stored(enough.join(lower, "lang").select(
            "lang", F.when(F.col("settled"), F.col("level")).when(F.col("_next") < F.col("level"), F.col("_next")).otherwise(F.lit(0)).alias("level"),
            F.col("level").alias("old")), "levels")
    return _first(survivors, top).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
