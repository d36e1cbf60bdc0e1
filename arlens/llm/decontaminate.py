"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Every test item gives the runs of SEED_WORDS words it holds (lower-cased
   letters and digits). One pass over all documents counts in how many documents
   each of these runs occurs.
2. An alignment of score S has at least S - 1 pairs of neighbouring matches (every
   edit parts at most one more), so a leak of an item of n words shares
   ceil(MIN_SCORE * n) - 1 of the item's n - 1 run places. Any choice that leaves out
   fewer than that, less h, is met in h places: the seeds are the rarest runs that
   make up such a choice for h = MIN_HITS (or as many as a leak must share). Rarity
   only decides which places are chosen, so no leak is lost by it, whichever runs an
   edit broke and however often an item leaked.
3. A second pass finds the places where seeds occur. An alignment that scores
   MIN_SCORE spans at most 2 - MIN_SCORE times the item; places closer together than
   that for the longest item form a passage, widened by as much on both sides.
   Passages meet items through their seeds; a pair needs h of the item's seed places.
4. Smith-Waterman aligns item and passage word by word (match 1, mismatch and gap
   -1). The score over the item's length says how much of the item the passage
   holds, net of edits; from MIN_SCORE on the pair is a leak.

In both passes a bit table of fixed size (2**FILTER_BITS bits) keeps runs that
no item has from leaving the task; it may let a few others through, and the joins
that follow are exact, so results do not depend on it. Items, runs and passages
are joined, not broadcast.

Result of ``leaks``: one row per (document, item) that leaks: doc_id, text_hash,
item_id, score, start and end (word places in the document, of its best passage).

Defined results: null or wordless texts and items never match; an item shorter
than SHORT_WORDS words has one seed, its whole word list, and meets only texts of
exactly those words; items of equal words
each get their own rows; documents that repeat get equal rows each; empty tables
give no rows; other columns are ignored. Memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import Words, byte_set, fold_case, mix64, slices, stored, text_buffer
from arlens.llm.order_minhash import grams_of

SEED_WORDS = 2
SHORT_WORDS = 3
MIN_HITS = 2
MIN_SCORE = 0.5
FILTER_BITS = 24


def _tokens(data: np.ndarray, off: np.ndarray) -> tuple[Words, np.ndarray]:
    w = Words(fold_case(data), off, byte_set("letters"))
    return w, w.words()


def _runs(word: np.ndarray, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word it starts at, whether it stands for a whole short text) of every
    run, by place: a text under SHORT_WORDS words has itself as a run besides."""
    n = np.diff(w.first)[w.doc]
    place = np.arange(len(word)) - w.first[w.doc]
    run = grams_of(word, w.doc, SEED_WORDS)
    inner = np.flatnonzero(place + SEED_WORDS <= n)
    whole = np.flatnonzero((place == 0) & (n < SHORT_WORDS))
    at = np.concatenate((inner, whole))
    order = np.argsort(at, kind="stable")
    key = np.concatenate((run[inner], mix64(run[whole] + np.uint64(0xA24BAED4963EE407))))
    return key[order], at[order], (np.arange(len(at)) >= len(inner))[order]


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        w, word = _tokens(data, off)
        run, at, whole = _runs(word, w)
        own = whole == (np.diff(w.first)[w.doc[at]] < SHORT_WORDS)
        run, cut = run[own], np.searchsorted(at[own], w.first)
        pick = [i for i in range(len(off) - 1) if w.first[i + 1] > w.first[i]]
        count = [np.unique(run[cut[i]:cut[i + 1]], return_counts=True) for i in pick]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(pick, pa.int64())),
             pa.array([word[w.first[i]:w.first[i + 1]].view(np.int64) for i in pick], pa.list_(pa.int64())),
             pa.array([key.view(np.int64) for key, _ in count], pa.list_(pa.int64())),
             pa.array([n.astype(np.int64) for _, n in count], pa.list_(pa.int64()))],
            ["item_id", "words", "runs", "places"])


def bit_table(runs: DataFrame) -> np.ndarray:
    """2**FILTER_BITS bits, set at the hashes of ``runs``: the only thing about
    them that is broadcast. Tasks send set byte places; the driver's array is fixed."""
    table = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    slot = F.shiftrightunsigned("run", 64 - FILTER_BITS)
    bits = (runs.select(F.shiftright(slot, 3).alias("byte"), (slot % 8).alias("bit")).distinct()
            .groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, int(bit))")).alias("v")))
    got = bits.toArrow()
    table[np.asarray(got["byte"])] = np.asarray(got["v"]).astype(np.uint8)
    return table


def _set(table: np.ndarray, run: np.ndarray) -> np.ndarray:
    slot = run >> np.uint64(64 - FILTER_BITS)
    return (table[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _seen(shared):
    """(run, docs): in how many texts of a slice each run of the bit table occurs."""
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            for i, j in slices(off):
                w, word = _tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                run, at, _ = _runs(word, w)
                hit = _set(table, run)
                run, doc = run[hit], w.doc[at[hit]].astype(np.uint64)
                pair = np.unique(np.stack((run, doc)), axis=1)[0] if len(run) else run
                key, n = np.unique(pair, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], ["run", "docs"])
    return run_


def _passages(shared, reach: int):
    """Passages around the seeds of each text; no alignment spans over ``reach`` words."""
    def run_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data, off = text_buffer(batch.column(2))
            for i, j in slices(off):
                w, word = _tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                run, at, _ = _runs(word, w)
                seed = _set(table, run)
                run, hit = run[seed], at[seed]
                if not len(hit):
                    continue
                cut = np.flatnonzero((np.diff(hit) > reach) | (np.diff(w.doc[hit]) > 0)) + 1
                lo, hi = hit[np.append(0, cut)], hit[np.append(cut, len(hit)) - 1]
                doc = w.doc[lo]
                a = np.maximum(lo - reach, w.first[doc])
                b = np.minimum(hi + reach + SEED_WORDS, w.first[doc + 1])
                seeds = np.split(run, cut)
                who = pa.array(doc + i, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(who), batch.column(1).take(who), pa.array(a - w.first[doc], pa.int64()),
                     pa.array([word[x:y].view(np.int64) for x, y in zip(a, b, strict=True)], pa.list_(pa.int64())),
                     pa.array([np.unique(x).view(np.int64) for x in seeds], pa.list_(pa.int64()))],
                    ["doc_id", "text_hash", "start", "words", "seeds"])
    return run_


def best_local(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman over padded pairs (0 pads left, 1 pads right): the best score,
    and the first row and column (ends, exclusive) that reach it."""
    pairs, width = len(left), right.shape[1]
    steps = np.arange(width + 1, dtype=np.int32)
    row = np.zeros((pairs, width + 1), np.int32)
    best, end_left, end_right = (np.zeros(pairs, np.int64) for _ in range(3))
    for i in range(left.shape[1]):
        new = np.zeros_like(row)
        np.add(row[:, :-1], np.where(left[:, i:i + 1] == right, 1, -1), out=new[:, 1:])
        np.maximum(new, row - 1, out=new)
        np.maximum(new, 0, out=new)
        new = np.maximum.accumulate(new + steps, axis=1) - steps
        at = new.argmax(axis=1)
        top = new[np.arange(pairs), at]
        better = top > best
        best[better], end_left[better], end_right[better] = top[better], i + 1, at[better]
        row = new
    return best, end_left, end_right


def _pad(lists: list[np.ndarray], value: int) -> np.ndarray:
    out = np.full((len(lists), max(map(len, lists))), value, np.uint64)
    for i, x in enumerate(lists):
        out[i, :len(x)] = x
    return out


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(col: pa.Array) -> list[np.ndarray]:
        return [np.asarray(x.values).view(np.uint64) for x in col]

    for batch in batches:
        names = batch.schema.names
        item, passage = rows(batch.column(names.index("item_words"))), rows(batch.column(names.index("words")))
        order = sorted(range(len(item)), key=lambda i: (len(passage[i]), len(item[i])))
        score, begin, end = np.zeros(len(item)), np.zeros(len(item), np.int64), np.zeros(len(item), np.int64)
        k = 0
        while k < len(order):
            j = k + 1
            while j < len(order) and (j - k + 1) * len(passage[order[j]]) <= 1 << 15:
                j += 1
            group = order[k:j]
            k = j
            left, right = [item[i] for i in group], [passage[i] for i in group]
            best, to_left, to_right = best_local(_pad(left, 0), _pad(right, 1))
            score[group] = best / np.array([len(x) for x in left])
            end[group] = to_right
            # The reversed sequences before the end give the start of the same alignment.
            back = [x for x in range(len(group)) if score[group[x]] >= MIN_SCORE]
            if back:
                _, _, length = best_local(_pad([left[x][:to_left[x]][::-1] for x in back], 0),
                                          _pad([right[x][:to_right[x]][::-1] for x in back], 1))
                for x, n in zip(back, length, strict=True):
                    begin[group[x]] = to_right[x] - n
        start = np.asarray(batch.column(names.index("start")))
        keep = pa.array(score >= MIN_SCORE)
        yield pa.RecordBatch.from_arrays(
            [batch.column(names.index(c)).filter(keep) for c in ("doc_id", "text_hash", "item_id")]
            + [pa.array(score).filter(keep), pa.array(start + begin).filter(keep), pa.array(start + end).filter(keep)],
            ["doc_id", "text_hash", "item_id", "score", "start", "end"])


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, score, start, end) of every leak."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    items = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col(item_text).alias("text"))
                   .mapInArrow(_items, "item_id long, words array<long>, runs array<long>, places array<long>")
                   .withColumn("item", F.xxhash64("item_id", "words")), "items")
    runs = (items.select("item", F.size("words").alias("n"), F.explode(F.arrays_zip("runs", "places")).alias("r"))
            .select("item", "n", F.col("r.runs").alias("run"), F.col("r.places").alias("places")))
    longest = items.agg(F.max(F.size("words"))).first()[0] or 0
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("text"))

    every = sc.broadcast(bit_table(runs.select("run")))
    seen = texts.select("text").mapInArrow(_seen(every), "run long, docs long").groupBy("run").agg(F.sum("docs").alias("docs"))
    shared = F.greatest(F.lit(1), F.ceil(F.lit(MIN_SCORE) * F.col("n")) - 1)
    rank = Window.partitionBy("item").orderBy(F.coalesce("docs", F.lit(0)), "run")
    before = F.sum("places").over(rank.rowsBetween(Window.unboundedPreceding, -1))
    size = F.sum("places").over(Window.partitionBy("item"))
    seeds = stored(runs.join(seen, "run", "left").withColumn("need", F.least(shared, F.lit(MIN_HITS)))
                   .withColumn("before", F.coalesce(before, F.lit(0))).withColumn("of", size)
                   .filter(F.col("before") < F.col("of") - shared + F.col("need"))
                   .select("item", "run", "places", "need"), "seeds")

    rare = sc.broadcast(bit_table(seeds.select("run")))
    passages = stored(texts.mapInArrow(_passages(rare, int((2 - MIN_SCORE) * longest)), "doc_id long, text_hash long, start long, words array<long>, seeds array<long>")
                      .withColumn("passage", F.xxhash64("doc_id", "text_hash", "start")), "passages")
    pairs = (passages.select("passage", F.explode("seeds").alias("run")).distinct().join(seeds, "run")
             .groupBy("passage", "item").agg(F.sum("places").alias("hits"), F.max("need").alias("need")).filter("hits >= need"))
    both = (pairs.select("passage", "item").join(passages.drop("seeds"), "passage")
            .join(items.select("item", "item_id", F.col("words").alias("item_words")), "item"))
    found = both.drop("passage", "item").mapInArrow(
        _align, "doc_id long, text_hash long, item_id long, score double, start long, end long")
    best = F.max(F.struct("score", (-F.col("start")).alias("s"), "end")).alias("b")
    return found.groupBy("doc_id", "text_hash", "item_id").agg(best).select(
        "doc_id", "text_hash", "item_id", F.col("b.score").alias("score"), (-F.col("b.s")).alias("start"), F.col("b.end").alias("end"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a leak; columns unchanged."""
    bad = stored(leaks(docs, benchmark, text).select(F.col("doc_id").alias("_leak_id"), F.col("text_hash").alias("_leak_hash")).distinct(), "leaked")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["_leak_id"]) & (F.xxhash64(docs[text]) == F.col("_leak_hash")), "left_anti")
