"""Language identification by prediction by partial matching (PPM).

Each language has a context tree over the bytes of lower-cased text: the counts
of every byte after every context of 0 to ``order`` bytes. A text's code length
under a language is the exact sum, over its bytes, of the bits PPM (escape
method C, no exclusions, statistics frozen after training) needs: the longest
known context either holds the byte, or its escape is paid and the next shorter
context is asked, down to 8 bits for a byte no context knows. The language with
the shortest code wins; the score is its posterior under a uniform prior.

With frozen statistics the bits of a byte depend only on the window of
``order + 1`` bytes that ends with it, so the tree is kept as sorted tables of
windows with their bits per language, and scoring looks up windows.

Training reads a bounded sample: of each language, pieces of its texts chosen by a
hash of id and piece number up to about ``sample_bytes`` bytes; a piece is so short
(PIECE characters, a 64th of the sample) that long documents change neither that
bound nor that every language is sampled. Window counts are summed by
Spark; the model has at most ``languages * sample_bytes`` windows per order and
is what gets broadcast. Scoring reads every byte of every text.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no language was learned. Equal code lengths go to the
language first by code point. Rows are scored one by one, so repeated rows get
equal results, and other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import id_text, slices, text_buffer

UNKNOWN = "und"


class Lookup:
    """Positions in a sorted array of distinct uint64 keys: a direct table first,
    binary search for the few keys that share a slot."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(len(keys) * 8).bit_length())
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self._at(keys)] = np.arange(len(keys))

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where it is not known."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        pos = self.slot[self._at(keys)].astype(np.int64)
        rest = np.flatnonzero(self.keys[pos] != keys)
        if len(rest):
            p = np.minimum(np.searchsorted(self.keys, keys[rest]), len(self.keys) - 1)
            pos[rest] = np.where(self.keys[p] == keys[rest], p, -1)
        return pos


class Level(NamedTuple):
    """One order of the trees: windows with their bits, contexts with their escape bits."""

    windows: np.ndarray
    bits: np.ndarray
    contexts: np.ndarray
    escape: np.ndarray


class PpmModel(NamedTuple):
    langs: list[str]
    order: int
    levels: list[Level]


def padded(text: Column, order: int) -> Column:
    """Lower-cased text after ``order`` line ends, so each byte has a full context."""
    return F.concat(F.lit("\n" * order), F.lower(text))


def windows(data: np.ndarray, order: int) -> np.ndarray:
    """The window of ``order + 1`` bytes that ends at each byte, as one integer."""
    out = data.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= data[:-k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.asarray(batch.column(0))
            data, off = text_buffer(batch.column(1))
            for i, j in slices(off):
                part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
                if not len(part):
                    continue
                win = windows(part, order)
                real = np.ones(len(part), bool)
                for k in range(order):
                    real[np.minimum(o[:-1] + k, len(part) - 1)] = False
                owner = np.repeat(lang[i:j], np.diff(o))
                for one in np.unique(lang[i:j]):
                    key, n = np.unique(win[real & (owner == one)], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(key), one, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
                        ["lang", "win", "n"])
    return run


PIECE = 4096


def train(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = 3,
          sample_bytes: int = 1 << 20) -> PpmModel:
    """Learn the trees from rows whose text and language are not null.

    ``order`` is at most 7 (a window fits 64 bits); ``sample_bytes`` bounds the
    text read per language.
    """
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"),
                       id_text().alias("id")).filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["b"] or 0 for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    langs = sorted(sizes)
    if not langs:
        return PpmModel([], order, [])
    pairs = [F.lit(x) for i, la in enumerate(langs) for x in (la, i)]
    limit = [F.lit(x) for la in langs for x in (la, int(min(1.0, sample_bytes / max(sizes[la], 1)) * (1 << 20)) + 1)]
    size = max(1, min(PIECE, sample_bytes // 64))
    every = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1))
    drawn = rows.withColumn("pieces", F.filter(every, lambda i: F.pmod(F.xxhash64("id", i), F.lit(1 << 20)) < F.create_map(*limit)[F.col("lang")]))
    sample = drawn.select("lang", F.explode(F.transform("pieces", lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))).alias("text")).select(
        F.create_map(*pairs)[F.col("lang")].cast("int").alias("lang"), padded(F.col("text"), order).alias("text"))
    counts = (sample.mapInArrow(_count(order), "lang int, win long, n long").groupBy("lang", "win")
              .agg(F.sum("n").alias("n")).toArrow())
    win = np.asarray(counts["win"]).view(np.uint64)
    return PpmModel(langs, order, _levels(np.asarray(counts["lang"]), win, np.asarray(counts["n"]), len(langs), order))


def _table(lang: np.ndarray, key: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(key, return_inverse=True)
    out = np.zeros((len(keys), size), np.float64)
    np.add.at(out, (at, lang), n)
    return keys, out


def _levels(lang: np.ndarray, win: np.ndarray, n: np.ndarray, size: int, order: int) -> list[Level]:
    """Tables of order 0, 1, ... ``order``; each gives the whole code length of its windows."""
    levels: list[Level] = []
    for k in range(order + 1):
        keys, seen = _table(lang, win & np.uint64((1 << 8 * (k + 1)) - 1), n, size)
        ctx, at = np.unique(keys >> np.uint64(8), return_inverse=True)
        total, kinds = np.zeros((len(ctx), size)), np.zeros((len(ctx), size))
        np.add.at(total, at, seen)
        np.add.at(kinds, at, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            held = -np.log2(seen / (total + kinds)[at])
        lower = code_length(keys & np.uint64((1 << 8 * k) - 1), levels, size) if k else np.full((len(keys), size), 8.0)
        levels.append(Level(keys, np.where(seen > 0, held, escape[at] + lower), ctx, escape))
    return levels


def code_length(win: np.ndarray, levels: list[Level], size: int, find: list | None = None) -> np.ndarray:
    """Bits of the last byte of each window under every language."""
    find = find or [(Lookup(x.windows), Lookup(x.contexts)) for x in levels]
    out = np.zeros((len(win), size))
    rest = np.arange(len(win))
    for k in range(len(levels) - 1, -1, -1):
        key = win[rest] & np.uint64((1 << 8 * (k + 1)) - 1)
        pos = find[k][0].find(key)
        hit = pos >= 0
        out[rest[hit]] += levels[k].bits[pos[hit]]
        rest, key = rest[~hit], key[~hit]
        if not len(rest):
            return out
        pos = find[k][1].find(key >> np.uint64(8))
        known = pos >= 0
        out[rest[known]] += levels[k].escape[pos[known]]
    out[rest] += 8.0
    return out


RESULT = "lang string, score double, bits_per_byte double"
_TYPE = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])


def text_bits(col: pa.Array, model: PpmModel, find: list) -> tuple[np.ndarray, np.ndarray]:
    """Code length of each text under each language, and the bytes it counts."""
    data, off = text_buffer(col)
    size, order = len(model.langs), model.order
    total = np.zeros((len(off) - 1, size))
    for i, j in slices(off):
        o = off[i:j + 1] - off[i]
        part = data[off[i]:off[j]]
        if not len(part):
            continue
        cost = np.empty((len(part), size))
        win = windows(part, order)
        for a in range(0, len(part), 1 << 18):  # a very long text is scored piece by piece
            cost[a:a + (1 << 18)] = code_length(win[a:a + (1 << 18)], model.levels, size, find)
        filled = np.flatnonzero(np.diff(o) > 0)
        for k in range(order):
            cost[np.minimum(o[filled] + k, o[filled + 1] - 1)] = 0
        total[i + filled] += np.add.reduceat(cost, o[filled], axis=0)
    return total, np.maximum(np.diff(off) - order, 0)


def predict(docs: DataFrame, model: PpmModel, text: str = "text", into: str = "_ppm") -> DataFrame:
    """``docs`` with a struct column ``into``: lang, score, bits_per_byte."""
    if not model.langs:
        nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("bits_per_byte"))
        return docs.withColumn(into, nothing)
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf(RESULT)
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = PpmModel(*shared.value)
        find = [(Lookup(x.windows), Lookup(x.contexts)) for x in m.levels]
        names = np.array(m.langs, object)
        for col in parts:
            bits, n = text_bits(col, m, find)
            best = bits.argmin(axis=1) if len(bits) else np.zeros(0, int)
            low = bits[np.arange(len(bits)), best]
            odds = np.exp2(np.maximum(low[:, None] - bits, -1000.0)).sum(axis=1)
            known = n > 0
            per = np.where(known, low / np.maximum(n, 1), np.nan)
            yield pa.StructArray.from_arrays(
                [pa.array(np.where(known, names[best], UNKNOWN) if len(best) else [], pa.string()),
                 pa.array(np.where(known, 1.0 / odds, 0.0)), pa.array(per, from_pandas=True)], fields=list(_TYPE))

    # Texts without a letter are decided here and not sent to Python.
    usable = F.when(F.col(text).rlike(r"\p{L}"), padded(F.col(text), model.order))
    return docs.withColumn(into, score(usable))


def accepted(result: str = "_ppm", most_bits: float = 8.0) -> Column:
    """A text some learned language predicts better than ``most_bits`` bits a byte
    (8: the plain bytes), that is, one written in a learned language."""
    r = F.col(result)
    return (r["lang"] != UNKNOWN) & (r["bits_per_byte"] < F.lit(most_bits))


def language_filter(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in a learned language, with their columns unchanged."""
    return predict(docs, train(docs), into="_ppm_result").filter(accepted("_ppm_result")).drop("_ppm_result")
