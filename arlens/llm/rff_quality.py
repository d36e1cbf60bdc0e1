"""Quality scores by ridge regression on random Fourier features.

1. One pass turns every whole text into a vector of document statistics (length,
   word shape, symbols, capitals, repetition of words, lines and 5-word runs).
2. The statistics, standardised on the fitting rows and clipped at +-CLIP, go
   through FEATURES random Fourier features sqrt(2/FEATURES) * cos(Wx + b) with W
   from a Gaussian of width WIDTH: their inner products approximate a Gaussian
   kernel.
3. Each partition sums its normal equations (Z'Z, Z'y); Spark adds these sums
   entry by entry, and the driver solves one system of FEATURES + 1 unknowns. All
   labelled rows of the fitting part count, there is no sample.
4. Isotonic calibration on the other labelled rows: scores are binned on a fixed
   grid, Spark counts rows and labels per bin, pool-adjacent-violators makes the
   means monotone, and a text's score is read off by linear interpolation.

Everything random is drawn from a fixed seed. The driver sees sums and at most
(HIGH - LOW) / BIN bins, whatever the number of rows.

Defined results: an empty or null text has the statistics of no words and is
scored like any other. Without labelled rows every score is 0.5; with labels of
one kind it is that label. A doc_id with several labels has the lowest; a null
label is no label. Repeated rows score alike; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import Words, byte_set, id_text, mix64, slices, stored, text_buffer
from arlens.llm.order_minhash import grams_of

STATISTICS = ["log_words", "log_bytes_per_line", "word_bytes", "symbols", "capitals", "digits", "marks", "exclaims", "not_ascii",
              "repeated_lines", "distinct_words", "repeated_runs", "top_word", "stutter", "capital_words", "symbol_words"]
FEATURES = 256
WIDTH = 4.0
CLIP = 6.0
RIDGE = 1.0
SEED = 29
FIT_PARTS = 16
LOW, HIGH, BIN = -1.0, 2.0, 1 / 400


class QualityModel(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray     # of the Fourier features, and the intercept last
    knots: np.ndarray       # raw scores
    levels: np.ndarray      # calibrated scores at the knots


def _per_text(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of a byte mask over each text."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    return total[off[1:]] - total[off[:-1]]


def _groups(doc: np.ndarray, key: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, largest count) per text, and for each entry its count and rank among equals."""
    mixed = key + mix64(doc.astype(np.uint64) + np.uint64(5))
    _, first, at, n = np.unique(mixed, return_index=True, return_inverse=True, return_counts=True)
    most = np.zeros(texts, np.int64)
    np.maximum.at(most, doc[first], n)
    return np.bincount(doc[first], minlength=texts), most, n[at], first[at]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """STATISTICS of each text (texts x statistics)."""
    texts = len(off) - 1
    w = Words(data, off, byte_set("space"))
    n = np.diff(w.first)
    some, size = np.maximum(n, 1), np.maximum(np.diff(off), 1)
    table = np.zeros((5, 256), bool)
    table[0, list(b"#*$%&|<>")] = True
    table[1, 65:91] = True
    table[2, 48:58] = True
    table[3, list(b".,;:?")] = True
    table[4, 33] = True
    shares = [_per_text(row[data], off) / size for row in table]
    not_ascii = _per_text(data >= 0x80, off) / size
    lines = 1 + _per_text(data == 10, off)
    word = w.words()
    distinct, most, _, _ = _groups(w.doc, word, texts)
    stutter = np.zeros(texts)
    if len(word) > 1:
        same = (word[1:] == word[:-1]) & (w.doc[1:] == w.doc[:-1])
        stutter = np.bincount(w.doc[1:][same], minlength=texts) / some
    place = np.arange(len(word)) - w.first[w.doc] if len(word) else np.zeros(0, int)
    whole = place + 5 <= n[w.doc]
    run = grams_of(word, w.doc, 5)[whole]
    _, _, count, _ = _groups(w.doc[whole], run, texts)
    cover = np.zeros(len(word) + 5, np.int64)
    begin = np.flatnonzero(whole)[count > 1]
    for k in range(5):
        cover[begin + k] = 1
    repeated = np.bincount(w.doc, weights=cover[:len(word)], minlength=texts) / some
    # Lines, cut at line ends; an empty line doesn't count.
    table10 = np.ones(256, bool)
    table10[10] = False
    line = Words(data, off, table10)
    line_distinct, _, _, _ = _groups(line.doc, line.words(), texts)
    line_count = np.diff(line.first)
    begins = data[w.start] if len(word) else data[:0]
    ends = data[w.end - 1] if len(word) else data[:0]
    capital = np.bincount(w.doc[(begins >= 65) & (begins <= 90)], minlength=texts) / some
    symbol = np.bincount(w.doc[table[0][ends] | (ends == 33)], minlength=texts) / some
    chars = _per_text((data & 0xC0) != 0x80, off)
    return np.stack([np.log1p(n), np.log1p(chars / lines), np.minimum(np.diff(off) / some, 60), *shares, not_ascii,
                     1 - line_distinct / np.maximum(line_count, 1), distinct / some, repeated, most / some, stutter, capital, symbol], axis=1)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, off = text_buffer(batch.column(0))
        for i, j in slices(off):
            x = statistics(data[off[i]:off[j]], off[i:j + 1] - off[i])
            lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns[1:]), lists], [*batch.schema.names[1:], "_x"])


def measured(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the statistics vector ``_x`` of every row, stored."""
    rows = docs.select(F.col(text).alias("_t"), *keep)
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[1:]) + ", _x array<double>"
    return stored(rows.mapInArrow(_measure, schema), "statistics")


def _matrix(col: pa.Array) -> np.ndarray:
    values = col.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(col), -1) if len(col) else values.reshape(0, len(STATISTICS))


def fourier(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Random Fourier features of statistics, with a 1 for the intercept."""
    rng = np.random.default_rng(SEED)
    w = rng.normal(size=(len(STATISTICS), FEATURES)) / WIDTH
    b = rng.uniform(0, 2 * np.pi, FEATURES)
    z = np.sqrt(2 / FEATURES) * np.cos(np.clip((x - mean) / scale, -CLIP, CLIP) @ w + b)
    return np.hstack((z, np.ones((len(x), 1))))


def _normal_equations(mean: np.ndarray, scale: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        rows = 0
        for batch in batches:
            z = fourier(_matrix(batch.column(0)), mean, scale)
            y = np.asarray(batch.column(1), float)
            total += z.T @ np.hstack((z, y[:, None]))
            rows += len(y)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], ["sums"])
    return run


def _raw(model: QualityModel, x: np.ndarray) -> np.ndarray:
    return fourier(x, model.mean, model.scale) @ model.weights


def _bins(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = QualityModel(*shared.value)
        for batch in batches:
            raw = np.clip(_raw(model, _matrix(batch.column(0))), LOW, HIGH)
            yield pa.RecordBatch.from_arrays([pa.array(np.floor((raw - LOW) / BIN).astype(np.int32)), pa.array(raw), batch.column(1)], ["bin", "raw", "label"])
    return run


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block centres and their means, for rising x."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, n, strict=True):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            top = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def train(rows: DataFrame, labels: DataFrame, label: str = "quality") -> QualityModel:
    """Fit on ``rows`` (doc_id and ``_x`` from ``measured``) that ``labels`` covers."""
    sc = rows.sparkSession.sparkContext
    zero, one = np.zeros(len(STATISTICS)), np.ones(len(STATISTICS))
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    part = F.pmod(F.xxhash64(F.concat(F.lit("rff/"), id_text())), F.lit(5 * FIT_PARTS))
    both = stored(rows.join(known, "doc_id").select("_x", "label", part.alias("part"))
                  .repartition(FIT_PARTS, F.pmod("part", F.lit(FIT_PARTS))), "quality-rows")
    fit, rest = both.filter(F.col("part") >= FIT_PARTS), both.filter(F.col("part") < FIT_PARTS)
    cols = [F.col("_x")[i] for i in range(len(STATISTICS))]
    row = fit.agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols], F.avg("label"), F.min("label"), F.max("label")).first()
    k = len(STATISTICS)
    if row[2 * k] is None or row[2 * k + 1] == row[2 * k + 2]:
        share = 0.5 if row[2 * k] is None else float(row[2 * k])
        return QualityModel(zero, one, np.zeros(FEATURES + 1), np.array([0.0]), np.array([share]))
    mean, scale = np.array(row[:k], float), np.maximum(np.array(row[k:2 * k], float), 1e-6)
    sums = (fit.select("_x", "label").mapInArrow(_normal_equations(mean, scale), "sums array<double>")
            .select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toArrow())
    total = np.zeros((FEATURES + 1) * (FEATURES + 2))
    total[np.asarray(sums["i"])] = np.asarray(sums["v"])
    total = total.reshape(FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * np.eye(FEATURES + 1)
    penalty[-1, -1] = 0
    model = QualityModel(mean, scale, np.linalg.solve(total[:, :-1] + penalty, total[:, -1]), np.array([0.0]), np.array([float(row[2 * k])]))
    bins = (rest.select("_x", "label").mapInArrow(_bins(sc.broadcast(tuple(model))), "bin int, raw double, label int").groupBy("bin")
            .agg(F.avg("raw").alias("raw"), F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect())
    if not bins:
        return model._replace(knots=np.array([0.0, 1.0]), levels=np.array([0.0, 1.0]))
    knots, levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("raw", "y", "n")))
    return model._replace(knots=knots, levels=levels)


def score(rows: DataFrame, model: QualityModel, into: str = "_quality") -> DataFrame:
    """``rows`` (with ``_x``) with the calibrated score ``into``, 0 to 1."""
    shared = rows.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = QualityModel(*shared.value)
        for col in parts:
            yield pa.array(np.clip(np.interp(_raw(m, _matrix(col)), m.knots, m.levels), 0.0, 1.0))

    return rows.withColumn(into, run("_x"))
