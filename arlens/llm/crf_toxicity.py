"""Toxic spans by a linear-chain conditional random field (CRF).

Tokens are runs of letters and digits (case folded), a sequence is a line. The
CRF has two tags (clean, toxic), weights for hashed token features (word, its
beginnings and ending, the words beside it) and for the four tag transitions.

Training uses a bounded sample of labelled documents (about ``sample_docs``,
chosen by a hash of the id), split into a fitting and a calibrating part:

1. Labelled tokens: in how many toxic and clean documents of the fitting part
   each feature occurs is counted by Spark. A token of a toxic document is
   tagged toxic if its word or a beginning of it is significantly more frequent
   in toxic documents (likelihood ratio G at a level that lets CHANCE_FINDS
   features pass by chance, odds >= MIN_ODDS, at least MIN_DOCS of them); every other token is clean.
2. The CRF is fitted by iterative parameter mixing: in each round every part of
   the sample runs one pass of Adagrad on the log likelihood from the shared
   weights, and the rounds' weights are averaged per feature.
3. Forward-backward gives each token's marginal probability of being toxic. A
   logistic function of a document's marginals (expected number, largest,
   share, length), fitted on the calibrating part, is the document's score.

Scoring reads every whole text in slices and returns the score and the offending
spans: runs of tokens of one line with marginals of at least a half, as offsets
in code points.

Defined results: a text without tokens (null, empty, symbols only) gets the
score of a document with no toxic token, and no spans. Without labelled rows, or
with labels of one kind only, every score is the share of toxic labels (0
without any). A doc_id with several labels counts as toxic if one says so; a
null label is no label. Repeated rows score alike; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import Words, byte_set, fold_case, id_text, mix64, slices, stored, text_buffer

FEATURE_BITS = 20
BEGINNINGS = (4, 5, 6, 7)
ENDING = 4
MIN_ODDS, MIN_DOCS = 4.5, 3
CHANCE_FINDS = 5  # features that pass the test by chance, about, whatever the number tested
PARTS = 12
ROUNDS = 4
BATCH_BYTES = 1 << 16


class CrfModel(NamedTuple):
    weights: np.ndarray      # of features; 0 is no feature
    moves: np.ndarray        # log potentials of (tag, next tag)
    bias: float
    document: np.ndarray     # of the logistic function over a document's marginals


class Tokens(NamedTuple):
    words: Words
    data: np.ndarray
    sequence: np.ndarray     # first token of each sequence, and the end
    features: np.ndarray     # tokens x features
    own: int                 # the first ``own`` features belong to the word itself


def tokens(data: np.ndarray, off: np.ndarray) -> Tokens:
    folded = fold_case(data)
    w = Words(folded, off, byte_set("letters"))
    n = len(w.start)
    shift = np.uint64(64 - FEATURE_BITS)
    word = w.words(1)
    cols = [word >> shift]
    for k in BEGINNINGS:
        cols.append(np.where(w.end - w.start > k, w.hash(w.start, np.minimum(w.start + k, w.end), 10 + k) >> shift, 0))
    own = len(cols)
    cols.append(np.where(w.end - w.start > ENDING, w.hash(np.maximum(w.end - ENDING, w.start), w.end, 2) >> shift, 0))
    lines = np.cumsum(data == 10)
    new = np.ones(n, bool)
    if n:
        new[1:] = (w.doc[1:] != w.doc[:-1]) | (lines[w.start[1:]] != lines[w.start[:-1]])
    before, after = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    if n > 1:
        same = ~new[1:]
        before[1:] = np.where(same, mix64(word[:-1] + np.uint64(3)) >> shift, 0)
        after[:-1] = np.where(same, mix64(word[1:] + np.uint64(4)) >> shift, 0)
    features = np.stack([*cols, before, after], axis=1).astype(np.int32)
    return Tokens(w, data, np.append(np.flatnonzero(new), n), features, own)


def forward_backward(energy: np.ndarray, sequence: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic tag for every token, and the expected number of each
    move (tag, next tag) summed over all. ``energy``: log potential of toxic."""
    n = len(energy)
    marginal, expected = np.zeros(n), np.zeros((2, 2))
    if not n:
        return marginal, expected
    size = np.diff(sequence)
    order = np.argsort(-size, kind="stable")
    k = 0
    move = np.exp(moves)
    heat = np.exp(np.clip(energy, -30, 30))
    while k < len(order):
        longest = size[order[k]]
        j = min(len(order), k + max(1, (1 << 18) // int(longest)))
        group = order[k:j]
        k = j
        start, count = sequence[group], size[group]
        live = [int(x) for x in np.searchsorted(-count, -np.arange(longest), "left")]
        a = np.zeros((longest, len(group)))  # share of toxic after each token
        hot = heat[start]
        a[0] = hot / (1 + hot)
        for t in range(1, longest):
            m = live[t]
            p = a[t - 1, :m]
            one = ((1 - p) * move[0, 1] + p * move[1, 1]) * heat[start[:m] + t]
            a[t, :m] = one / (one + (1 - p) * move[0, 0] + p * move[1, 0])
        b = np.full(len(group), 0.5)  # share of toxic in what follows
        for t in range(longest - 1, -1, -1):
            m = live[t]
            if t + 1 < longest:
                q = live[t + 1]
                hot = heat[start[:q] + t + 1]
                nxt = b[:q]
                p = a[t, :q]
                joint = np.stack([(1 - p) * move[0, 0] * (1 - nxt), (1 - p) * move[0, 1] * hot * nxt,
                                  p * move[1, 0] * (1 - nxt), p * move[1, 1] * hot * nxt])
                expected += (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
                one = move[1, 0] * (1 - nxt) + move[1, 1] * hot * nxt
                zero = move[0, 0] * (1 - nxt) + move[0, 1] * hot * nxt
                b[:q] = one / (one + zero)
            p, r = a[t, :m], b[:m]
            marginal[start[:m] + t] = p * r / (p * r + (1 - p) * (1 - r))
    return marginal, expected


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean): in how many documents of each kind it occurs."""
    size = 1 << FEATURE_BITS
    kinds = np.zeros((2, size), np.int64)
    for batch in batches:
        label = np.asarray(batch.column(1))
        data, off = text_buffer(batch.column(0))
        for i, j in slices(off):
            t = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
            pair = np.unique((t.words.doc[:, None].astype(np.int64) * size + t.features[:, :t.own]).ravel())
            for kind in (0, 1):
                kinds[kind] += np.bincount((pair % size)[label[i + pair // size] == kind], minlength=size)
    kinds[:, 0] = 0
    some = np.flatnonzero(kinds.sum(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(kinds[1][some]), pa.array(kinds[0][some])], ["feature", "toxic", "clean"])


def toxic_features(feature: np.ndarray, toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Flags (by feature) of those that mark a toxic document."""
    flags = np.zeros(1 << FEATURE_BITS, bool)
    n = n_toxic + n_clean
    seen = toxic + clean
    with np.errstate(divide="ignore", invalid="ignore"):
        g = sum(np.where(o > 0, 2 * o * np.log(o * n / (seen_ * part)), 0.0) for o, seen_, part in (
            (toxic, seen, n_toxic), (clean, seen, n_clean), (n_toxic - toxic, n - seen, n_toxic), (n_clean - clean, n - seen, n_clean)))
    odds = (toxic + 0.5) / (n_toxic + 1) / ((clean + 0.5) / (n_clean + 1))
    least = 2 * np.log(max(len(feature) / CHANCE_FINDS, 150))
    flags[feature[(g >= least) & (odds >= MIN_ODDS) & (toxic >= MIN_DOCS)]] = True
    return flags


def _pass(shared):
    """One Adagrad pass over a part of the sample; the change of every touched weight."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags, weights, moves, bias = shared.value
        w, m, c = weights.astype(np.float64), moves.copy(), bias
        sq_w, sq_m, sq_c = np.full(len(w), 1e-6), np.full((2, 2), 1e-6), 1e-6
        touched = np.zeros(len(w), bool)
        for batch in batches:
            label = np.asarray(batch.column(1))
            data, off = text_buffer(batch.column(0))
            for i, j in slices(off, BATCH_BYTES):
                t = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                if not len(t.features):
                    continue
                y = (flags[t.features[:, :t.own]].any(axis=1) & (label[i + t.words.doc] == 1)).astype(np.int64)
                p, expected = forward_backward(w[t.features].sum(axis=1) + c, t.sequence, m)
                inside = np.ones(len(y) - 1, bool)
                inside[t.sequence[1:-1] - 1] = False
                real = np.bincount((2 * y[:-1] + y[1:])[inside], minlength=4).reshape(2, 2)
                d_m, d_c = real - expected, float((y - p).sum())
                idx, at = np.unique(t.features, return_inverse=True)
                d_w = np.bincount(at.ravel(), weights=np.repeat(y - p, t.features.shape[1]), minlength=len(idx))
                d_w -= 1e-3 * w[idx]
                touched[idx] = True
                sq_w[idx] += d_w * d_w
                sq_m += d_m * d_m
                sq_c += d_c * d_c
                w[idx] += 0.5 * d_w / np.sqrt(sq_w[idx])
                w[0] = 0
                m += 0.1 * d_m / np.sqrt(sq_m)
                c += 0.1 * d_c / np.sqrt(sq_c)
        # Weight 0 stands for no feature; its place carries the moves and the bias.
        some = np.flatnonzero(touched[1:]) + 1
        ids = np.concatenate((some, -1 - np.arange(5)))
        change = np.concatenate((w[some] - weights[some], (m - moves).ravel(), [c - bias]))
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(change)], ["id", "change"])
    return run


def marginals(t: Tokens, model: CrfModel) -> np.ndarray:
    return forward_backward(model.weights[t.features].sum(axis=1, dtype=np.float64) + model.bias, t.sequence, model.moves)[0]


def aggregates(doc: np.ndarray, p: np.ndarray, texts: int) -> np.ndarray:
    """What the logistic function sees of each document."""
    total = np.bincount(doc, weights=p, minlength=texts)
    count = np.bincount(doc, minlength=texts)
    most = np.zeros(texts)
    np.maximum.at(most, doc, p)
    return np.stack((np.log1p(total), most, np.log1p(100 * total / np.maximum(count, 1)), np.log1p(np.maximum(total - 1, 0)),
                     np.log1p(count) / 10, np.ones(texts)), axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Newton's method for a logistic function with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def _document_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = CrfModel(*shared.value)
        for batch in batches:
            data, off = text_buffer(batch.column(0))
            for i, j in slices(off):
                t = tokens(data[off[i]:off[j]], off[i:j + 1] - off[i])
                x = aggregates(t.words.doc, marginals(t, model), j - i)
                yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), batch.column(1).slice(i, j - i)], ["x", "label"])
    return run


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", sample_docs: int = 12_000) -> CrfModel:
    """Fit on the rows of ``docs`` that ``labels`` (doc_id, ``label`` 0/1) covers."""
    sc = docs.sparkSession.sparkContext
    nothing = CrfModel(np.zeros(1 << FEATURE_BITS, np.float32), np.zeros((2, 2)), 0.0, np.zeros(6))
    known = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chance = F.pmod(F.xxhash64(F.concat(F.lit("crf/"), id_text())), F.lit(1 << 20))
    n = known.count()
    cut = int(min(1.0, sample_docs / max(n, 1)) * (1 << 20)) + 1
    wanted = known.filter(chance < cut)
    sample = stored(docs.select("doc_id", F.col(text).alias("text")).filter("text IS NOT NULL").join(wanted, "doc_id")
                    .withColumn("part", F.pmod(F.xxhash64(F.concat(F.lit("part/"), id_text())), F.lit(4 * PARTS)))
                    .repartition(PARTS, F.pmod("part", F.lit(PARTS))), "toxic-sample")
    fit = sample.filter(F.col("part") >= PARTS).select("text", "label")
    kinds = {r["label"]: r["n"] for r in fit.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not kinds.get(0) or not kinds.get(1):
        share = known.agg(F.avg("label")).first()[0] or 0.0
        return nothing._replace(document=np.array([0, 0, 0, 0, 0, np.log(max(share, 1e-9) / max(1 - share, 1e-9))]))
    seen = (fit.mapInArrow(_evidence, "feature int, toxic long, clean long").groupBy("feature")
            .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).filter(F.col("toxic") >= MIN_DOCS).toArrow())
    flags = toxic_features(*(np.asarray(seen[c]) for c in ("feature", "toxic", "clean")), kinds[1], kinds[0])
    weights, moves, bias = nothing.weights, np.zeros((2, 2)), -4.0
    for _ in range(ROUNDS):
        shared = sc.broadcast((flags, weights, moves, bias))
        got = fit.mapInArrow(_pass(shared), "id int, change double").groupBy("id").agg(F.avg("change").alias("change")).toArrow()
        ids, change = np.asarray(got["id"]), np.asarray(got["change"])
        weights = weights.copy()
        weights[ids[ids > 0]] += change[ids > 0].astype(np.float32)
        rest = dict(zip((-1 - ids[ids < 0]).tolist(), change[ids < 0].tolist(), strict=True))
        moves = moves + np.array([rest.get(i, 0.0) for i in range(4)]).reshape(2, 2)
        bias += rest.get(4, 0.0)
    model = CrfModel(weights, moves, bias, np.zeros(6))
    held = (sample.filter(F.col("part") < PARTS).select("text", "label")
            .mapInArrow(_document_rows(sc.broadcast(tuple(model))), "x array<double>, label int").collect())
    if not held:
        return model._replace(document=nothing.document)
    return model._replace(document=logistic(np.array([r["x"] for r in held]), np.array([r["label"] for r in held], float)))


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])


def _spans(t: Tokens, p: np.ndarray, texts: int, off: np.ndarray) -> pa.Array:
    """Runs of tokens with p >= 0.5 in one line, as code point offsets."""
    hot = np.flatnonzero(p >= 0.5)
    line = np.searchsorted(t.sequence, hot, "right")
    cut = np.flatnonzero((np.diff(hot) > 1) | (np.diff(line) > 0)) + 1 if len(hot) else np.zeros(0, int)
    lo, hi = hot[np.append(0, cut)[:len(hot)]], hot[np.append(cut, len(hot)).astype(int) - 1] if len(hot) else hot
    points = np.append(0, np.cumsum((t.data & 0xC0) != 0x80))
    doc = t.words.doc[lo]
    first = points[off[doc]]
    mean = np.add.reduceat(p[hot], np.append(0, cut)) / np.diff(np.append(np.append(0, cut), len(hot))) if len(hot) else np.zeros(0)
    spans = pa.StructArray.from_arrays(
        [pa.array((points[t.words.start[lo]] - first).astype(np.int32)), pa.array((points[t.words.end[hi]] - first).astype(np.int32)), pa.array(mean)], fields=list(_SPAN))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(texts + 1)).astype(np.int32)), spans)


def score(docs: DataFrame, model: CrfModel, text: str = "text", into: str = "_crf") -> DataFrame:
    """``docs`` with a struct column ``into``: score and spans (start, end, marginal)."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = CrfModel(*shared.value)
        for col in parts:
            data, off = text_buffer(col)
            scores, spans = [np.zeros(0)], [pa.array([], pa.list_(_SPAN))]
            for i, j in slices(off):
                o = off[i:j + 1] - off[i]
                t = tokens(data[off[i]:off[j]], o)
                p = marginals(t, m)
                scores.append(1 / (1 + np.exp(-np.clip(aggregates(t.words.doc, p, j - i) @ m.document, -30, 30))))
                spans.append(_spans(t, p, j - i, o))
            yield pa.StructArray.from_arrays([pa.array(np.concatenate(scores)), pa.concat_arrays(spans)], names=["score", "spans"])

    return docs.withColumn(into, run(F.col(text)))


def is_toxic(result: str = "_crf", least: float = 0.5) -> Column:
    return F.col(result)["score"] >= F.lit(least)
