"""Near-duplicate documents by order MinHash and banded alignment.

1. A text becomes its words (split at ASCII white space). The fingerprint of the
   word sequence groups exact copies; from here on one representative of each
   group (its smallest doc_id) stands for all of them.
2. K-mers are runs of K words, labelled with their occurrence number, so that a
   repeated k-mer counts as often as it occurs. Each of SKETCHES hash functions
   takes the PICKED smallest labelled k-mers and keeps them in text order: one
   sketch is the hash of that ordered list. Two texts agree on a sketch with a
   probability that falls with their edit distance, and unlike set MinHash it
   also falls if the same k-mers come in another order. Short texts have too few
   k-mers for that: up to SHORT words they take sketches of SHORT_PICKED k-mers
   instead, and texts that a short one can be similar to take both kinds.
3. Texts that share a sketch form a bucket. Each bucket has one centre, drawn by
   a hash of its text, and its members are compared with the centre first:
   as many pairs as members. Similarity is not transitive, so members that are
   unlike the centre may still be like each other. For the texts of buckets that
   still hold several classes the rarest runs come in: an edit changes at most RUN of
   a text's runs of RUN words (labelled, as above), so of two similar texts each has at
   most RUN * (1 - SIMILARITY) of its words as runs that the other lacks, and the two
   share one of that many and one more of their rarest runs (rarest among these texts).
   Texts of different classes that share such a run are compared; no similar pair of a
   bucket is left out. A line or passage that many unlike texts hold is frequent and so
   not among their rarest runs, unless it is more than half of them. Then all its runs
   have nearly the same texts: a run whose texts all hold one and the same rarer run
   brings no new pair and is left out. Runs of more than MEMBERS texts are compared block
   by block, so that their pairs, which are many by nature, are never rows.
4. A pair is verified by banded alignment of its words: similarity is
   1 - edit distance / longer length, at least SIMILARITY. Pairs that cannot
   reach it by their lengths or by the words they have in common are dropped
   before; the band widens until it settles the pair, so the test is exact.
5. Verified links are closed to classes by star contraction, after the pairs with
   the centres and again after the others.

Result: one row per document with class_id (smallest doc_id of the class) and
links, the number of verified links of its text (pairs that were in one class
before their turn are not compared).

Defined results: a text without words (null, empty, white space) is a class of
its own, named by its doc_id, with no links. A text of fewer than K words has
one k-mer, itself. Rows are told apart by doc_id and a 64-bit hash of the text,
so a doc_id that repeats with another text is another node; rows that repeat
whole are exact copies. A null doc_id counts as smaller than any other, and
class_id is the smallest that is not null. An empty table gives an empty
result; other columns are ignored.

Disk: a step's shuffle files go when its table is written, and a table when no later step
reads it; the sketches are met in PARTS parts. Columns of the input are read twice more, for
the texts of the pairs.

Memory: a task holds one Arrow batch, the pairs of one alignment batch, or two blocks of
about BLOCK words; the number of words of the longest text bounds all. Nothing is capped.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arlens.llm.common import SLICE_BYTES, Words, byte_set, dispose, mix64, shuffles_freed, slices, stored, text_buffer
from arlens.llm.components import components

K = 2
SKETCHES = 96
PICKED = 3
SHORT = 40
SHORT_PICKED = 2
SIMILARITY = 0.8
RUN = 2
#: Texts of fewer words may share no run of RUN words with a similar one: they meet by single words.
FEW = 4
#: Runs of more texts are compared in blocks of about BLOCK words, a text counting as at least TEXT_WORDS.
MEMBERS = 64
BLOCK = 1 << 17
TEXT_WORDS = 256
#: Of how many k-mers of a text the smallest are chosen, as a rule; never a limit.
FEWEST = 16
#: Into how many parts the sketches are dealt: only one part's rows are shuffled at a time.
PARTS = 4
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _labelled(gram: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """K-mer hashes with their occurrence number inside the text mixed in."""
    key = gram + mix64(doc.astype(np.uint64) + np.uint64(3))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(gram), bool)
    same[1:] = key[order][1:] == key[order][:-1]
    if not same.any():
        return gram
    at = np.arange(len(gram))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    label = np.empty(len(gram), np.uint64)
    label[order] = (at - begin).astype(np.uint64)
    return np.where(label > 0, mix64(gram + label * np.uint64(0xA24BAED4963EE407)), gram)


def sketch(words: np.ndarray, first: np.ndarray, k: int = K, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Sketches (texts x sketches) of the texts whose words start at ``first`` (with the end last)."""
    n = np.diff(first)
    out = np.zeros((len(n), sketches), np.uint64)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(words)) - first[doc]
    # Runs that would leave the text are dropped, but a short text keeps its first run.
    keep = (place + k <= n[doc]) | (place == 0)
    gram, doc = grams_of(words, doc, k)[keep], doc[keep]
    gram = _labelled(gram, doc)
    start = np.searchsorted(doc, full)
    size = np.diff(np.append(start, len(doc)))
    owner = np.repeat(np.arange(len(full)), size)
    factor = mix64(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    # A text's smallest k-mers are looked for among those below a bound that about FEWEST of them pass.
    least = np.minimum(size, picked)
    bound = np.where(size <= FEWEST, _TOP, _TOP // size.astype(np.uint64) * np.uint64(FEWEST))[owner]
    best = np.zeros((len(full), sketches, picked), np.uint64)
    where = np.empty((len(full), sketches, picked), np.int64)
    product, low = np.empty(len(gram), np.uint64), np.empty(len(gram), bool)
    for s in range(sketches):
        # K-mer hashes are mixed already; an odd multiplier of its own orders them anew.
        np.multiply(gram, factor[s], out=product)
        np.less_equal(product, bound, out=low)
        at = np.flatnonzero(low)
        count = np.bincount(owner[at], minlength=len(full))
        scarce = np.flatnonzero(count < least)
        if len(scarce):  # too few passed: all k-mers of these texts are looked at
            for i in scarce:
                low[start[i]:start[i] + size[i]] = True
            count[scarce] = size[scarce]
            at = np.flatnonzero(low)
        h = product[at]
        begin = np.cumsum(count) - count
        mine = np.repeat(np.arange(len(full)), count)
        for k in range(picked):
            found = np.minimum.reduceat(h, begin)
            hit = np.flatnonzero(h == found[mine])
            if len(hit) > len(full):  # k-mers that are equal, or none left: the first in the text
                hit = hit[np.append(True, mine[hit][1:] != mine[hit][:-1])]
            pos = at[hit]
            best[:, s, k] = np.where(found != _TOP, gram[pos], np.uint64(0))
            where[:, s, k] = np.where(found != _TOP, pos, len(gram) + k + 1)
            h[hit] = _TOP
    ranked = np.take_along_axis(best, np.argsort(where, axis=2, kind="stable"), axis=2)
    value = np.broadcast_to(np.arange(1, sketches + 1, dtype=np.uint64), (len(full), sketches))
    for k in range(picked):
        value = mix64(value * np.uint64(0x9FB21C651E98DF25) + ranked[:, :, k])
    out[full] = value
    return out


def grams_of(words: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Hash of the run of up to ``k`` words of the same text from each place."""
    out = np.zeros(len(words), np.uint64)
    for j in range(k):
        out *= np.uint64(0x9FB21C651E98DF25)
        same = doc[j:] == doc[:len(doc) - j]
        out[:len(words) - j] += np.where(same, words[j:], np.uint64(0))
    return mix64(out)


def buckets_of(word: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """The sketches of each text: of PICKED k-mers, of SHORT_PICKED, or of both by its length."""
    n = np.diff(first)
    kinds = []
    for picked, some in ((PICKED, n > SHORT), (SHORT_PICKED, (n > 0) & (n <= SHORT / SIMILARITY + 1e-9))):
        at = np.flatnonzero(some)
        part = word[np.repeat(some, n)]
        got = sketch(part, np.append(0, np.cumsum(n[at])), picked=picked)
        kinds.append(dict(zip(at.tolist(), mix64(got + np.uint64(picked)), strict=True)))
    none = np.zeros(0, np.uint64)
    return [np.concatenate([kind.get(i, none) for kind in kinds]) for i in range(len(n))]


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    space = byte_set("space")
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        for i, j in slices(off):
            part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            w = Words(part, o, space)
            word = w.words()
            n = np.diff(w.first)
            other = w.words(salt=7)
            # Fingerprint of the word sequence: two independent 64-bit polynomial sums.
            prints = []
            for h in (word, other):
                place = np.arange(len(h)) - w.first[w.doc] if len(h) else np.zeros(0, int)
                v = mix64(h + mix64(place.astype(np.uint64) + np.uint64(11))) if len(h) else np.zeros(0, np.uint64)
                run = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(v, out=run[1:])
                prints.append(run[w.first[1:]] - run[w.first[:-1]])
            got = buckets_of(word, w.first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(n.astype(np.int64)),
                 pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                 pa.array([x.view(np.int64) for x in got], pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_words", "fp1", "fp2", "sketches"])


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text, text_hash): the last two columns tell rows of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("text_hash"))


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_words, fp1, fp2, sketches) of every row, stored."""
    return stored(keyed(docs, text).mapInArrow(
        _sign, "doc_id long, text_hash long, n_words long, fp1 long, fp2 long, sketches array<long>"), "signatures")


def representatives(signed: DataFrame) -> DataFrame:
    """One row per distinct word sequence: the doc_id and text_hash (``node``) that stand for it."""
    return signed.filter("n_words > 0").groupBy("fp1", "fp2").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("r"), F.first("n_words").alias("n_words"), F.first("sketches").alias("sketches")
    ).select("fp1", "fp2", F.col("r.doc_id").alias("rep_id"), F.col("r.text_hash").alias("node"), "n_words", "sketches")


def members(reps: DataFrame, parts: int = PARTS) -> DataFrame:
    """(bucket, node, n_words) of the buckets with more than one member, stored.

    There are about a hundred sketches a text, more than anything else here, and few of
    them are shared: they are dealt to ``parts`` by their hash and go through one by one."""
    found = []
    for part in range(parts):
        rows = reps.select("node", "n_words", F.explode("sketches").alias("bucket")).filter(F.pmod("bucket", F.lit(parts)) == part)
        shared = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"), "shared")
        found.append(stored(rows.join(shared, "bucket").select("bucket", "node", "n_words"), "members"))
        dispose(shared)
    out = stored(functools.reduce(DataFrame.unionByName, found), "members")
    dispose(*found)
    return out


def _near(a: str, b: str, similarity: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * F.lit(similarity)


def candidates(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes: the members of each bucket with its centre. Stored."""
    # One order of all nodes: the buckets of a group of copies tend to have one centre.
    choice = F.struct(F.xxhash64("node").alias("h"), F.col("node").alias("node"), F.col("n_words").alias("n_words"))
    centres = stored(rows.groupBy("bucket").agg(F.min(choice).alias("c"))
                     .select("bucket", F.col("c.node").alias("centre"), F.col("c.n_words").alias("c_words")), "centres")
    pairs = stored(rows.join(centres, "bucket").filter((F.col("node") != F.col("centre")) & _near("n_words", "c_words", similarity))
                   .select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "candidates")
    dispose(centres)
    return pairs


def crowded(rows: DataFrame, member: DataFrame) -> DataFrame:
    """(node, n_words, class) of the texts of buckets that hold several classes, stored."""
    rows = (rows.join(member, "node", "left")
            .select("bucket", "node", "n_words", F.coalesce("component", "node").alias("class")))
    mixed = rows.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("bucket")
    return stored(rows.join(mixed, "bucket").select("node", "n_words", "class").distinct(), "crowded")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, run, k) of (node, text) rows: the labelled runs of RUN words, single words of short texts."""
    space = byte_set("space")
    for batch in batches:
        data, off = text_buffer(batch.column(1))
        for i, j in slices(off):
            w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i], space)
            word, n = w.words(), np.diff(w.first)
            place = np.arange(len(word)) - w.first[w.doc]
            for k, some in ((RUN, n >= FEW), (1, n * SIMILARITY < FEW)):
                keep = some[w.doc] & (place + k <= n[w.doc])
                gram = _labelled(grams_of(word, w.doc, k)[keep] + np.uint64(k), w.doc[keep])
                node = batch.column(0).slice(i, j - i).take(pa.array(w.doc[keep]))
                yield pa.RecordBatch.from_arrays([node, pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), k, np.int32))], ["node", "run", "k"])


def rare_runs(texts: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(bucket, node, n_words, class): ``bucket`` is one of the runs of a node's text of
    which a similar text must hold one. Runs that bring no pair are left out: those of one
    class, and those whose nodes all have the same run before it, which then has them all.
    Stored."""
    runs = texts.mapInArrow(_runs, "node long, run long, k int")
    common = stored(runs.groupBy("run").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "common-runs")
    met = runs.join(common, "run").join(nodes, "node")
    # A text's own runs come first in its order of rarity: they are what is left of all its runs.
    mine = Window.partitionBy("node", "k")
    own = F.col("n_words") - F.col("k") + 1 - F.count(F.lit(1)).over(mine)
    wanted = F.floor(F.col("k") * F.lit(1 - similarity) * F.col("n_words") + 1e-9) + 1 - own
    order = mine.orderBy("texts", "run")
    met = met.withColumns({"_wanted": wanted, "_rank": F.row_number().over(order), "_before": F.lag("run").over(order)})
    rows = stored(met.filter(F.col("_rank") <= F.col("_wanted")).select(F.col("run").alias("bucket"), "node", "n_words", "class", "_before"), "rare-runs")
    inside = (F.count("_before") == F.count(F.lit(1))) & (F.min("_before") == F.max("_before"))
    some = rows.groupBy("bucket").agg((F.min("class") < F.max("class")).alias("several"), F.coalesce(inside, F.lit(False)).alias("inside"))
    shared = stored(rows.drop("_before").join(some.filter("several AND NOT inside").select("bucket"), "bucket"), "shared-runs")
    dispose(common, rows)
    return shared


def by_size(rows: DataFrame, most: int = MEMBERS) -> tuple[DataFrame, DataFrame]:
    """``rows`` of the buckets of at most ``most`` nodes, and of the others."""
    large = stored(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("bucket"), "large-runs")
    return rows.join(large, "bucket", "left_anti"), stored(rows.join(large, "bucket"), "large")


def unlinked(rows: DataFrame, done: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of nodes of ``rows`` (bucket, node, n_words, class) that share a
    bucket but neither a class nor a row of ``done``.

    Classes of a bucket meet before their members do, so a class's own pairs,
    however many, are never formed.
    """
    size = (F.min("n_words").alias("lo"), F.max("n_words").alias("hi"))
    left = rows.groupBy("bucket", F.col("class").alias("ca")).agg(*size)
    right = rows.groupBy("bucket", F.col("class").alias("cb")).agg(*size).withColumnsRenamed({"lo": "lo_b", "hi": "hi_b"})
    reach = (F.col("hi") >= F.col("lo_b") * F.lit(similarity)) & (F.col("hi_b") >= F.col("lo") * F.lit(similarity))
    met = left.join(right, "bucket").filter((F.col("ca") < F.col("cb")) & reach).select("bucket", "ca", "cb")
    one = rows.select("bucket", F.col("class").alias("ca"), F.col("node").alias("x"), F.col("n_words").alias("nx"))
    two = rows.select("bucket", F.col("class").alias("cb"), F.col("node").alias("y"), F.col("n_words").alias("ny"))
    pairs = (met.join(one, ["bucket", "ca"]).join(two, ["bucket", "cb"]).filter(_near("nx", "ny", similarity))
             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return pairs.join(done, ["a", "b"], "left_anti")


def edit_distances(left: list[np.ndarray], right: list[np.ndarray], band: int) -> np.ndarray:
    """Cost of the best alignment of each pair that stays in a band of +-``band``
    around the diagonal. It is the edit distance if it is at most ``band``, and
    never less than that. left[i] must not be empty."""
    n = np.array([len(x) for x in left])
    m = np.array([len(x) for x in right])
    wide = 2 * band + 1
    far = np.int32(1 << 28)
    # Pairs are the inner axis: every step works on whole rows of the band at once.
    a = np.full((n.max(), len(n)), -1, np.int64)
    b = np.full((max(n.max(), m.max()) + wide + 1, len(n)), -2, np.int64)
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        a[:len(x), i] = x.view(np.int64)
        b[band:band + len(y), i] = y.view(np.int64)
    steps = np.arange(wide, dtype=np.int32)[:, None]
    row = np.where(steps >= band, steps - band, far).repeat(len(n), 1).astype(np.int32)
    out = np.full(len(n), far, np.int32)
    end = m - n + band
    inside = (end >= 0) & (end < wide)
    last = np.argsort(n, kind="stable")
    done = np.searchsorted(n[last], np.arange(n.max() + 2))
    for i in range(int(n.max())):
        # Row o of step i+1 stands for the first i+1 words left and i+1+o-band words right.
        new = row + (b[i:i + wide] != a[i])
        if i < band:
            new[:band - i] = far
            new[band - i - 1] = i + 1
        np.minimum(new[:-1], row[1:] + 1, out=new[:-1])
        new -= steps
        np.minimum.accumulate(new, axis=0, out=new)
        new += steps
        if done[i + 1] < done[i + 2]:
            ready = last[done[i + 1]:done[i + 2]]
            ready = ready[inside[ready]]
            out[ready] = new[end[ready], ready]
        row = new
    return out


def similar(left: list[np.ndarray], right: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Which pairs have 1 - edit distance / longer length >= ``similarity``.

    A narrow band comes first: its cost is never below the distance, so a pair
    it accepts is similar. Only pairs it does not accept are aligned again in
    wider bands, up to one that holds every alignment of the allowed cost.
    """
    size = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)], int)
    limit = np.floor((1 - similarity) * size + 1e-9).astype(int)
    verdict = np.zeros(len(size), bool)
    todo = []
    for i, (x, y) in enumerate(zip(left, right, strict=True)):
        if size[i] - min(len(x), len(y)) > limit[i]:
            continue
        # Words without a partner on the other side need an edit each.
        u, c = np.unique(np.concatenate((x, y)), return_inverse=True)
        p, q = np.bincount(c[:len(x)], minlength=len(u)), np.bincount(c[len(x):], minlength=len(u))
        if size[i] - np.minimum(p, q).sum() <= limit[i]:
            todo.append(i)
    band = {i: min(int(limit[i]), abs(len(left[i]) - len(right[i])) + 3) for i in todo}
    while todo:
        # Pairs of like length and band are aligned together.
        todo.sort(key=lambda i: (band[i].bit_length(), size[i]))
        later, k = [], 0
        while k < len(todo):
            j = k + 1
            while j < len(todo) and size[todo[j]] <= 1.25 * size[todo[k]] + 8 and band[todo[j]] <= 2 * band[todo[k]] + 2 \
                    and (j - k + 1) * (4 * band[todo[k]] + 5) <= 1 << 15 and (j - k + 1) * size[todo[j]] <= 1 << 20:
                j += 1
            group, k = todo[k:j], j
            wide = max(band[i] for i in group)
            d = edit_distances([left[i] for i in group], [right[i] for i in group], wide)
            for i, x in zip(group, d, strict=True):
                if x <= limit[i] or wide >= limit[i]:
                    verdict[i] = x <= limit[i]
                else:
                    band[i] = min(int(limit[i]), 4 * wide)
                    later.append(i)
        todo = later
    return verdict


def _word_lists(col: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text."""
    space = byte_set("space")
    data, off = text_buffer(col)
    out = []
    for i, j in slices(off):
        w = Words(data[off[i]:off[j]], off[i:j + 1] - off[i], space)
        h = w.words()
        out += [h[w.first[k]:w.first[k + 1]] for k in range(j - i)]
    return out


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # The pairs of a few MiB of text at a time, or one pair.
        length = [pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (2, 3)]
        for i, j in slices(np.append(0, np.cumsum(length[0] + length[1])), 4 * SLICE_BYTES):
            part = batch.slice(i, j - i)
            ok = similar(_word_lists(part.column(2)), _word_lists(part.column(3)))
            yield part.select([0, 1]).filter(pa.array(ok))


def texts_of(docs: DataFrame, reps: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(node, text) of the nodes of ``wanted``, stored."""
    wanted = reps.select("node", "rep_id").join(wanted, "node", "left_semi")
    rows = keyed(docs, text)
    texts = stored(rows.join(wanted, (rows["text_hash"] == wanted["node"]) & rows["doc_id"].eqNullSafe(wanted["rep_id"]), "left_semi")
                   .select(F.col("text_hash").alias("node"), "text"), "texts")
    with shuffles_freed(docs.sparkSession):
        twice = texts.groupBy("node").count().filter("count > 1").limit(1).count()
    if twice:  # rows that repeat whole
        all_, texts = texts, stored(texts.dropDuplicates(["node"]), "texts")
        dispose(all_)
    return texts


def links(texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify, "a long, b long")


def common_words(texts: list[np.ndarray]) -> np.ndarray:
    """How many words each two texts have in common, a word as often as both hold it."""
    size = np.array([len(x) for x in texts])
    doc = np.repeat(np.arange(len(texts)), size)
    word, at = np.unique(_labelled(np.concatenate(texts), doc), return_inverse=True)
    out = np.zeros((len(texts), len(texts)), np.int64)
    # A few thousand words at a time: a table of texts by words, times itself.
    order = np.argsort(at, kind="stable")
    step = 4096
    cuts = np.searchsorted(at[order], np.arange(0, len(word) + step, step))
    for k, (i, j) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        held = np.zeros((len(texts), step), np.float32)
        held[doc[order[i:j]], at[order[i:j]] - k * step] = 1
        out += (held @ held.T).astype(np.int64)
    return out


def _cell(rows: pa.Table) -> pa.Table:
    """The similar pairs of texts of different classes: of the two sides 1 and 2, or of any two texts of side 0."""
    side, kind, node = (rows.column(c).to_numpy() for c in ("side", "class", "node"))
    text = _word_lists(rows.column("text"))
    size = np.array([len(x) for x in text])
    longer = np.maximum(size[:, None], size[None, :])
    # Words without a partner on the other side need an edit each.
    open_ = (kind[:, None] != kind[None, :]) & (longer - common_words(text) <= np.floor((1 - SIMILARITY) * longer + 1e-9))
    open_ &= (side[:, None] == 1) & (side[None, :] == 2) if side.any() else np.triu(np.ones(open_.shape, bool), 1)
    left, right = np.nonzero(open_)
    ok = [similar([text[k] for k in left[i:i + 4096]], [text[k] for k in right[i:i + 4096]]) for i in range(0, len(left), 4096)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    x, y = node[left[ok]], node[right[ok]]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y)})


def block_links(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes of ``rows`` (bucket, node, n_words, class) that share a
    bucket but no class and whose texts are similar.

    A bucket's texts are dealt to blocks, and each two blocks meet in a task. A class of
    half a block or more has blocks of its own, which do not meet each other; smaller
    classes are dealt whole. So the work is that of the pairs of different classes."""
    cost = F.sum(F.greatest("n_words", F.lit(TEXT_WORDS)))
    own = F.col("cost") >= BLOCK // 2
    parts = rows.groupBy("bucket", "class").agg(cost.alias("cost"))
    rest = parts.filter(~own).groupBy("bucket").agg(F.ceil(F.sum("cost") / BLOCK).alias("shared"))
    parts = parts.join(rest, "bucket", "left").select(
        "bucket", "class", own.alias("own"), F.when(own, F.ceil(F.col("cost") / BLOCK)).otherwise(F.col("shared")).alias("blocks"))
    number = F.pmod(F.when(F.col("own"), F.xxhash64("node")).otherwise(F.xxhash64("class")), F.col("blocks"))
    part = F.struct("own", F.when(F.col("own"), F.col("class")).otherwise(F.lit(0)).alias("class"), number.alias("number"))
    dealt = stored(rows.join(parts, ["bucket", "class"]).select("bucket", "node", "class", part.alias("part")), "blocks")
    blocks = dealt.select("bucket", "part").distinct()
    x, y = F.col("x"), F.col("y")
    apart = ~(x["own"] & y["own"] & (x["class"] == y["class"]))
    cells = (blocks.withColumnRenamed("part", "x").join(blocks.withColumnRenamed("part", "y"), "bucket")
             .filter(((x < y) & apart) | ((x == y) & ~x["own"])))
    sent = cells.withColumn("part", F.explode(F.array_distinct(F.array("x", "y")))).join(dealt, ["bucket", "part"])
    side = F.when(x == y, 0).when(x == F.col("part"), 1).otherwise(2)
    return (sent.select("bucket", "x", "y", side.alias("side"), "class", "node").join(texts, "node")
            .groupBy("bucket", "x", "y").applyInArrow(_cell, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_words, class_id, links
    and first, whether this row is the class's first by doc_id and text_hash."""
    signed = signatures(docs, text)
    reps = stored(representatives(signed), "representatives")
    # Nothing reads the sketches twice, and they take the most room: what is left of each table replaces it.
    wide, signed = signed, stored(signed.drop("sketches"), "signed")
    dispose(wide)
    rows = members(reps)
    wide, reps = reps, stored(reps.drop("sketches"), "representatives")
    dispose(wide)
    pairs = candidates(rows)
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    texts = texts_of(docs, reps, ends, text)
    found = stored(links(texts, pairs), "links")
    dispose(texts)
    left = crowded(rows, components(found, "a", "b"))
    dispose(rows)
    texts = texts_of(docs, reps, left.select("node"), text)
    met = rare_runs(texts, left)
    few, many = by_size(met)
    more = stored(unlinked(few, pairs), "candidates")
    dispose(pairs, met)
    later = []
    if more.limit(1).count():
        later.append(stored(links(texts, more), "links"))
    if many.limit(1).count():
        later.append(stored(block_links(texts, many), "block-links"))
    dispose(texts, left, more, many)
    if later:
        found = found.unionByName(functools.reduce(DataFrame.unionByName, later).distinct())
    ends = found.select(F.col("a").alias("node")).unionAll(found.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    member = components(found, "a", "b").join(degree, "node")
    named = stored(reps.select("fp1", "fp2", "node", "rep_id").join(member, "node", "left").select(
        "fp1", "fp2", F.coalesce("component", "node").alias("class"), F.struct("rep_id", "node").alias("r"), F.coalesce("links", F.lit(0)).alias("links")), "nodes")
    # Stored, so that the join below deals both sides anew and a large class can be split.
    heads = stored(named.groupBy("class").agg(F.min("r").alias("head"), F.min("r.rep_id").alias("class_id")), "heads")
    classes = stored(named.join(heads, "class").select("fp1", "fp2", "class_id", "head", "links"), "classes")
    dispose(reps, named, heads)
    some = F.col("n_words") > 0
    is_first = (F.col("head.rep_id").eqNullSafe(F.col("doc_id"))) & (F.col("head.node") == F.col("text_hash"))
    return (signed.join(classes, ["fp1", "fp2"], "left")
            .select("doc_id", "text_hash", "n_words", F.when(some, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.when(some, F.col("links")).otherwise(F.lit(0)).cast("long").alias("links"),
                    F.when(some, is_first).otherwise(F.lit(True)).alias("first")))


def deduplicated(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one row of each class: the first by doc_id; columns unchanged."""
    found = stored(near_duplicates(docs, text), "near-duplicates")
    dropped = stored(found.filter(~F.col("first")).select(F.col("doc_id").alias("_nd_id"), F.col("text_hash").alias("_nd_hash")).distinct(), "dropped")
    rows = docs.withColumn("_nd_text", F.xxhash64(F.col(text)))
    # Never broadcast: the list grows with the table. Only it is held, so the texts need no sort.
    kept = rows.join(dropped.hint("shuffle_hash"), rows["doc_id"].cast("long").eqNullSafe(dropped["_nd_id"]) & (F.col("_nd_text") == F.col("_nd_hash")), "left_anti")
    again = found.filter("first AND n_words > 0").groupBy("doc_id", "text_hash").count().filter("count > 1")
    with shuffles_freed(docs.sparkSession):
        repeated = again.limit(1).count()
    if repeated:
        # Rows that repeat whole are one group as well: one row of them stays.
        again = stored(again.select(F.col("doc_id").alias("_nd_id"), F.col("text_hash").alias("_nd_hash")), "repeated")
        same = rows["doc_id"].cast("long").eqNullSafe(again["_nd_id"]) & (F.col("_nd_text") == F.col("_nd_hash"))
        one = kept.join(again, same, "left_semi").dropDuplicates(["doc_id", "_nd_text"])
        kept = kept.join(again, same, "left_anti").unionByName(one)
    return kept.drop("_nd_text")
