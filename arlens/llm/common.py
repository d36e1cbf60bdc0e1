"""Shared helpers: tables in the checkpoint folder, row keys, and word hashing
on Arrow text buffers.

The Python parts below run inside tasks on Arrow batches. They look at a whole
batch of texts as one byte buffer and use numpy on it, so there is no Python
loop over words. ``slices`` bounds the working memory: a slice is one text or
several texts of together at most ``SLICE_BYTES``.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from arlens.scratch import dispose, shared_path, shuffles_freed, stored  # noqa: F401  (re-exported for the operators)
from arlens.sources.tables import read_table  # noqa: F401

WHITE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20


def id_text(col: str = "doc_id") -> Column:
    """``doc_id`` as text; a null id counts as the empty string."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def crc_fold(n: int, col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``n``: the folds the contracts name."""
    return F.crc32(id_text(col)) % F.lit(n)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application (spark.files),
    so tasks can import it wherever the driver found it."""
    sc = spark.sparkContext
    if getattr(sc, "_arlens_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="arlens-ship-"), "arlens_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    sc.addPyFile(target)
    sc._arlens_shipped = True


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; a null is an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts, each of at most ``limit`` bytes or of a single text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower-case ASCII and the Latin-1 letters of UTF-8 without changing any length."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        second = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[second] += 32
    return out


def byte_set(kind: str) -> np.ndarray:
    """Which bytes belong to a word: 'space' splits at the white space of WORD,
    'letters' keeps ASCII letters, digits and every byte of a non-ASCII character."""
    table = np.ones(256, bool)
    if kind == "space":
        table[[9, 10, 11, 12, 13, 32]] = False
    else:
        table[:128] = False
        for a, b in ((48, 57), (65, 90), (97, 122)):
            table[a:b + 1] = True
    return table


_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def _powers(n: int, base: np.uint64) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; kept per worker and grown on demand."""
    have = _POWERS.get(int(base))
    if have is None or len(have) <= n:
        have = np.full(max(n + 1, SLICE_BYTES + 1), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * SLICE_BYTES:
            _POWERS[int(base)] = have
    return have


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads a 64-bit value over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """Words of a slice: byte ranges, the text each belongs to, and hashes of any part."""

    def __init__(self, data: np.ndarray, off: np.ndarray, table: np.ndarray):
        inside = table[data]
        n = len(data)
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
        cuts = off[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < n)]
        before[cuts] = False
        after[cuts - 1] = False
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.doc = np.searchsorted(off, self.start, "right") - 1
        #: first word of each text, and one past the last of all
        self.first = np.searchsorted(self.start, off)
        self._sum = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _P)[:n], out=self._sum[1:])

    def hash(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self._sum[end] - self._sum[start]) * _powers(len(self._sum), _P_INV)[start]
        return mix64(h + np.uint64(salt * 0xD6E8FEB86659FD93 % (1 << 64)) + (end - start).astype(np.uint64))

    def words(self, salt: int = 0) -> np.ndarray:
        return self.hash(self.start, self.end, salt)
