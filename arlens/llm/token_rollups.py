"""Token counts as rollups kept by signed deltas.

A rollup is a folder in shared storage. Every batch of changes is one commit: a
Parquet folder ``deltas/batch=<id>`` with the batch's deltas already added up by
source, language and tokenizer version, and an empty marker file
``commits/<id>`` written after it. Totals are the sum of the deltas of committed
batches, so they are additive, order-free and exact.

* An insert counts +1 document and its tokens, a delete the same with -1, a
  revision is a delete of the old count and an insert of the new one; all three
  are rows of ``changes`` with a sign.
* A batch is idempotent: its id is taken from the caller; a committed id is
  skipped, an id without marker (the job died) is written again over the same
  folder, so running a batch twice, or after a lost driver, counts it once.
* ``compact`` folds committed batches into one base; its commit names the ids it
  holds, so a reader sees either the base or the batches, never both.

Tokenizers are given as rank files by path and version name; texts are encoded
whole, in tasks. Hot sources cost a partial aggregate per task.

Defined results: a null or empty text has no tokens but counts as a document;
null sources and languages are values of their own; repeated rows count as often
as they occur; groups whose documents all went keep no row in the totals; an
empty batch commits with no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "tokenizer_version"]
MEASURES = ["documents", "tokens", "bytes"]
# The pattern that splits text before the merges of the rank files (fixed value, from their description).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECE = 1 << 16


_ENCODERS: dict[str, object] = {}


def _shared_encoder(name: str):
    """The encoder of a file Spark sent to this executor, built once per worker."""
    if name not in _ENCODERS:
        with open(SparkFiles.get(name), "rb") as f:
            _ENCODERS[name] = _encoder(f.read())
    return _ENCODERS[name]


def _encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
    return tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(docs: DataFrame, tokenizers: dict[str, str], text: str = "text", into: str = "_tokens") -> DataFrame:
    """``docs`` with a map column: tokenizer version -> tokens of the text.

    ``tokenizers`` names rank files on the driver by version; Spark hands them to the executors.
    """
    sc = docs.sparkSession.sparkContext
    names = {}
    for version, path in sorted(tokenizers.items()):
        sc.addFile(path)
        names[version] = path.rsplit("/", 1)[-1]

    @F.arrow_udf("map<string,bigint>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoders = {version: _shared_encoder(name) for version, name in names.items()}
        for col in parts:
            texts = col.to_pylist()
            rows = [[(v, sum(len(e.encode_ordinary(x)) for x in pieces(t or ""))) for v, e in encoders.items()] for t in texts]
            yield pa.array(rows, pa.map_(pa.string(), pa.int64()))

    return docs.withColumn(into, run(F.col(text)))


def pieces(text: str) -> Iterator[str]:
    """``text`` in pieces of bounded length that no token crosses.

    A single line end between two visible characters, the second a letter, is a
    piece of the pattern by itself, so a cut behind it changes no token. A text
    without such a place is one piece.
    """
    begin = 0
    while len(text) - begin > PIECE:
        end = text.find("\n", begin + PIECE)
        while end >= 0 and end + 1 < len(text) and (text[end - 1].isspace() or not text[end + 1].isalpha()):
            end = text.find("\n", end + 1)
        if end < 0 or end + 1 >= len(text):
            break
        yield text[begin:end + 1]
        begin = end + 1
    yield text[begin:]


def changes(docs: DataFrame, sign: int, tokens: str = "_tokens", size: str = "_bytes") -> DataFrame:
    """Signed rows (KEYS and MEASURES) of inserted (+1) or deleted (-1) documents."""
    rows = docs.select("source", "lang", F.col(size).cast("long").alias("bytes"), F.explode(tokens).alias("tokenizer_version", "tokens"))
    return rows.select(*KEYS, F.lit(sign).cast("long").alias("documents"), (sign * F.col("tokens")).alias("tokens"), (sign * F.col("bytes")).alias("bytes"))


def revisions(docs: DataFrame, old: tuple[str, str], new: tuple[str, str]) -> DataFrame:
    """The rows that replace the counts in the columns ``old`` (tokens, bytes) by those in ``new``."""
    return changes(docs, -1, *old).unionByName(changes(docs, 1, *new))


def bytes_of(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


class Rollup:
    """Totals by KEYS in the folder ``path``, which all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str) -> tuple[JavaObject, JavaObject]:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def committed(self) -> list[str]:
        """Ids of the batches that readers see, in order; those a base holds not counted."""
        fs, p = self._fs(f"{self.path}/commits")
        names = sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []
        inside = {x for n in names if n.startswith("base-") for x in self._held(n)}
        return [n for n in names if n not in inside]

    def _held(self, base: str) -> list[str]:
        return [r["batch"] for r in self.spark.read.text(f"{self.path}/held/{base}").select(F.col("value").alias("batch")).collect()]

    def _known(self, batch: str) -> bool:
        fs, p = self._fs(f"{self.path}/commits/{batch}")
        return fs.exists(p)

    def commit(self, batch: str, rows: DataFrame) -> bool:
        """Add the signed ``rows`` as ``batch``; False if that id is committed already."""
        if self._known(batch):
            return False
        added = rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES])
        added.write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")
        fs, p = self._fs(f"{self.path}/commits/{batch}")
        fs.create(p, True).close()
        return True

    def totals(self) -> DataFrame:
        """KEYS and MEASURES of the documents that are there now."""
        schema = ", ".join([f"{k} string" for k in KEYS] + [f"{m} long" for m in MEASURES])
        paths = [f"{self.path}/deltas/batch={b}" for b in self.committed()]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*[F.sum(m).alias(m) for m in MEASURES]).filter("documents <> 0 OR tokens <> 0 OR bytes <> 0")

    def compact(self, base: str) -> bool:
        """Fold the batches committed so far into one called ``base-<base>``."""
        name, ids = f"base-{base}", self.committed()
        if self._known(name) or not ids:
            return False
        held = [x for n in ids if n.startswith("base-") for x in self._held(n)]
        self.spark.createDataFrame([(x,) for x in sorted({*ids, *held})], "value string").write.mode("overwrite").text(f"{self.path}/held/{name}")
        self.totals().write.mode("overwrite").parquet(f"{self.path}/deltas/batch={name}")
        fs, p = self._fs(f"{self.path}/commits/{name}")
        fs.create(p, True).close()
        return True

