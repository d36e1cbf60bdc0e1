"""Tables clustered by a key, for per-key work without an exchange and for reading one key.

A clustered table is a folder of three:

* ``cold``: rows bucketed by the key, one file a bucket, sorted by key and order;
* ``hot``: rows of keys that hold over twice a bucket's share, range-partitioned by key
  and order, so that such a key lies in many files. At most half as many keys as buckets
  can be hot. A null key counts as one;
* ``layout``: one row with key, order, number of buckets, of rows and of hot keys. Readers
  take the number of buckets from there, never from the session.

Files carry Parquet bloom filters on the key. A key's rows are in one of the two parts
only, so work that treats each key alone is the union of that work on both:
:meth:`Clustered.per_key`. On ``cold`` Catalyst sees the buckets' partitioning and adds no
exchange; ``hot`` is shuffled with partial aggregation as any table is.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a bucket holds on average, about 16 MB of movements: per-customer work sorts and
#: aggregates a bucket several times in one task, so it needs many times that memory.
ROWS_PER_BUCKET = 250_000


@dataclass(frozen=True)
class Clustered:
    cold: DataFrame
    hot: DataFrame
    key: str
    order: tuple[str, ...]
    buckets: int
    rows: int
    hot_keys: int

    def rows_of(self, value: Column) -> DataFrame:
        """Rows of one key; ``value`` may be a scalar subquery. The filter reaches both
        scans, where statistics, dictionaries and bloom filters pick the row groups."""
        return self.all().filter(F.col(self.key) == value)

    def all(self) -> DataFrame:
        return self.cold.unionByName(self.hot) if self.hot_keys else self.cold

    def per_key(self, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``work`` of all rows, where it treats the rows of each key apart from others."""
        return work(self.cold).unionByName(work(self.hot)) if self.hot_keys else work(self.cold)


def _blooms(writer, key: str, keys_a_file: int):
    return (writer.option(f"parquet.bloom.filter.enabled#{key}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(keys_a_file, 1))))


def _table(path: str) -> str:
    return f"arlens_cold_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def bucket_count(rows: int, shuffle_partitions: int) -> int:
    """A power of two that keeps buckets near :data:`ROWS_PER_BUCKET`, and no fewer than the
    session's shuffle partitions: with fewer, joins would shuffle the buckets again."""
    return 1 << math.ceil(math.log2(max(shuffle_partitions, rows / ROWS_PER_BUCKET, 1)))


def write_clustered(df: DataFrame, path: str, key: str, order: list[str], buckets: int | None = None) -> None:
    """Write ``df`` (read twice: a stored table is best) as a clustered table at ``path``,
    which must be new. An empty table is written as one."""
    spark = df.sparkSession
    path = path.rstrip("/")
    counts = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    size = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("keys")).first()
    buckets = buckets or bucket_count(size["rows"], int(spark.conf.get("spark.sql.shuffle.partitions")))
    counts.filter(F.col("_n") * buckets > 2 * size["rows"]).write.parquet(f"{path}/hot_keys")
    # Fewer than buckets / 2 rows, by the filter above: a bounded broadcast.
    hot = spark.read.parquet(f"{path}/hot_keys")
    hot_keys, hot_rows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    hot = hot.select("_k")
    is_hot = F.col(key).eqNullSafe(F.col("_k"))
    per_file = math.ceil(size["keys"] / buckets)

    cold = df.join(F.broadcast(hot), is_hot, "left_anti") if hot_keys else df
    _blooms(cold.repartition(buckets, key).write.format("parquet"), key, per_file).bucketBy(buckets, key).sortBy(
        key, *order).option("path", f"{path}/cold").saveAsTable(_table(path))
    if hot_keys:
        rows = df.join(F.broadcast(hot), is_hot, "left_semi")
        files = math.ceil(hot_rows * buckets / size["rows"])    # as large as a bucket
        _blooms(rows.repartitionByRange(files, key, *order).sortWithinPartitions(key, *order).write, key, hot_keys).parquet(f"{path}/hot")
    else:
        df.limit(0).write.parquet(f"{path}/hot")
    spark.range(1).select(F.lit(key).alias("key"), F.array(*[F.lit(c) for c in order]).cast("array<string>").alias("order"), F.lit(buckets).alias("buckets"),
                          F.lit(size["rows"]).cast("long").alias("rows"), F.lit(hot_keys).alias("hot_keys")).coalesce(1).write.parquet(f"{path}/layout")


def read_clustered(spark: SparkSession, path: str) -> Clustered:
    """The clustered table at ``path``, written by this or any other session."""
    path = path.rstrip("/")
    lay = spark.read.parquet(f"{path}/layout").first()
    hot = spark.read.parquet(f"{path}/hot")
    name = _table(path)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in hot.schema.fields)
        names = ", ".join(f"`{c}`" for c in [lay["key"], *lay["order"]])
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY (`{lay['key']}`) SORTED BY ({names}) INTO {lay['buckets']} BUCKETS LOCATION '{path}/cold'")
    return Clustered(spark.table(name), hot, lay["key"], tuple(lay["order"]), lay["buckets"], lay["rows"], lay["hot_keys"])
