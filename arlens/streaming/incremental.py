"""Incremental re-ingestion of ledger exports (S13, re-aimed).

The source system reprocesses everything when a raw file is newer than the
outputs. Here new ledger files land in a folder partitioned by customer
bucket; a Structured Streaming file source picks up only files it has not
seen (tracked in the stream checkpoint), and ``foreachBatch`` recomputes the
balances of the customer buckets those files touch, replacing just those
output partitions; a touched bucket without debtors is emptied. Re-running
after a failure replays the same batch and rewrites the same partitions, so the
result is the same as one batch run.

Corrections arrive as re-exports. An export has a name: landing it again replaces what
it held before, whole, so movements that were changed, moved to other rows or withdrawn
are right after it. Each landing leaves a marker in every bucket that it or its
predecessor has rows in, so a bucket knows its exports' latest landings, and one whose
movements were all withdrawn is recomputed. Exports of different names add up; a
movement that several of them hold counts once, as the latest has it. It is known by
customer, document and its number among the equal ones of its export, not by its row.
The number of buckets is stored with the landing; another number is refused.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, IntegerType, LongType, StringType, StructField, StructType

from arlens.functions.amounts import MONEY
from arlens.functions.text import title_case
from arlens.operators.balances import client_balances
from arlens.operators.ledger import clean_ledger

BUCKET = "bucket"
LANDED = "landed_at"
EXPORT = "export"
MARKER = "marker"
DEFAULT_BUCKETS = 1024
LEDGER_LANDING_SCHEMA = StructType([
    StructField("orden_origen", LongType()),
    StructField("cliente", StringType()),
    StructField("documento", StringType()),
    StructField("fecha", DateType()),
    StructField("fecha_vencimiento", DateType()),
    StructField("debe", MONEY),
    StructField("haber", MONEY),
    StructField("saldo", MONEY),
    StructField(LANDED, LongType()),
    StructField(EXPORT, StringType()),
    StructField(MARKER, BooleanType()),
])
MOVEMENT = [f.name for f in LEDGER_LANDING_SCHEMA.fields if f.name not in (LANDED, EXPORT, MARKER)]


def bucket_of(cliente: Column, buckets: int) -> Column:
    """Stable customer bucket of the cleaned (title-cased) customer name."""
    return F.pmod(F.xxhash64(title_case(cliente)), F.lit(buckets)).cast("int")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored_buckets(spark: SparkSession, landing_dir: str) -> int | None:
    """Number of buckets the landing folder was made with, None if it is new."""
    fs, p = _fs(spark, f"{landing_dir.rstrip('/')}/_buckets")
    return int(fs.listStatus(p)[0].getPath().getName()) if fs.exists(p) else None


def land_ledger(df: DataFrame, landing_dir: str, buckets: int = DEFAULT_BUCKETS, export: str | None = None) -> None:
    """Append one export's movements to the landing folder, partitioned by bucket. A
    later landing of the same ``export`` replaces it; without a name it is one of its own."""
    spark = df.sparkSession
    have = stored_buckets(spark, landing_dir)
    if have is None:
        fs, p = _fs(spark, f"{landing_dir.rstrip('/')}/_buckets/{buckets}")
        fs.create(p, True).close()
    elif have != buckets:
        raise ValueError(f"the landing has {have} buckets, not {buckets}")
    now = time.time_ns()
    name = export or f"landing-{now}"
    rows = df.select(*MOVEMENT).withColumn(BUCKET, bucket_of(F.col("cliente"), buckets)).withColumn(MARKER, F.lit(False))
    marked = rows.select(BUCKET)
    if export is not None and have is not None and _has_landings(spark, landing_dir):
        before = spark.read.schema(_landing_schema()).option("basePath", landing_dir).parquet(landing_dir)
        marked = marked.unionByName(before.filter(F.col(EXPORT) == export).select(BUCKET))
    marks = marked.distinct().select(*[F.lit(None).cast(LEDGER_LANDING_SCHEMA[c].dataType).alias(c) for c in MOVEMENT], BUCKET, F.lit(True).alias(MARKER))
    (rows.unionByName(marks).withColumns({LANDED: F.lit(now).cast("long"), EXPORT: F.lit(name)})
         .write.mode("append").partitionBy(BUCKET).parquet(landing_dir))


def _has_landings(spark: SparkSession, landing_dir: str) -> bool:
    fs, p = _fs(spark, landing_dir)
    return any(x.getPath().getName().startswith(f"{BUCKET}=") for x in fs.listStatus(p))


def current(landed: DataFrame) -> DataFrame:
    """The movements that count: of each export its latest landing, and of a movement
    that several exports hold the latest one's row."""
    newest = landed.groupBy(BUCKET, EXPORT).agg(F.max(LANDED).alias(LANDED))
    rows = landed.filter(~F.col(MARKER)).join(newest, [BUCKET, EXPORT, LANDED], "left_semi")
    same = Window.partitionBy("cliente", "documento", EXPORT).orderBy(F.col("fecha").asc_nulls_first(), "orden_origen")
    rows = rows.withColumn("_nth", F.row_number().over(same))
    rest = [c for c in MOVEMENT if c not in ("cliente", "documento")]
    return rows.groupBy("cliente", "documento", "_nth").agg(F.max(F.struct(LANDED, *rest)).alias("r")).select(
        "cliente", "documento", *[F.col(f"r.{c}").alias(c) for c in rest])


def _landing_schema() -> StructType:
    return StructType(LEDGER_LANDING_SCHEMA.fields + [StructField(BUCKET, IntegerType())])


def recompute_buckets(spark: SparkSession, landing_dir: str, out_dir: str, touched: DataFrame, as_of) -> None:
    """Recompute balances of the touched buckets from all their landed rows
    and overwrite exactly those output partitions."""
    # At most `buckets` small ints: a bounded list, used as literals so the
    # landing scan prunes partitions.
    keys = sorted(r[BUCKET] for r in touched.collect())
    if not keys:
        return
    full = (spark.read.schema(_landing_schema()).option("basePath", landing_dir).parquet(landing_dir)
                 .filter(F.col(BUCKET).isin(keys)))              # partition pruning on the landing folder
    bal = client_balances(clean_ledger(current(full)), as_of)
    out = bal.withColumn(BUCKET, bucket_of(F.col("cliente"), stored_buckets(spark, landing_dir)))
    (out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(BUCKET).parquet(out_dir))
    # A dynamic overwrite leaves partitions it has no rows for: those debtors have all paid.
    written = {r[BUCKET] for r in out.select(BUCKET).distinct().collect()}
    for k in set(keys) - written:
        fs, p = _fs(spark, f"{out_dir.rstrip('/')}/{BUCKET}={k}")
        fs.delete(p, True)


def run_incremental(spark: SparkSession, landing_dir: str, out_dir: str, checkpoint: str, as_of) -> None:
    """Process every landed file not yet seen, then stop (``availableNow``)."""
    stream = spark.readStream.schema(_landing_schema()).option("basePath", landing_dir).parquet(landing_dir)

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        touched = batch.select(BUCKET).distinct()
        recompute_buckets(batch.sparkSession, landing_dir, out_dir, touched, as_of)

    q = (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
               .trigger(availableNow=True).start())
    q.awaitTermination()
