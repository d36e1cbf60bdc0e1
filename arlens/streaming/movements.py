"""Customer totals kept up by state: corrections, withdrawals and exports out of order.

Where :mod:`incremental` recomputes the customers that a landing touches, this keeps the
movements themselves as state and gives signed changes of the totals, so work follows the
changed movements and not the touched customers' history.

A movement is known by customer, document and its number among the equal ones of its
export. State is held per block of 1,000 such numbers of one customer and document, so a
customer with very many movements, also under one document, is many keys. A landing of a
named export replaces what the export held: it says for every block that any landing
of the export ever had which movements are there now, none included. Landings carry their
time, and state takes the later one, so files may be read in any order, split over any
batches, and twice. A movement that several exports hold counts once, as the latest has it.

Each batch's changes, summed per customer, overwrite their own folder: a batch that is
replayed after a failure gives the same ones. Movements without a customer are left out, a
null document counts as blank, an empty export withdraws all that its name held.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from decimal import Decimal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from arlens.functions.amounts import MONEY
from arlens.operators.windows import month_slice, row_number

BLOCK = 1000
KEY = ["cliente", "documento", "bloque"]
LANDED = StructType([
    StructField("cliente", StringType()), StructField("documento", StringType()), StructField("bloque", IntegerType()), StructField("n", IntegerType()),
    StructField("debe", MONEY), StructField("haber", MONEY),
    StructField("export", StringType()), StructField("landed_at", LongType()), StructField("marker", BooleanType())])
CHANGES = StructType([StructField("cliente", StringType()), StructField("movimientos", LongType()), StructField("debe", MONEY), StructField("haber", MONEY)])
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def land(led: DataFrame, folder: str, export: str, landed_at: int | None = None) -> None:
    """Append a cleaned ledger as a landing of ``export``, by default as of now. One that
    is older than a landing of that export which is there already changes nothing."""
    spark = led.sparkSession
    landed_at = landed_at or time.time_ns()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    before = None
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        before = spark.read.schema(LANDED).parquet(folder).filter(F.col("export") == export)
        newest = before.agg(F.max("landed_at")).first()[0]
        if newest is not None and newest > landed_at:
            return
    valid = led.filter(F.col("cliente").isNotNull() & (F.col("cliente") != "")).withColumn("documento", F.coalesce("documento", F.lit("")))
    rows = row_number(valid.select("cliente", "documento", "fecha", "orden_origen", "debe", "haber"), ["cliente", "documento"],
                      [F.col("fecha").asc_nulls_first(), F.col("orden_origen")], "n", month_slice("fecha"))
    money = [F.coalesce(F.col(c), F.lit(0)).cast(MONEY).alias(c) for c in ("debe", "haber")]
    rows = rows.select("cliente", "documento", F.floor((F.col("n") - 1) / BLOCK).cast("int").alias("bloque"), F.col("n").cast("int").alias("n"), *money)
    marks = rows.select(*KEY)
    if before is not None:
        marks = marks.unionByName(before.select(*KEY))
    marks = marks.distinct().select(*KEY, *[F.lit(None).cast(LANDED[c].dataType).alias(c) for c in ("n", "debe", "haber")])
    out = rows.withColumn("marker", F.lit(False)).unionByName(marks.withColumn("marker", F.lit(True)))
    out.withColumns({"export": F.lit(export), "landed_at": F.lit(landed_at).cast("long")}).select(*LANDED.fieldNames()).write.mode("append").parquet(folder)


def _totals(held: dict[str, tuple]) -> tuple[int, Decimal, Decimal]:
    """Movements, debit and credit of a block: of each number the latest export's movement."""
    latest: dict[int, tuple] = {}
    for export, (landed, numbers, debe, haber) in held.items():
        for n, d, h in zip(numbers, debe, haber):
            if n not in latest or latest[n][0] < (landed, export):
                latest[n] = ((landed, export), Decimal(d), Decimal(h))
    return len(latest), sum((x[1] for x in latest.values()), Decimal(0)), sum((x[2] for x in latest.values()), Decimal(0))


class Movements(StatefulProcessor):
    """A block's movements by export, and the changes of its totals."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        value = StructType([StructField("landed_at", LongType()), StructField("n", ArrayType(IntegerType())),
                            StructField("debe", ArrayType(StringType())), StructField("haber", ArrayType(StringType()))])
        self.held = handle.getMapState("held", StructType([StructField("export", StringType())]), value)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: (v[0], list(v[1]), list(v[2]), list(v[3])) for k, v in self.held.iterator()}
        before = _totals(held)
        touched = set()
        for r in rows:
            landed, numbers, debe, haber = held.get(r.export, (-1, [], [], []))
            if r.landed_at < landed:
                continue
            if r.landed_at > landed:
                landed, numbers, debe, haber = held[r.export] = (r.landed_at, [], [], [])
                touched.add(r.export)
            if not r.marker and r.n not in numbers:
                numbers.append(r.n)
                debe.append(str(r.debe))
                haber.append(str(r.haber))
                touched.add(r.export)
        for export in touched:
            self.held.updateValue((export,), held[export])
        after = _totals(held)
        if after != before:
            yield Row(cliente=key[0], movimientos=after[0] - before[0], debe=after[1] - before[1], haber=after[2] - before[2])

    def close(self) -> None:
        pass


def run_movements(spark: SparkSession, folder: str, out: str, checkpoint: str, files_a_batch: int | None = None) -> None:
    """Take in every landed file not yet seen, then stop. The number of state partitions
    is the session's number of shuffle partitions at the first run."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    try:
        reader = spark.readStream.schema(LANDED)
        stream = (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).parquet(folder)
        changes = stream.groupBy(*KEY).transformWithState(statefulProcessor=Movements(), outputStructType=CHANGES, outputMode="Update", timeMode="None")

        def commit(batch: DataFrame, number: int) -> None:
            _sums(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/lote={number}")

        changes.writeStream.foreachBatch(commit).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def _sums(changes: DataFrame) -> DataFrame:
    return changes.groupBy("cliente").agg(F.sum("movimientos").alias("movimientos"), F.sum("debe").cast(MONEY).alias("debe"), F.sum("haber").cast(MONEY).alias("haber"))


def totals(spark: SparkSession, out: str) -> DataFrame:
    """Movements, debit and credit per customer that has any movement."""
    return _sums(spark.read.schema(CHANGES).parquet(out)).filter(F.col("movimientos") > 0)
