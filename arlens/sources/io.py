"""Sinks and sources of the products (S7-S12): table write with full replace,
load by name (parquet, else csv, else nothing), CSV export, JDBC, run
metadata as key/value rows, JSON state documents."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

META_SCHEMA = "clave string, valor string"


def naive_timestamps(df: DataFrame) -> DataFrame:
    """Zone-aware timestamps become wall-clock ``timestamp_ntz`` (what a
    database column without zone stores)."""
    return df.select(*[F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, TimestampType)
                       else F.col(f.name) for f in df.schema.fields])


def save(df: DataFrame, base: str, name: str, partition_by: list[str] | None = None,
         observe_rows: bool = False) -> int | None:
    """Write ``df`` as ``{base}/{name}`` parquet, replacing what was there.

    With ``observe_rows`` the row count is collected by an ``Observation``
    during the same write (no second pass) and returned.
    """
    obs = Observation(f"rows_{name}") if observe_rows else None
    out = naive_timestamps(df)
    if obs is not None:
        out = out.observe(obs, F.count(F.lit(1)).alias("n"))
    w = out.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{base.rstrip('/')}/{name}")
    return int(obs.get["n"]) if obs is not None else None


def load(spark: SparkSession, base: str, name: str, csv_schema: str | None = None) -> DataFrame | None:
    """Load a product by name: ``{name}`` parquet folder, else ``{name}.csv``
    with a header, else ``None``."""
    root = base.rstrip("/")
    for cand in (f"{root}/{name}", f"{root}/{name}.parquet"):
        if _exists(spark, cand):
            return spark.read.parquet(cand)
    csv = f"{root}/{name}.csv"
    if _exists(spark, csv):
        r = spark.read.option("header", True)
        r = r.schema(csv_schema) if csv_schema else r.option("inferSchema", True)
        return r.csv(csv)
    return None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export with a header row (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def run_meta(df: DataFrame, extra: dict[str, str]) -> DataFrame:
    """Run metadata ``(clave, valor)``: the product's row count plus ``extra``."""
    n = df.agg(F.count(F.lit(1)).cast("string").alias("valor")).select(F.lit("filas").alias("clave"), "valor")
    spark = df.sparkSession
    kv = spark.createDataFrame([(k, str(v)) for k, v in extra.items()], META_SCHEMA)
    return n.unionByName(kv)


def save_meta(spark: SparkSession, base: str, meta: dict[str, str]) -> None:
    spark.createDataFrame([(k, str(v)) for k, v in meta.items()], META_SCHEMA) \
        .coalesce(1).write.mode("overwrite").parquet(f"{base.rstrip('/')}/meta")


def load_meta(spark: SparkSession, base: str) -> dict[str, str]:
    df = load(spark, base, "meta")
    return {} if df is None else {r["clave"]: r["valor"] for r in df.collect()}


def save_state(spark: SparkSession, base: str, key: str, doc_json: str) -> None:
    """Store a JSON state document (permissions, UI filters) under ``key``."""
    spark.createDataFrame([(key, doc_json)], META_SCHEMA).coalesce(1) \
        .write.mode("overwrite").parquet(f"{base.rstrip('/')}/state_{key}")


def load_state(spark: SparkSession, base: str, key: str, env_var: str | None = None,
               default: str = "{}") -> DataFrame:
    """State document as a one-row ``(clave, valor)`` frame: stored table,
    else the JSON text in ``env_var``, else ``default``."""
    df = load(spark, base, f"state_{key}")
    if df is not None:
        return df
    text = os.environ.get(env_var, "") if env_var else ""
    return spark.createDataFrame([(key, text or default)], META_SCHEMA)


def jdbc_write(df: DataFrame, url: str, table: str, props: dict[str, str]) -> None:
    """Full replace of a database table (truncate keeps the table definition)."""
    (naive_timestamps(df).write.mode("overwrite").option("truncate", "true")
     .jdbc(url, table, properties=props))


def jdbc_read(spark: SparkSession, url: str, table: str, props: dict[str, str],
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              partitions: int = 8) -> DataFrame:
    """Read a table; with a numeric ``partition_column`` and bounds the read is
    split into ``partitions`` parallel range queries."""
    if partition_column is not None:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=partitions, properties=props)
    return spark.read.jdbc(url, table, properties=props)
