"""Intermediate tables in the shared checkpoint folder, and the disk they take.

A job of many steps writes each step's table and reads it back. Spark keeps the shuffle
files of a finished job until the driver happens to collect its garbage, which may be never
while a large job runs, so they would add up to several times the input. Here they go when
the step's table is there, and a table that no later step reads is deleted."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from arlens.session import checkpoint_dir

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/arlens-llm/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Jobs inside leave no shuffle files: each one's go with its end."""
    before = spark.conf.get(_FREE, "false")
    spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(_FREE, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    costs only its own tasks, and gives later plans column pruning and a size
    known from the files (Spark broadcasts it only below its own threshold).
    """
    path = shared_path(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._arlens_path = path
    return out


def dispose(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` returned and nothing will read any more.
    Other frames are left alone."""
    for df in tables:
        path = getattr(df, "_arlens_path", None)
        if path:
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
