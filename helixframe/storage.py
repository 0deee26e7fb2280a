"""Shared storage for intermediate tables, and what Python workers need to import this package."""

from __future__ import annotations

import logging
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch at most, since a row may hold a whole text; a batch of one row may be larger.
BATCH_ROWS = 1000
BATCH_BYTES = 16 << 20
_DEFAULT_BYTES = "67108864b"  # Spark's; another value was set on purpose
#: Spark's setting to delete the shuffle files of a query when it has ended; else they stay until the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
LOG = logging.getLogger("helixframe")
_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + os.path.join(tempfile.gettempdir(), "helixframe-shared")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/helixframe/{label}-{uuid.uuid4().hex}"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries in this block leave no shuffle files: the loops here make many queries and little garbage, so files of all would add up."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, label: str, part: str | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    part: its last column, by whose values the table is split into folders, which drop_part() deletes one by one. Each table's
    label and seconds go to the log at level INFO, so every round of a loop shows there.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    began = time.monotonic()
    with shuffles_dropped(spark):
        (df.write.partitionBy(part) if part else df.write).parquet(path)
    LOG.info("%s: %.1f s", label, time.monotonic() - began)
    made = spark.read.schema(df.schema).parquet(path)
    made.staged_path = path
    return made


def drop(*tables: DataFrame) -> None:
    """Delete what stage() wrote for these tables, of which nothing will be read any more."""
    for df in tables:
        if path := getattr(df, "staged_path", None):
            drop_path(df.sparkSession, path)


def drop_part(df: DataFrame, part: str, value: str) -> None:
    """Delete the rows with that value of a table that stage() has split."""
    drop_path(df.sparkSession, f"{df.staged_path}/{part}={value}")


def drop_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def prepare(spark: SparkSession) -> None:
    """Before Python tasks: small Arrow batches, and workers that import this package also where the driver only extended sys.path."""
    env = spark.sparkContext.environment
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == _DEFAULT_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, env.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
