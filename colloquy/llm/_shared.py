"""Small helpers that all operators of this subpackage use."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table of documents."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session in one process (master local) gets a folder of its own; on a cluster that is an error,
    as executors would not see a machine's own folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def spill(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: later steps neither recompute it nor lose it with an executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_prefix(df: DataFrame, prefix: str) -> str:
    """The prefix, with as many underscores before it as it takes for no column of df to begin with it."""
    while any(c.startswith(prefix) for c in df.columns):
        prefix = "_" + prefix
    return prefix


def partitions(spark: SparkSession) -> int:
    """How many ways this session deals out a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(docs: DataFrame, part_bytes: int) -> int:
    """How many ways to deal out what Python workers gather: as the session says, or more if parts of the input were larger than that.

    The size is Spark's own estimate, which follows the files of a table; without files it is unknown and counts as small.
    """
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), 0 if size >= 1 << 60 else -(-size // part_bytes))


#: Texts in one Arrow batch between Spark and Python, so that a batch of long texts fits beside the executor's heap.
BATCH_ROWS = 2_000


def bounded_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def release_memory() -> None:
    """Gives freed memory of a Python worker back, as the worker stays while other stages need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass
