"""Shared helpers: the work folder that every executor sees, written tables, sizes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Only where that setting is absent (tests on one machine) a temporary folder takes its place."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-work-")
        if not conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan (file sizes for a scan); no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, least: int = 512, bytes_each: int = 128 << 20) -> int:
    """Buckets for a shuffle by content, so that one bucket fits a task at any input size."""
    return max(least, min(-(-plan_bytes(df) // bytes_each), 1 << 22))


def small_side(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast a side whose counted rows stay below the limit; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def trimmed(run):
    """run (batches in, batches out), which gives free memory back to the machine at its end: Python workers outlive their tasks, beside those of other stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except AttributeError:  # another C library
                pass

    return wrapped
