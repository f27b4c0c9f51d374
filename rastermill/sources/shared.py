"""Tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from `spark.checkpoint.dir`. Where the session names none, only a driver
    that runs everything itself, as in tests, gets a temporary one.
    """
    context = spark.sparkContext
    have = context._jsc.sc().getCheckpointDir()
    where = spark.conf.get("spark.checkpoint.dir", None) or (have.get() if have.isDefined() else None)
    if not where:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="checkpoint-")
    if not have.isDefined():
        context.setCheckpointDir(where)
    return where


#: Bytes in one Arrow batch between Spark and a Python worker, at most; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """A session whose Arrow batches may be larger than `BATCH_BYTES` gets that limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)


#: Pixels of tiles that a worker unpacks at a time; a larger tile is unpacked by itself.
PIXELS = 1 << 19


def few_tiles(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Batches of tiles of `size` pixels each, in slices of about `PIXELS`."""
    step = max(1, PIXELS // size)
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


def settle(df: DataFrame) -> DataFrame:
    """Computes a table once and cuts its lineage; the rows lie in the shared folder and outlive executors. Spark
    removes them with `spark.cleaner.referenceTracking.cleanCheckpoints` once nothing refers to them.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
