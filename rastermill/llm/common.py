"""What the training-data operators share: Arrow batches, word hashing, tables that outlive an executor."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import settle, shared_dir, small_batches

#: A word is a run of code points other than space and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_CHUNK = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


mix64 = _mix
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = np.uint64(0x9E6C63D0876A9A47)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n - 1, 0), _BASE)]))


def _cuts(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Slices of about a megabyte that end before white space, so that no word is torn."""
    while lo < hi:
        end = min(hi, lo + _CHUNK)
        while end < hi and not _SPACE[data[end]]:
            step = np.flatnonzero(_SPACE[data[end : min(hi, end + _CHUNK)]])
            end = end + int(step[0]) if len(step) else min(hi, end + _CHUNK)
        yield lo, end
        lo = end


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each word of a text given as UTF-8 bytes, in order."""
    parts = []
    for lo, hi in _cuts(data, 0, len(data)):
        piece = data[lo:hi]
        at = np.flatnonzero(~_SPACE[piece])
        if not len(at):
            continue
        first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
        length = np.diff(first, append=len(at))
        place = np.arange(len(at)) - np.repeat(first, length)
        values = _BYTE[piece[at]] * _powers(int(length.max()))[place]
        parts.append(_mix(np.add.reduceat(values, first) + length.astype(np.uint64)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; a shorter text is one run of all its words."""
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = _mix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + n])
    return out


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 512, after: Callable[[], None] | None = None) -> DataFrame:
    """`mapInArrow` over slices of at most `rows` rows, so that long texts do not pile up in a worker.

    A session whose batches may be larger than `small_batches` allows gets that limit. `after` is called when a partition ends;
    workers live on, so what they have freed is then given back to the system.
    """
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, rows):
                    yield each(batch.slice(lo, rows))
        finally:
            if after:
                after()
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def like(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not use, whatever its letters' case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Intermediate tables of one operator call: Parquet in the shared folder, deleted together when the block ends,
    by an error too.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}", 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.folder)

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def numbered(scratch: Scratch, rows: DataFrame, *order: Column | str) -> DataFrame:
    """Adds `place`, a row's number from 0 in the given order, without a sort in one task: ranges are sorted where they
    lie, and only one count a range goes round. Rows equal in all of `order` come in some order.
    """
    placed = scratch.keep(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33).alias("part_")
    counts = placed.groupBy(part).agg(F.min("at_").alias("low"), F.count(F.lit(1)).alias("k"))
    before = F.coalesce(F.sum("k").over(W.orderBy("part_").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("part_", (before - F.col("low")).alias("shift_"))  # one row a range
    return placed.withColumn("part_", F.shiftright("at_", 33)).join(F.broadcast(shift), "part_").select(*rows.columns, (F.col("at_") + F.col("shift_")).alias("place"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sha_hex(value: Column | str) -> Column:
    return F.sha2(F.col(value) if isinstance(value, str) else value, 256)
