"""Target-distribution importance resampling on hashed word features.

Features are runs of one to three words, counted in hash buckets over all documents and over all texts of the target. A
document weighs the sum of its features' log ratios, and the draw takes the highest weights after Gumbel noise, which is
a draw without replacement by weight.

Texts are skewed in length, so long ones are cut into chunks that overlap: a chunk owns `CHUNK_WORDS` starting positions
and carries the following `RUN` - 1 words, so that every feature is seen by one chunk, whole. Chunks are dealt to all
tasks, and their counts and weights are summed by document.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_batches, numbered, read, settle

#: Words in the longest feature; hash buckets.
RUN, BUCKETS = 3, 10_000
#: Starting positions of a chunk; longer texts than so many code points are cut.
CHUNK_WORDS, LONG_CHARS = 4096, 32_768
#: Share drawn, in percent, of the documents with at least so many words.
PERCENT, LEAST_WORDS = 5, 20
SEED = 42

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of code points beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _byte_table() -> np.ndarray:
    """CRC-32 of one byte from register 0 (reflected polynomial 0xEDB88320)."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, c >> 1 ^ np.uint32(0xEDB88320), c >> 1)
    return c


_STEP = _byte_table()
#: Longest run of zero bytes that one lookup appends.
_FAR = 64


def _zeros_table() -> np.ndarray:
    """[n, k, b]: what byte k of a checksum contributes once n zero bytes follow; checksums are linear."""
    out = np.empty((_FAR + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(_FAR):
        out[n + 1] = _STEP[out[n] & 255] ^ out[n] >> 8
    return out


_ZEROS = _zeros_table()


def _followed(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """What a checksum contributes to that of a longer string, `by` bytes later."""
    step = np.minimum(by, _FAR)
    out = _ZEROS[step, 0, crc & 255] ^ _ZEROS[step, 1, crc >> 8 & 255] ^ _ZEROS[step, 2, crc >> 16 & 255] ^ _ZEROS[step, 3, crc >> 24]
    far = np.flatnonzero(by > _FAR)
    if len(far):
        out[far] = _followed(out[far], by[far] - _FAR) if len(far) > 16 else [_far(int(c), int(n)) for c, n in zip(out[far], by[far] - _FAR, strict=True)]
    return out


def _far(crc: int, by: int) -> int:
    """The same for one checksum; the difference of two checksums drops what they have in common."""
    zeros = bytes(min(by, 1 << 20))
    other = 0
    while by:
        piece = zeros[:by]
        crc, other, by = zlib.crc32(piece, crc), zlib.crc32(piece, other), by - len(piece)
    return crc ^ other


def _word_crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of each word, a byte of all words at a time; long words one by one."""
    order = np.argsort(-np.minimum(length, _FAR + 1), kind="stable")
    at, size = start[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    longer = np.searchsorted(-size, -np.arange(1, _FAR + 1), side="right")
    for k in range(int(min(size[0], _FAR)) if len(size) else 0):
        n = longer[k]
        crc[:n] = _STEP[(crc[:n] ^ data[at[:n] + k]) & 255] ^ crc[:n] >> 8
    crc = ~crc
    for i in range(int(np.searchsorted(-size, -_FAR, side="left"))):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each word of lower-cased UTF-8 bytes."""
    edge = np.diff(_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start = np.flatnonzero(edge == 1)
    return start, np.flatnonzero(edge == -1) - start


class Features:
    """Features of many texts at once: for each word its text (`row`), its place there and the checksums of the runs that
    start with it; `there[k]` says where a run of k + 1 words exists.
    """

    def __init__(self, texts: list[bytes | None]):
        data = _LOWER[np.frombuffer(b"\0".join([*(t or b"" for t in texts), b""]), np.uint8)]
        start, length = words_of(data)
        size = np.array([len(t or b"") + 1 for t in texts], np.int64)
        self.bounds = np.searchsorted(start, np.concatenate([[0], np.cumsum(size)]))
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        self.place = np.arange(len(start)) - self.bounds[self.row]
        word = _word_crcs(data, start, length)
        # A word after a space: the space's checksum, moved on, joined with the word's.
        spaced = _followed(np.full(len(word), zlib.crc32(b" "), np.uint32), length) ^ word
        self.crc, self.there = [word], [np.ones(len(word), bool)]
        for k in range(1, RUN):
            n = max(len(word) - k, 0)
            longer = np.zeros(len(word), np.uint32)
            longer[:n] = _followed(self.crc[-1][:n], length[k:] + 1) ^ spaced[k:]
            same = np.zeros(len(word), bool)
            same[:n] = self.row[k:] == self.row[:n]
            self.crc.append(longer)
            self.there.append(same)

    def owned(self, own: np.ndarray) -> np.ndarray:
        """Words that start features of their row: the first `own`, all where that is negative."""
        limit = own[self.row]
        return (limit < 0) | (self.place < limit)


def bucket_of(crc: np.ndarray) -> np.ndarray:
    return (crc % np.uint32(BUCKETS)).astype(np.int64)


def _cut(texts: DataFrame) -> DataFrame:
    """(row, chunk, own, data): each long text as chunks, dealt to all tasks. `texts` has row and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text"), strict=True):
                raw = text.as_py().encode("utf-8", "surrogatepass")
                start, length = words_of(_LOWER[np.frombuffer(raw, np.uint8)])
                first = range(0, max(len(start), 1), CHUNK_WORDS)  # a text without words is one empty chunk
                for k, lo in enumerate(first):
                    last = min(lo + CHUNK_WORDS + RUN - 1, len(start)) - 1
                    piece = raw[start[lo] : start[last] + length[last]] if len(start) else b""
                    yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), pa.array([k], pa.int64()), pa.array([min(CHUNK_WORDS, len(start) - lo)], pa.int64()), pa.array([piece], pa.binary())], names=["row", "chunk", "own", "data"])

    return texts.select("row", "text").mapInArrow(run, "row bigint, chunk bigint, own bigint, data binary").repartition("row", "chunk")


def parts_of(scratch: Scratch, docs: DataFrame, *carried: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts to be counted, (own, data): the short ones, with the columns carried, and the chunks of the long ones, with
    the row they belong to; then the long ones' rows. Null text has no words.
    """
    size = F.coalesce(F.length("text"), F.lit(0))
    short = docs.filter(size <= LONG_CHARS).select(*carried, F.lit(-1).cast("bigint").alias("own"), F.col("text").cast("binary").alias("data"))
    # Rows are numbered in a written table, since a recomputed task could number them anew.
    long = scratch.keep(docs.filter(size > LONG_CHARS).select(*carried, "text", F.monotonically_increasing_id().alias("row")))
    return short, scratch.keep(_cut(long)), long.select(*carried, "row")


def bucket_counts(parts: DataFrame) -> np.ndarray:
    """Features of all texts by bucket. A task sends its buckets once, when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                piece = batch.slice(lo, 512)
                found = Features(piece.column("data").to_pylist())
                owned = found.owned(piece.column("own").to_numpy(zero_copy_only=False))
                for crc, there in zip(found.crc, found.there, strict=True):
                    total += np.bincount(bucket_of(crc[owned & there]), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    found = parts.select("own", "data").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in found:  # BUCKETS rows at most
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's log ratio in thousandths, rounded down, with one feature added to every bucket on both sides."""
    s, t = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(parts: DataFrame, gains: np.ndarray, *carried: str) -> DataFrame:
    """The columns carried, n_words, n_features and weight of each text or chunk."""
    kinds = dict(parts.dtypes)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = Features(batch.column("data").to_pylist())
        owned = found.owned(batch.column("own").to_numpy(zero_copy_only=False))
        worth, many = np.zeros(len(owned), np.int64), np.zeros(len(owned), np.int64)
        for crc, there in zip(found.crc, found.there, strict=True):
            mine = owned & there
            worth += np.where(mine, gains[bucket_of(crc)], 0)
            many += mine
        by_row = [np.diff(np.concatenate([[0], np.cumsum(x, dtype=np.int64)])[found.bounds]) for x in (owned, many, worth)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *(pa.array(x, pa.int64()) for x in by_row)], names=[*carried, "n_words", "n_features", "weight"])

    return map_batches(parts.select(*carried, "own", "data"), each, ", ".join([*(f"{c} {kinds[c]}" for c in carried), "n_words bigint", "n_features bigint", "weight bigint"]))


def score_documents(scratch: Scratch, docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every row; a null id counts as empty text in the noise."""
    short, chunks, rows = parts_of(scratch, docs, "doc_id")
    other_short, other_chunks, _ = parts_of(scratch, target)
    counts = [bucket_counts(a.select("own", "data").unionByName(b.select("own", "data"))) for a, b in ((short, chunks), (other_short, other_chunks))]
    gains = gains_of(*counts)
    sums = weigh(chunks, gains, "row").groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])
    weighed = weigh(short, gains, "doc_id").unionByName(rows.join(sums, "row").drop("row"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")
    return weighed.withColumn("score", F.col("weight") + noise)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row: 1, 2, 3 ... for those drawn, else null.

    Drawn are the highest scores of the texts with at least `LEAST_WORDS` words, `percent` of these, rounded down; ties
    go to the smaller id, then to fewer features. Repeated rows are drawn one by one. Null and empty texts have no
    features and weigh 0; a target without texts has only the added features. An empty table gives no rows. Other
    columns are not read, whatever their names.
    """
    with Scratch(docs.sparkSession) as scratch:
        scored = scratch.keep(score_documents(scratch, docs.select("doc_id", "text"), target.select("text")))
        able = F.col("n_words") >= LEAST_WORDS
        take = percent * scored.filter(able).count() // 100
        placed = numbered(scratch, scored.filter(able), F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"))
        rank = F.when(F.col("place") < take, F.col("place") + 1)
        return settle(placed.select("doc_id", "n_features", "weight", "score", rank.alias("rank")).unionByName(scored.filter(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution."""
    return resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
