"""Operators on cells alone: masking, summaries, completeness, coarser grids."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.shared import few_tiles, small_batches


def mask_nodata(cells: DataFrame, nodata: str | float | Column | None = None) -> DataFrame:
    """Null in place of the sentinel and of NaN, which sums and maxima would otherwise spread."""
    sentinel = nodata if isinstance(nodata, Column) else F.lit(None if nodata is None else float(nodata)).cast("double")
    value = F.col("value")
    return cells.withColumn("value", F.when(F.isnan(value) | F.coalesce(value == sentinel, F.lit(False)), None).otherwise(value))


def raster_summary(cells: DataFrame) -> DataFrame:
    """One row: cells, valid, nodata, min, max, mean; one partial row a task is moved."""
    return cells.agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"), (F.count(F.lit(1)) - F.count("value")).alias("nodata"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"))


def observed_shape(cells: DataFrame, meta: DataFrame) -> DataFrame:
    """Rows, columns and cells that occur, beside those declared; one row for each row of `meta`."""
    seen = cells.agg(F.min("row").alias("min_row"), F.max("row").alias("max_row"), F.min("col").alias("min_col"), F.max("col").alias("max_col"), F.count(F.lit(1)).alias("cells"))
    both = meta.select("dataset_name", "width", "height").join(seen, F.lit(True))
    inside = (F.col("min_row") == 0) & (F.col("max_row") == F.col("height") - 1) & (F.col("min_col") == 0) & (F.col("max_col") == F.col("width") - 1)
    return both.withColumn("as_declared", inside & (F.col("cells") == F.col("width") * F.col("height")))


#: Columns of a word of a row's bitmap.
WORD = 64


def grid_words(cells: DataFrame) -> DataFrame:
    """(row, word, n, seen) of each 64 columns of a row that has some: how many cells, and a bitmap of the columns that
    occur. One scan and one aggregate; a task sends a word for 64 cells at best. Columns repeat where n is more than the
    bits that are set. Cells without a place on any grid (a null or negative row or column) are in word -1 of row -1.
    """
    placed = F.coalesce((F.col("row") >= 0) & (F.col("col") >= 0), F.lit(False))
    row, word = F.when(placed, F.col("row")).otherwise(-1), F.when(placed, F.expr(f"col div {WORD}")).otherwise(-1)
    bit = F.when(placed, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("col") % WORD).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    return cells.groupBy(row.cast("int").alias("row"), word.cast("int").alias("word")).agg(F.count(F.lit(1)).alias("n"), F.bit_or(bit).alias("seen"))


def _columns_of(bitmap: Column) -> Column:
    """Places of a word's bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda k: F.expr("1L") == F.call_function("shiftrightunsigned", bitmap, k).bitwiseAND(F.lit(1).cast("bigint")))


def _on_grid(words: DataFrame, width: int, height: int) -> DataFrame:
    """Words of the grid itself, their bits beyond its last column cut off; `full` has the bits that a whole word has."""
    left = F.lit(width) - F.col("word") * WORD
    full = F.when(left >= WORD, F.lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.least(left, F.lit(WORD - 1)), F.lit(0)).cast("int")) - 1)
    held = words.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("word") >= 0) & (left > 0)).withColumn("full", full)
    return held.withColumn("seen", F.col("seen").bitwiseAND(F.col("full")))


def completeness(words: DataFrame, width: int, height: int) -> DataFrame:
    """One row, from the words alone: `missing_cells`, positions of the grid without a cell, and `repeats`, cells beyond
    the first at their position, wherever that is.
    """
    there = _on_grid(words, width, height).agg(F.coalesce(F.sum(F.bit_count("seen")), F.lit(0)).alias("there"))
    repeats = words.filter("row >= 0").agg(F.coalesce(F.sum(F.col("n") - F.bit_count("seen")), F.lit(0)).alias("repeats"))
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(there).join(one(repeats), "one").select((F.lit(width * height) - F.col("there")).alias("missing_cells"), "repeats")


def duplicate_cells(cells: DataFrame, width: int, words: DataFrame | None = None) -> DataFrame:
    """Positions that occur more than once, and how often; single cells are counted in words with repeats only, which one
    semi-join finds. Give `grid_words` where they are known.
    """
    words = grid_words(cells) if words is None else words
    at = words.filter((F.col("row") >= 0) & (F.col("n") > F.bit_count("seen")) & (F.col("word") * WORD < width)).select("row", "word")
    bad = cells.select("row", "col", F.expr(f"col div {WORD}").cast("int").alias("word")).filter(F.col("col").between(0, width - 1)).join(at, ["row", "word"], "left_semi")
    return bad.groupBy("row", "col").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def missing_cells(cells: DataFrame, width: int, height: int, words: DataFrame | None = None) -> DataFrame:
    """Positions of the grid without a row, read off the complement of bitmaps; cells are scanned once, and not at all
    where `words`, their `grid_words`, are given. Otherwise bitmaps run on from one row to the next, so that a narrow grid
    has no more of them than a wide one. The grid's own words, all empty, are added up with those of the cells.
    """
    line, lines = (width * height, 1) if words is None else (width, height)
    per_line = -(-line // WORD)
    if words is None:
        at = cells.filter(F.col("row").between(0, height - 1) & F.col("col").between(0, width - 1)).select((F.col("row").cast("bigint") * width + F.col("col")).alias("at"))
        held = at.select(F.expr(f"at div {WORD}").alias("key"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("at") % WORD).cast("int")).alias("seen"))
    else:
        held = words.filter(F.col("row").between(0, height - 1) & F.col("word").between(0, per_line - 1)).select((F.col("row").cast("bigint") * per_line + F.col("word")).alias("key"), "seen")
    grid = cells.sparkSession.range(lines * per_line).select(F.col("id").alias("key"), F.lit(0).cast("bigint").alias("seen"))
    whole = held.unionByName(grid).groupBy("key").agg(F.bit_or("seen").alias("seen"))
    # The last word of a line may end before its last bit.
    left = F.lit(line) - F.col("key") % per_line * WORD
    full = F.when(left >= WORD, F.lit(-1).cast("bigint")).otherwise(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.least(left, F.lit(WORD - 1)).cast("int")) - 1)
    gaps = whole.select("key", full.bitwiseAND(F.bitwise_not("seen")).alias("gaps")).filter("gaps != 0").select("key", F.explode(_columns_of(F.col("gaps"))).alias("k"))
    place = gaps.select((F.expr(f"key div {per_line}") * line + F.col("key") % per_line * WORD + F.col("k")).alias("at"))
    return place.select(F.expr(f"cast(at div {width} as int)").alias("row"), (F.col("at") % width).cast("int").alias("col"))


MEASURES = ("cells", "valid", "min", "max", "sum", "min_row", "max_row", "min_col", "max_col")


def _measures() -> list[Column]:
    value = F.col("value")
    return [F.count(F.lit(1)).alias("cells"), F.count(value).alias("valid"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), *[f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("min", F.min), ("max", F.max))]]


def examined(cells: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, dict]:
    """`grid_words`, computed once by `keep` (such as `settle`), and `MEASURES` of the same scan.

    A stage that is run again after a lost executor may report its metrics twice. The words are exact in any case, so
    where the two counts differ, cells are measured by a scan of their own.
    """
    seen = Observation()
    words = keep(grid_words(cells.observe(seen, *_measures())))
    there = words.agg(F.sum("n").alias("n")).first().n
    found = seen.get if there else None  # nothing is observed of a table that Spark knows to be empty
    if not found or found["cells"] != there:
        found = cells.agg(*_measures()).first().asDict()
    return words, {c: found[c] for c in MEASURES}


def block_aggregate(cells: DataFrame, k: int, ky: int | None = None) -> DataFrame:
    """Blocks of k columns and ky rows (k, if not given) as one coarse cell: sum, mean and number of valid values; null
    where none is valid.
    """
    return cells.groupBy(F.expr(f"row div {ky or k}").cast("int").alias("row"), F.expr(f"col div {k}").cast("int").alias("col")).agg(F.sum("value").alias("value"), F.avg("value").alias("mean"), F.count("value").alias("valid"))


def block_aggregate_tiles(tiles: DataFrame, tile_w: int, tile_h: int, k: int, nodata: float | None = None, width: int | None = None, height: int | None = None) -> DataFrame:
    """The same from tiles whose sides k divides: blocks then never cross tiles, so nothing is moved.

    NaN, null and `nodata` are no values; a tile without values has none. Given the grid's size, pixels beyond it count
    for nothing, and blocks beyond it do not come out.
    """
    if tile_w % k or tile_h % k:
        raise ValueError("k must divide both sides of a tile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_tiles(batches, tile_h * tile_w):
            n, lists = batch.num_rows, batch.column("values")
            values = np.full((n, tile_h * tile_w), np.nan)
            if (some := np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))).size:
                values[some] = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(some), -1)
            blocks = values.reshape(n, tile_h // k, k, tile_w // k, k)
            if nodata is not None:
                blocks = np.where(blocks == nodata, np.nan, blocks)
            at_row, at_col = (np.asarray(batch.column(c), np.int64) for c in ("tile_row", "tile_col"))
            inside = np.ones(1, bool)
            if height is not None:
                inside = inside & ((at_row[:, None] * tile_h + np.arange(tile_h)).reshape(n, tile_h // k, k)[:, :, :, None, None] < height)
            if width is not None:
                inside = inside & ((at_col[:, None] * tile_w + np.arange(tile_w)).reshape(n, tile_w // k, k)[:, None, None, :, :] < width)
            ok = ~np.isnan(blocks) & inside
            valid, total = ok.sum(axis=(2, 4)), np.where(ok, blocks, 0).sum(axis=(2, 4))
            shape, out = valid.shape, np.broadcast_to(inside, blocks.shape).any(axis=(2, 4)).ravel()
            row = np.broadcast_to(at_row[:, None, None] * (tile_h // k) + np.arange(tile_h // k)[None, :, None], shape)
            col = np.broadcast_to(at_col[:, None, None] * (tile_w // k) + np.arange(tile_w // k)[None, None, :], shape)
            flat = lambda a, t, mask=None: pa.array(a.ravel()[out], t, mask=None if mask is None else mask.ravel()[out])  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([flat(row, pa.int32()), flat(col, pa.int32()), flat(total, pa.float64(), valid == 0), flat(total / np.maximum(valid, 1), pa.float64(), valid == 0), flat(valid, pa.int64())], names=["row", "col", "value", "mean", "valid"])

    small_batches(tiles.sparkSession)
    return tiles.select("tile_row", "tile_col", "values").mapInArrow(run, "row int, col int, value double, mean double, valid bigint")
