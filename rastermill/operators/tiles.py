"""Operators on tiles that make no row of a pixel: totals by zone from prefix sums, and blocks that cross tile borders.

A tile is (tile_row, tile_col, values), the rows of its pixels one after another; tiles at the right and lower border may
reach beyond the grid.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import Fixed, joined
from ..sources.shared import small_batches
from .zones import SMALL_SPANS


@dataclass(frozen=True)
class Tiles:
    """A table of tiles and their size."""

    frame: DataFrame
    width: int
    height: int


def pixels_of(values: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Which tiles have a list, and their pixels as doubles, null as NaN."""
    some = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(some) * size:
        raise ValueError(f"a tile must have {size} pixels")
    return some, flat.astype(np.float64).reshape(len(some), size)


def spans_by_tile(spans: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """(tile_row, tile_col, spans): the parts of spans (zone_id, row, c0, c1) in each tile, within its own rows and
    columns. A tile has at most its height times the zones that meet a row of it, and twice that for each hole.
    """
    at = spans.select("zone_id", "row", "c0", "c1", F.explode(F.sequence(F.expr(f"c0 div {tile_w}"), F.expr(f"(c1 - 1) div {tile_w}"))).alias("t"))
    left = F.col("t") * tile_w
    part = F.struct("zone_id", (F.col("row") % tile_h).cast("int").alias("r"), F.greatest(F.col("c0") - left, F.lit(0)).cast("int").alias("a"), F.least(F.col("c1") - left, F.lit(tile_w)).cast("int").alias("b"))
    return at.groupBy(F.expr(f"row div {tile_h}").cast("int").alias("tile_row"), F.col("t").cast("int").alias("tile_col")).agg(F.collect_list(part).alias("spans"))


#: Columns whose extremes are taken together.
GROUP = 16


class _Extremes:
    """Minimum and maximum over any run of a row: those of `GROUP` columns each make a table whose level k holds those of
    2 ** k groups, so the whole groups of a run take two look-ups, and what is left at its ends is looked at itself.
    """

    def __init__(self, values: np.ndarray, ok: np.ndarray):
        wide = -values.shape[1] % GROUP
        self.plain = [np.pad(np.where(ok, values, none), ((0, 0), (0, wide + GROUP)), constant_values=none) for none in (np.inf, -np.inf)]
        self.tables = [[choose.reduce(x.reshape(len(x), -1, GROUP), axis=2)] for x, choose in zip(self.plain, (np.minimum, np.maximum), strict=True)]

    def of(self, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = -(-a // GROUP), b // GROUP
        whole = np.flatnonzero(first < last)
        level = np.frexp((last - first)[whole].astype(np.float64))[1] - 1
        out = []
        for plain, table, choose, none in zip(self.plain, self.tables, (np.minimum, np.maximum), (np.inf, -np.inf), strict=True):
            for k in range(len(table), int(level.max(initial=0)) + 1):
                half = 1 << (k - 1)
                table.append(choose(table[-1][:, :-half], table[-1][:, half:]))
            found = np.full(len(row), none)
            for k in np.unique(level).tolist():
                at = whole[level == k]
                found[at] = choose(table[k][row[at], first[at]], table[k][row[at], last[at] - (1 << k)])
            for lo, hi in ((a, np.minimum(b, first * GROUP)), (np.maximum(a, last * GROUP), b)):
                column = lo[:, None] + np.arange(GROUP)
                ends = np.where(column < hi[:, None], plain[row[:, None], column], none)
                found = choose(found, choose.reduce(ends, axis=1))
            out.append(found)
        return out[0], out[1]


def _tile_sums(values: np.ndarray, zone: np.ndarray, zones: int, row: np.ndarray, a: np.ndarray, b: np.ndarray, fixed: Fixed, weight: np.ndarray | None) -> dict[str, np.ndarray]:
    """Sums by zone of one tile: each span is the difference of two entries of running sums along its row."""
    ok = ~np.isnan(values)

    def of_spans(each: np.ndarray) -> np.ndarray:
        running = np.zeros((each.shape[0], each.shape[1] + 1), each.dtype)
        np.cumsum(each, axis=1, out=running[:, 1:])
        return running[row, b] - running[row, a]

    def by_zone(each: np.ndarray) -> np.ndarray:
        out = np.zeros(zones, each.dtype)
        np.add.at(out, zone, each)
        return out

    out = {"cells": by_zone((b - a).astype(np.int64)), "valid": by_zone(count := of_spans(ok.astype(np.int64)))}
    known = np.where(ok, values, 0.0)
    for name, numbers, bits in (("units", known, fixed.bits), ("squares", known * known, fixed.square_bits)):
        for half, part in zip(("upper", "lower"), fixed.halves(numbers, bits), strict=True):
            out[f"{name}_{half}"] = by_zone(of_spans(part)) if part.any() else np.zeros(zones, np.int64)
    low, high = _Extremes(values, ok).of(row, a, b)
    least, most = np.full(zones, np.inf), np.full(zones, -np.inf)
    np.minimum.at(least, zone, low)
    np.maximum.at(most, zone, high)
    out["min"], out["max"] = least, most
    if weight is not None:
        out["weight"] = by_zone(weight[row] * count)
        out["weighted"] = by_zone(weight[row] * of_spans(known))
        out["weighted_squares"] = by_zone(weight[row] * of_spans(known * known))
    return out


def zonal_sums_of_tiles(tiles: Tiles, spans: DataFrame, nodata: float | None = None, fixed: Fixed | None = None, row_weight: Callable[[np.ndarray], np.ndarray] | None = None, count: int | None = None) -> DataFrame:
    """Per zone: cells, valid, units, squares, min, max as `fixed.exact_sums` has them, from tiles as they lie; with
    `row_weight`, a function of the grid's rows, weight, weighted and weighted_squares besides.

    Few enough spans go to every executor, and tiles stay where they are; else both sides are joined by tile. A task
    sends one row a tile and zone. NaN, null and `nodata` are no values; a tile without a list has no cells.
    """
    fixed = fixed or Fixed()
    tile_w, tile_h = tiles.width, tiles.height
    few = (spans.count() if count is None else count) <= SMALL_SPANS
    side = spans_by_tile(spans.select("zone_id", "row", "c0", "c1").distinct(), tile_w, tile_h)
    names = ["cells", "valid", "units_upper", "units_lower", "squares_upper", "squares_lower"]
    real = ["min", "max", *(["weight", "weighted", "weighted_squares"] if row_weight else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tile = batch.slice(i, 1)
                some, pixels = pixels_of(tile.column("values"), tile_w * tile_h)
                if not len(some):
                    continue
                values = pixels[0].reshape(tile_h, tile_w)
                if nodata is not None:
                    values = np.where(values == nodata, np.nan, values)
                flat = tile.column("spans").flatten()
                ids = flat.field("zone_id").dictionary_encode()
                row, a, b = (flat.field(c).to_numpy() for c in ("r", "a", "b"))
                top = tile.column("tile_row")[0].as_py() * tile_h
                sums = _tile_sums(values, ids.indices.to_numpy(), len(ids.dictionary), row, a, b, fixed, row_weight(top + np.arange(tile_h)) if row_weight else None)
                none = sums["valid"] == 0
                columns = [*(pa.array(sums[c], pa.int64()) for c in names), *(pa.array(sums[c], pa.float64(), mask=none if c in ("min", "max") else None) for c in real)]
                yield pa.RecordBatch.from_arrays([ids.dictionary.cast(pa.string()), *columns], names=["zone_id", *names, *real])

    small_batches(tiles.frame.sparkSession)
    met = tiles.frame.select("tile_row", "tile_col", "values").join(F.broadcast(side) if few else side, ["tile_row", "tile_col"])
    parts = met.select("tile_row", "values", "spans").mapInArrow(run, ", ".join(["zone_id string", *(f"{c} bigint" for c in names), *(f"{c} double" for c in real)]))
    whole = lambda c: joined(F.sum(F.col(f"{c}_upper").cast("decimal(20,0)")).cast("decimal(20,0)"), F.sum(F.col(f"{c}_lower").cast("decimal(20,0)")).cast("decimal(20,0)")).alias(c)
    return parts.groupBy("zone_id").agg(F.sum("cells").alias("cells"), F.sum("valid").alias("valid"), whole("units"), whole("squares"), F.min("min").alias("min"), F.max("max").alias("max"), *[F.sum(c).alias(c) for c in real[2:]])


def _blocks(tiles: Tiles, k: int, nodata: float | None, width: int | None, height: int | None, whole: bool, fixed: Fixed) -> DataFrame:
    """(row, col, upper, lower, valid) of a tile's own part of each block, its sum in halves of a whole number: of the
    blocks that lie in it whole, or of the others. A block that ends with the grid is whole if the tile holds all that
    the grid has of it.
    """
    tile_w, tile_h = tiles.width, tiles.height

    def cut(first: int, size: int, end: int | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """How many of the tile's rows (or columns) the grid has, where blocks start in them, their numbers, whether the
        tile holds all of each.
        """
        n = size if end is None else max(min(size, end - first), 0)
        number = np.arange(first // k, -(-(first + n) // k)) if n else np.zeros(0, np.int64)
        start = np.maximum(number * k - first, 0)
        last = (number + 1) * k if end is None else np.minimum((number + 1) * k, end)
        return n, start, number, (number * k >= first) & (last <= first + n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_row, at_col = (batch.column(c).to_pylist() for c in ("tile_row", "tile_col"))
            for i in range(batch.num_rows):
                rows, cols = cut(at_row[i] * tile_h, tile_h, height), cut(at_col[i] * tile_w, tile_w, width)
                want = rows[3][:, None] & cols[3] if whole else ~(rows[3][:, None] & cols[3])
                if not want.any():
                    continue
                some, pixels = pixels_of(batch.column("values").slice(i, 1), tile_w * tile_h)
                values = pixels[0].reshape(tile_h, tile_w) if len(some) else np.full((tile_h, tile_w), np.nan)
                values = values[: rows[0], : cols[0]]
                ok = ~np.isnan(values) if nodata is None else ~(np.isnan(values) | (values == nodata))
                sums = [np.add.reduceat(np.add.reduceat(x, rows[1], axis=0), cols[1], axis=1)[want] for x in (*fixed.halves(np.where(ok, values, 0.0), fixed.bits), ok.astype(np.int64))]
                number = np.broadcast_to(rows[2][:, None], want.shape)[want], np.broadcast_to(cols[2], want.shape)[want]
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in number), *(pa.array(x, pa.int64()) for x in sums)], names=["row", "col", "upper", "lower", "valid"])

    small_batches(tiles.frame.sparkSession)
    return tiles.frame.select("tile_row", "tile_col", "values").mapInArrow(run, "row int, col int, upper bigint, lower bigint, valid bigint")


def block_aggregate_any(tiles: Tiles, k: int, nodata: float | None = None, width: int | None = None, height: int | None = None, fixed: Fixed | None = None) -> DataFrame:
    """(row, col, value, mean, valid) of k x k blocks, whatever k is: blocks that a tile holds whole stay where they are,
    and only the parts of blocks that cross a border are moved and added. With k dividing both sides nothing moves. Sums
    are exact, so it does not matter which part comes first.

    NaN, null and `nodata` are no values; a block without values has a null sum. Pixels beyond the grid's size count for
    nothing, and blocks beyond it do not come out.
    """
    fixed = fixed or Fixed()
    out = _blocks(tiles, k, nodata, width, height, True, fixed)
    if tiles.width % k or tiles.height % k:
        parts = _blocks(tiles, k, nodata, width, height, False, fixed)
        out = out.unionByName(parts.groupBy("row", "col").agg(*[F.sum(c).alias(c) for c in ("upper", "lower", "valid")]))
    some = F.when(F.col("valid") > 0, joined(F.col("upper"), F.col("lower")).cast("double") / float(2**fixed.bits))
    return out.select("row", "col", some.alias("value"), F.try_divide(some, F.col("valid")).alias("mean"), "valid")
