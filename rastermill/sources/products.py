"""Product metadata, raster cells, boundary rings, truth tables, reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import grid_of_product
from ..operators.cells import mask_nodata
from ..operators.zones import Extent, cells_within, tiles_within
from .shared import few_tiles, small_batches

_NUMBERS = lambda *names: T.StructType([T.StructField(n, T.DoubleType()) for n in names])
#: `nodata` is text, since one product gives a number and another the string "NaN".
METADATA = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("dataset_name", "version", "primary_file", "format", "crs", "dtype", "nodata")],
    *[T.StructField(n, T.LongType()) for n in ("width", "height", "band_count")],
    T.StructField("bounds", _NUMBERS("left", "bottom", "right", "top")),
    T.StructField("resolution", _NUMBERS("x", "y")),
])
RINGS = "zone_id string, parent_id string, ring array<struct<x: double, y: double>>"


def read_product_metadata(spark: SparkSession, paths: str | list[str], multi_line: bool = True) -> DataFrame:
    """One row a product; a file is one JSON object, or with `multi_line` off one object a line."""
    return spark.read.schema(METADATA).option("multiLine", multi_line).json(paths)


def read_cells(spark: SparkSession, path: str, meta: DataFrame | None = None, extent: Extent | None = None) -> DataFrame:
    """Cells (row, col, value) of a Parquet cell table. Only these columns are read, and with an extent only what lies
    in it. With a product's metadata, its no-data value is null.
    """
    cells = spark.read.parquet(path).select("row", "col", "value")
    cells = cells_within(cells, extent) if extent else cells
    return mask_nodata(cells, grid_of_product(meta)[1] if meta is not None else None)


def read_tiles(spark: SparkSession, path: str, tile_w: int, tile_h: int, meta: DataFrame, extent: Extent | None = None) -> DataFrame:
    """The same from a Parquet tile table; with an extent, other tiles are skipped before any is unpacked."""
    grid, nodata = grid_of_product(meta)
    tiles = spark.read.parquet(path).select("tile_row", "tile_col", "values")
    cells = tiles_to_cells(tiles_within(tiles, extent, tile_w, tile_h) if extent else tiles, tile_w, tile_h, grid.width, grid.height)
    return mask_nodata(cells_within(cells, extent) if extent else cells, nodata)


def tiles_to_cells(tiles: DataFrame, tile_w: int, tile_h: int, width: int | None = None, height: int | None = None) -> DataFrame:
    """One row a pixel of (tile_row, tile_col, values), rows of a tile one after another; without a shuffle. Tiles at
    the right and lower border may reach beyond the grid; give its size to drop what does.
    """
    cells = tiles.select("tile_row", "tile_col", F.posexplode("values").alias("at", "value"))
    cells = cells.select((F.col("tile_row") * tile_h + F.expr(f"at div {tile_w}")).cast("int").alias("row"), (F.col("tile_col") * tile_w + F.col("at") % tile_w).cast("int").alias("col"), "value")
    if width is not None:
        cells = cells.filter(F.col("col") < width)
    return cells if height is None else cells.filter(F.col("row") < height)


def cells_to_tiles(cells: DataFrame, tile_w: int, tile_h: int) -> DataFrame:
    """The inverse: a tile is one row, its missing pixels null; of repeated cells the largest value stays (NaN above
    all). A tile's size, and how often its cells repeat, bound each group. A worker holds one small batch of tiles.
    """
    at = (F.expr(f"row % {tile_h}") * tile_w + F.expr(f"col % {tile_w}")).cast("int")
    kind = cells.schema["value"].dataType.simpleString()
    grouped = cells.groupBy(F.expr(f"row div {tile_h}").cast("int").alias("tile_row"), F.expr(f"col div {tile_w}").cast("int").alias("tile_col"))
    found = grouped.agg(F.collect_list(F.struct(at.alias("at"), F.col("value"))).alias("pixels"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_tiles(batches, tile_w * tile_h):
            pixels = batch.column("pixels")
            tile = np.repeat(np.arange(batch.num_rows), np.asarray(pc.list_value_length(pixels)))
            flat = pixels.flatten()
            value, there = flat.field("value"), flat.field("value").is_valid().to_numpy(zero_copy_only=False)
            place = (tile * tile_w * tile_h + flat.field("at").to_numpy())[there]
            known = value.drop_null().to_numpy(zero_copy_only=False)
            order = np.argsort(known, kind="stable")
            full, gone = np.zeros(batch.num_rows * tile_w * tile_h, known.dtype), np.ones(batch.num_rows * tile_w * tile_h, bool)
            full[place[order]], gone[place] = known[order], False
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * tile_w * tile_h, pa.int32()), pa.array(full, value.type, mask=gone))
            yield pa.RecordBatch.from_arrays([batch.column("tile_row"), batch.column("tile_col"), lists], names=["tile_row", "tile_col", "values"])

    small_batches(cells.sparkSession)
    return found.mapInArrow(run, f"tile_row int, tile_col int, values array<{kind}>")


def read_boundaries(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Rings with zone and parent, from Parquet or JSON lines of the same fields."""
    return spark.read.schema(RINGS).format(form).load(path)


def ring_edges(rings: DataFrame) -> DataFrame:
    """Edges (zone_id, parent_id, x1, y1, x2, y2), the lower y first, of rings that may or may not repeat their first
    point. Zones that share an edge thus compute the same crossings on it. Edges of no length go.
    """
    following = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(1))), F.slice("ring", 1, 1))
    edges = rings.filter(F.size("ring") > 1).select("zone_id", "parent_id", F.explode(F.arrays_zip(F.col("ring").alias("p"), following.alias("q"))).alias("e"))
    first = (F.col("e.p.y") < F.col("e.q.y")) | ((F.col("e.p.y") == F.col("e.q.y")) & (F.col("e.p.x") <= F.col("e.q.x")))
    pick = lambda a, b, c: F.when(first, F.col(f"e.{a}.{c}")).otherwise(F.col(f"e.{b}.{c}"))
    out = edges.select("zone_id", "parent_id", pick("p", "q", "x").alias("x1"), pick("p", "q", "y").alias("y1"), pick("q", "p", "x").alias("x2"), pick("q", "p", "y").alias("y2"))
    return out.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def edges_to_half_cells(edges: DataFrame, left: float, top: float, xres: float, yres: float) -> DataFrame:
    """Edges in degrees as edges in half-cell units; y then runs down, so the ends change places. Polygons must come
    split at the antimeridian: a longitude beyond 180 degrees either way is an error.
    """
    inside = lambda c: F.when(F.abs(c) <= 180, F.col(c)).otherwise(F.raise_error(F.concat(F.lit("longitude out of range: "), F.col(c).cast("string"))).cast("double"))
    x = lambda c: (inside(c) - left) * (2 / xres)
    y = lambda c: (F.lit(top) - F.col(c)) * (2 / yres)
    return edges.select("zone_id", "parent_id", x("x2").alias("x1"), y("y2").alias("y1"), x("x1").alias("x2"), y("y1").alias("y2"))


def rings_to_half_cells(rings: DataFrame, left: float, top: float, xres: float, yres: float) -> DataFrame:
    """Rings in degrees as rings in half-cell units; their other columns stay."""
    return rings.withColumn("ring", F.transform("ring", lambda p: F.struct(((p["x"] - left) * (2 / xres)).alias("x"), ((F.lit(top) - p["y"]) * (2 / yres)).alias("y"))))


def read_truth(spark: SparkSession, path: str, task: str, mapping: dict[str, str], encoding: str = "UTF-8") -> DataFrame:
    """(task, zone_id, truth) from CSV with a header. `mapping` names the file's columns for zone_id and truth; which
    they are differs by file and is never guessed.
    """
    raw = spark.read.option("header", True).option("encoding", encoding).csv(path)
    return raw.select(F.lit(task).alias("task"), F.col(mapping["zone_id"]).alias("zone_id"), F.col(mapping["truth"]).try_cast("double").alias("truth"))


def write_report(report: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Writes a report (task, subject, measure, value)."""
    out = report.select("task", "subject", "measure", "value")
    out.write.mode(mode).format(form).options(**({"header": "true"} if form == "csv" else {})).save(path)
