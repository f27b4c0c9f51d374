"""The workloads, from cells, edges and truth to report rows (task, subject, measure, value), and from paths to a
written report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import GridSpec, cell_area, declared_geometry_ok, grid_of_product, grids_aligned, nesting_of, resolution_arcsec, row_area
from ..operators import agreement as ag
from ..operators import cells as ce
from ..operators import truth as tr
from ..operators import zonal as zo
from ..operators import zones as zn
from ..operators.tiles import Tiles, block_aggregate_any
from ..sources import products as so
from ..sources.geojson import read_geojson
from ..sources.shared import settle

MEASURES = ["n", "bias", "mae", "rmse", "relative_error", "pearson", "r2", "slope"]


#: Level of the boundaries that a task asks for: 0 countries, 1 first-level regions.
TASK_LEVELS = {"country": 0, "province": 1, "region": 1, "levels": 1, "grids": 1, "usability": 1}


def zone_totals(cells: DataFrame | Tiles | zn.RowCells, edges: DataFrame, width: int, height: int, task: str, nodata: float | None = None, area_of: GridSpec | None = None, spans: DataFrame | None = None) -> DataFrame:
    """(task, zone_id, cells, valid, sum, ...) of every zone that has cells, from cells or from tiles, whose pixels then
    never become rows. Spans are computed once, and only rows and columns that they touch are read; where they are too many
    to send to all, cells laid out by row stay where they are. Given a grid, cells weigh by their area there.
    """
    spans = settle(zn.row_spans(edges, width, height)) if spans is None else spans
    extent = zn.span_extent(spans)
    count = extent.spans if extent else 0
    if isinstance(cells, Tiles):
        frame = zn.tiles_within(cells.frame, extent, cells.width, cells.height) if extent else cells.frame
        found = zo.zonal_stats_of_tiles(Tiles(frame, cells.width, cells.height), spans, nodata, row_weight=row_area(area_of) if area_of else None, count=count)
        return found.withColumn("task", F.lit(task))
    by_row, cells = isinstance(cells, zn.RowCells), cells.frame if isinstance(cells, zn.RowCells) else cells
    if extent:
        cells = zn.cells_within(cells, extent)
    masked = ce.mask_nodata(cells, nodata)
    assigned = zn.assign_zones_by_row(masked, spans) if by_row and count > zn.SMALL_SPANS else zn.assign_zones(masked, zn.in_bins(spans), count=count)
    if area_of is None:
        return zo.zonal_stats(assigned).withColumn("task", F.lit(task))
    return zo.zonal_stats(cell_area(assigned, area_of), F.col("area_km2")).withColumn("task", F.lit(task))


def consistency(cells: DataFrame | Tiles | zn.RowCells, edges: DataFrame, truth: DataFrame, width: int, height: int, task: str, nodata: float | None = None, code_map: DataFrame | None = None, area_of: GridSpec | None = None, worst: int = 0, rings: DataFrame | None = None) -> DataFrame:
    """Totals by zone against truth: agreement, and how many zones have no counterpart. For countries, and with the
    edges of one country's regions for its provinces. Where nothing matches, n is 0 and measures are null.

    With `worst`, the zones with the largest errors are named, so many and ties; with `rings`, in half-cell units, zones
    that the grid cuts off, by the share that lies outside, and zones that overlap, by the number of cells they share.
    """
    spans = settle(zn.row_spans(edges, width, height))
    totals = zone_totals(cells, edges, width, height, task, nodata, area_of, spans)
    truth = tr.correct_codes(truth, code_map) if code_map is not None else truth
    pairs = settle(tr.join_truth(totals, truth))
    alone = pairs.groupBy("task").agg(F.count_if(F.col("truth").isNull()).alias("zones_without_truth"), F.count_if(F.col("prediction").isNull()).alias("truth_without_zone"))
    measures = alone.join(ag.agreement(pairs), "task", "left").join(ag.rank_agreement(pairs).drop("n"), "task", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    report = ag.as_report(measures, "zones", [*MEASURES, "spearman", "zones_without_truth", "truth_without_zone"])
    if worst:
        named = ag.worst_zones(pairs, worst).select("task", F.col("zone_id").alias("subject"), F.lit("worst_relative_error").alias("measure"), F.col("relative_error").alias("value"))
        report = report.unionByName(named)
    return report if rings is None else report.unionByName(zone_faults(spans, rings, width, height, task))


def zone_faults(spans: DataFrame, rings: DataFrame, width: int, height: int, task: str) -> DataFrame:
    """Report rows of zones with partial totals (share_outside) and of zones with common cells (shared_cells)."""
    cut = zn.outside_share(rings, width, height).filter("outside > 1e-9").select(F.lit(task).alias("task"), F.col("zone_id").alias("subject"), F.lit("share_outside").alias("measure"), F.col("outside").alias("value"))
    shared = zn.overlap_by_zone(spans, zn.overlap_runs(spans))
    return cut.unionByName(shared.select(F.lit(task).alias("task"), F.col("zone_id").alias("subject"), F.lit("shared_cells").alias("measure"), F.col("shared").cast("double").alias("value")))


def across_levels(cells: DataFrame | Tiles | zn.RowCells, region_edges: DataFrame, country_edges: DataFrame, width: int, height: int, nodata: float | None = None) -> DataFrame:
    """Countries' totals against the sums of their regions, and each region's share and valid share. Regions and
    countries are one set of spans, so cells are read once for both.
    """
    kinds = [e.select(F.concat(F.lit(k), F.col("zone_id")).alias("zone_id"), "x1", "y1", "x2", "y2") for k, e in (("r", region_edges), ("c", country_edges))]
    both = settle(zone_totals(cells, kinds[0].unionByName(kinds[1]), width, height, "levels", nodata))
    regions, countries = (both.filter(F.col("zone_id").startswith(k)).withColumn("zone_id", F.expr("substring(zone_id, 2)")) for k in ("r", "c"))
    named = zo.share_of_parent(zo.with_parent(regions, region_edges))
    pairs = zo.join_parent(named, countries).select(F.lit("levels").alias("task"), F.col("country_sum").alias("truth"), F.col("regions_sum").alias("prediction"))
    report = ag.as_report(ag.agreement(pairs), "countries", MEASURES)
    rows = named.select(F.lit("levels").alias("task"), F.col("zone_id").alias("subject"), F.col("share"), (F.col("valid") / F.col("cells")).alias("valid_share"))
    return report.unionByName(rows.unpivot(["task", "subject"], ["share", "valid_share"], "measure", "value"))


def across_grids(cells: DataFrame | Tiles, edges: DataFrame, width: int, height: int, k: int = 2, nodata: float | None = None) -> DataFrame:
    """Zones' totals on the fine grid against those on the grid of k x k blocks. From tiles, only blocks that cross a
    tile's border are moved.
    """
    fine = zone_totals(cells, edges, width, height, "grids", nodata).select("task", "zone_id", "sum")
    blocks = block_aggregate_any(cells, k, nodata, width, height) if isinstance(cells, Tiles) else ce.block_aggregate(ce.mask_nodata(cells, nodata), k)
    coarse_edges = edges.select("zone_id", *[(F.col(c) / k).alias(c) for c in ("x1", "y1", "x2", "y2")])
    coarse = zone_totals(blocks.select("row", "col", "value"), coarse_edges, -(-width // k), -(-height // k), "grids").select("task", "zone_id", F.col("sum").alias("truth"))
    return ag.as_report(ag.agreement(tr.join_truth(fine, coarse)), "zones", MEASURES)


def across_products(a: DataFrame, meta_a: DataFrame, b: DataFrame, meta_b: DataFrame, nodata_a: float | None = None, nodata_b: float | None = None) -> DataFrame:
    """Two products of unequal resolution, cell by cell on the coarser grid: the finer one's blocks are means of their
    valid cells. Report rows of how the grids nest, of how many cells each has a value in, and of agreement, product a
    as prediction. Grids that do not nest are an error.
    """
    nest = nesting_of(meta_a, meta_b)
    masked = {"a": ce.mask_nodata(a, nodata_a), "b": ce.mask_nodata(b, nodata_b)}
    blocks = ce.block_aggregate(masked[nest.fine], nest.kx, nest.ky).select("row", "col", F.col("mean").alias("value"))
    sides = masked | {nest.fine: blocks}
    prediction, truth = (sides[s].select("row", "col", F.col("value").cast("double").alias(n)) for s, n in (("a", "prediction"), ("b", "truth")))
    both = settle(prediction.join(truth, ["row", "col"], "full_outer").select(F.lit("products").alias("task"), "prediction", "truth"))
    seen = both.groupBy("task").agg(F.lit(nest.kx).alias("columns_per_cell"), F.lit(nest.ky).alias("rows_per_cell"), F.count("prediction").alias("valid_a"), F.count("truth").alias("valid_b"))
    measures = seen.join(ag.agreement(both), "task", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ag.as_report(measures, "cells", ["columns_per_cell", "rows_per_cell", "valid_a", "valid_b", *MEASURES])


def product_test(cells: DataFrame, meta: DataFrame, width: int, height: int, nodata: float | None = None, arcsec: float = 60.0, other: DataFrame | None = None) -> DataFrame:
    """A finished raster against its own declaration: geometry, resolution, shape, values, repeated and missing cells; and
    with another product's metadata, whether their grids are aligned. Cells are scanned once: bitmaps by row say what is
    missing and whether anything repeats, and everything else is measured while they are made. Only if something repeats
    are its positions looked for in a second scan.
    """
    words, seen = ce.examined(ce.mask_nodata(cells, nodata), settle)
    one = F.lit("product").alias("task")
    geometry = resolution_arcsec(declared_geometry_ok(meta), arcsec).select(one, *[F.col(c).cast("double").alias(c) for c in ("width_ok", "height_ok", "as_declared")])
    as_declared = seen["cells"] == width * height and (seen["min_row"], seen["max_row"], seen["min_col"], seen["max_col"]) == (0, height - 1, 0, width - 1)
    mean = None if not seen["valid"] else seen["sum"] / seen["valid"]
    known = {"shape_as_declared": float(as_declared), "cells": seen["cells"], "valid": seen["valid"], "nodata": seen["cells"] - seen["valid"], "min": seen["min"], "max": seen["max"], "mean": mean}
    found = ce.completeness(words, width, height).first()
    known |= {"duplicate_cells": ce.duplicate_cells(cells, width, words).filter(F.col("row").between(0, height - 1)).count() if found.repeats else 0, "missing_cells": found.missing_cells}
    whole = geometry.select("task", *[F.lit(v).cast("double").alias(k) for k, v in known.items()])
    out = ag.as_report(geometry, "raster", ["width_ok", "height_ok", "as_declared"]).unionByName(ag.as_report(whole, "raster", list(known)))
    if other is None:
        return out
    both = meta.unionByName(other)
    pairs = meta.select(F.col("dataset_name").alias("product_a"), F.lit(1).alias("one")).join(other.select(F.col("dataset_name").alias("product_b"), F.lit(1).alias("one")), "one")
    aligned = grids_aligned(both, pairs).select(one, F.col("product_b").alias("subject"), *[F.col(c).cast("double").alias(c) for c in ALIGNMENT])
    return out.unionByName(aligned.unpivot(["task", "subject"], list(ALIGNMENT), "measure", "value"))


ALIGNMENT = ("same_crs", "same_bounds", "whole_ratio", "ratio")


@dataclass(frozen=True)
class Product:
    """Where one product lies: its metadata (a JSON object, over several lines or not), and its cells, its tiles and
    their size, or the name of a table of cells laid out by row.
    """

    metadata: str
    cells: str | None = None
    tiles: str | None = None
    table: str | None = None
    tile_w: int = 512
    tile_h: int = 512

    def read(self, spark: SparkSession) -> tuple[DataFrame, DataFrame | Tiles | zn.RowCells, GridSpec, float | None]:
        """Metadata, cells or tiles as stored, grid and no-data value."""
        if sum(x is not None for x in (self.cells, self.tiles, self.table)) != 1:
            raise ValueError("give cells, tiles or a table")
        meta = so.read_product_metadata(spark, self.metadata)
        if self.table is not None:
            return meta, zn.RowCells(spark.table(self.table).select("row", "col", "value")), *grid_of_product(meta)
        if self.tiles is not None:
            return meta, Tiles(spark.read.parquet(self.tiles).select("tile_row", "tile_col", "values"), self.tile_w, self.tile_h), *grid_of_product(meta)
        return meta, spark.read.parquet(self.cells).select("row", "col", "value"), *grid_of_product(meta)

    def read_cells(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, GridSpec, float | None]:
        """The same with tiles unpacked, for what looks at single cells."""
        meta, own, grid, nodata = self.read(spark)
        if isinstance(own, Tiles):
            return meta, so.tiles_to_cells(own.frame, own.width, own.height, grid.width, grid.height), grid, nodata
        return meta, own.frame if isinstance(own, zn.RowCells) else own, grid, nodata


@dataclass(frozen=True)
class Boundaries:
    """Where boundaries lie, by level, and in what form: Parquet or JSON lines of rings, or GeoJSON, whose properties for
    a zone and its parent are named.
    """

    levels: dict[int, str]
    form: str = "parquet"
    zone: str = "zone_id"
    parent: str = "parent_id"

    def rings(self, spark: SparkSession, level: int) -> DataFrame:
        if level not in self.levels:
            raise ValueError(f"no boundaries of level {level}")
        if self.form in ("geojson", "geojsonl"):
            return read_geojson(spark, self.levels[level], self.zone, self.parent, self.form == "geojsonl")[0]
        return so.read_boundaries(spark, self.levels[level], self.form)

    def for_task(self, spark: SparkSession, task: str, parent_id: str | None = None) -> DataFrame:
        """Rings of the level that the task asks for, of one parent's zones if that is given."""
        if task not in TASK_LEVELS:
            raise ValueError(f"unknown task: {task}")
        rings = self.rings(spark, TASK_LEVELS[task])
        return rings if parent_id is None else zn.select_parent(rings, parent_id)


def _rings(spark: SparkSession, boundaries: str | Boundaries, task: str, parent_id: str | None = None) -> DataFrame:
    """Rings of a task; a path is taken for the boundaries of the task's own level."""
    own = boundaries if isinstance(boundaries, Boundaries) else Boundaries(dict.fromkeys((0, 1), boundaries))
    return own.for_task(spark, task if task in TASK_LEVELS or isinstance(boundaries, Boundaries) else "country", parent_id)


def _edges(rings: DataFrame, grid: GridSpec) -> DataFrame:
    """Edges in half-cell units from rings in degrees."""
    return so.edges_to_half_cells(so.ring_edges(rings), grid.left, grid.top, grid.xres, grid.yres)


def _written(spark: SparkSession, report: DataFrame, path: str) -> DataFrame:
    so.write_report(report, path)
    return spark.read.parquet(path)


def run_consistency(spark: SparkSession, product: Product, boundaries: str | Boundaries, truth: str, mapping: dict[str, str], task: str, report: str, parent_id: str | None = None, code_map: DataFrame | None = None, encoding: str = "UTF-8", by_area: bool = False, worst: int = 0, faults: bool = False) -> DataFrame:
    """Zones against the statistics of a CSV file, for countries or, given a parent, for its first-level regions. Codes
    are corrected first; truth of zones with another parent then does not count, while codes that no zone of these
    boundaries has do, as truth without a zone. `by_area` takes values for densities; `worst` and `faults` name zones, and
    `faults` counts rows of truth whose amount is no number.
    """
    _, cells, grid, nodata = product.read(spark)
    rings = _rings(spark, boundaries, task, parent_id)
    table = so.read_truth(spark, truth, task, mapping, encoding)
    table = tr.correct_codes(table, code_map) if code_map is not None else table
    unread, table = table.filter(F.col("truth").isNull()), table.filter(F.col("truth").isNotNull())
    if parent_id is not None:
        elsewhere = _rings(spark, boundaries, task).filter(~F.col("parent_id").eqNullSafe(parent_id)).select("zone_id").distinct()
        table = table.join(elsewhere, "zone_id", "left_anti")
    half = so.rings_to_half_cells(rings, grid.left, grid.top, grid.xres, grid.yres) if faults else None
    found = consistency(cells, _edges(rings, grid), table, grid.width, grid.height, task, nodata, None, grid if by_area else None, worst, half)
    if faults:
        blank = unread.agg(F.count(F.lit(1)).cast("double").alias("value")).select(F.lit(task).alias("task"), F.lit("truth").alias("subject"), F.lit("unreadable_amounts").alias("measure"), "value")
        found = found.unionByName(blank)
    return _written(spark, found, report)


def run_across_levels(spark: SparkSession, product: Product, regions: str | Boundaries, countries: str | Boundaries | None, report: str) -> DataFrame:
    """Regions against countries, from two paths or from `Boundaries` that have both levels."""
    _, cells, grid, nodata = product.read(spark)
    upper = countries if countries is not None else regions
    return _written(spark, across_levels(cells, _edges(_rings(spark, regions, "levels"), grid), _edges(_rings(spark, upper, "country"), grid), grid.width, grid.height, nodata), report)


def run_across_grids(spark: SparkSession, product: Product, boundaries: str | Boundaries, report: str, k: int = 2) -> DataFrame:
    _, cells, grid, nodata = product.read(spark) if product.tiles else product.read_cells(spark)
    return _written(spark, across_grids(cells, _edges(_rings(spark, boundaries, "grids"), grid), grid.width, grid.height, k, nodata), report)


def run_across_products(spark: SparkSession, a: Product, b: Product, report: str) -> DataFrame:
    (meta_a, cells_a, _, none_a), (meta_b, cells_b, _, none_b) = (p.read_cells(spark) for p in (a, b))
    return _written(spark, across_products(cells_a, meta_a, cells_b, meta_b, none_a, none_b), report)


def run_product_test(spark: SparkSession, product: Product, report: str, arcsec: float = 60.0, other: str | None = None) -> DataFrame:
    """The finished product is read and reported on; nothing is computed anew. `other` is another product's metadata."""
    meta, cells, grid, nodata = product.read_cells(spark)
    second = so.read_product_metadata(spark, other) if other else None
    return _written(spark, product_test(cells, meta, grid.width, grid.height, nodata, arcsec, second), report)
