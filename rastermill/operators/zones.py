"""Zones: from edges to spans of cells, and from spans to the zones of each cell."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Spans of a row are cut at multiples of this many columns, so that a cell meets few of them.
BIN = 256
#: Rows of a stripe, the unit in which edges are dealt.
STRIPE = 64
#: Up to so many spans (about 30 bytes each) go to every executor; more are joined by a shuffle.
SMALL_SPANS = 1_000_000


def select_parent(zones: DataFrame, parent_id: str) -> DataFrame:
    """Zones of one parent; the filter reaches the scan."""
    return zones.filter(F.col("parent_id") == parent_id)


def boundaries_for_task(tasks: DataFrame, zones: DataFrame) -> DataFrame:
    """Zones of the level each task asks for."""
    return tasks.select("task", "level").join(zones, "level")


def row_spans(edges: DataFrame, width: int, height: int) -> DataFrame:
    """Runs (zone_id, row, c0, c1) of cells whose centre lies inside, c1 exclusive.

    Even-odd over all edges of a zone, so holes and several parts need nothing else. An edge in half-cell units counts
    for a row when y1 <= 2 * row + 1 < y2; crossings of a row, in order, open and close spans in turn; a span has the
    cells with x <= 2 * col + 1 < next x.

    Edges are dealt to stripes of `STRIPE` rows before any row is listed, so a long edge is the work of many tasks, and
    a task lists the crossings of a zone in one stripe at a time. Its rows are swept from left to right where they are.
    """
    low = F.greatest(F.ceil((F.col("y1") - 1) / 2), F.lit(0))
    high = F.least(F.ceil((F.col("y2") - 1) / 2), F.lit(height)) - 1
    rows = edges.filter(F.col("y1") < F.col("y2")).select("zone_id", "x1", "y1", "x2", "y2", low.alias("r0"), high.alias("r1")).filter("r0 <= r1")
    dealt = rows.withColumn("stripe", F.explode(F.sequence(F.expr(f"r0 div {STRIPE}"), F.expr(f"r1 div {STRIPE}")))).repartition("zone_id", "stripe")
    within = F.sequence(F.greatest("r0", F.col("stripe") * STRIPE), F.least("r1", F.col("stripe") * STRIPE + (STRIPE - 1)))
    listed = dealt.withColumn("row", F.explode(within))
    crossing = F.col("x1") + (2 * F.col("row") + 1 - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    # Rows of a stripe lie together already, so the window moves nothing.
    order = W.partitionBy("zone_id", "stripe", "row").orderBy("x")
    pairs = listed.select("zone_id", "stripe", F.col("row").cast("int").alias("row"), crossing.alias("x")).withColumns({"k": F.row_number().over(order), "next": F.lead("x").over(order)})
    first_cell = lambda x: F.ceil((F.col(x) - 1) / 2)
    return pairs.filter("k % 2 = 1").select("zone_id", "row", F.greatest(first_cell("x"), F.lit(0)).cast("int").alias("c0"), F.least(first_cell("next"), F.lit(width)).cast("int").alias("c1")).filter("c0 < c1")


def in_bins(spans: DataFrame, bin: int = BIN) -> DataFrame:
    """Spans once for each bin of columns that they touch."""
    return spans.withColumn("bin", F.explode(F.sequence(F.expr(f"c0 div {bin}"), F.expr(f"(c1 - 1) div {bin}")))).withColumn("bin", F.col("bin").cast("int"))


def scanline_spans(edges: DataFrame, width: int, height: int, bin: int = BIN) -> DataFrame:
    """`row_spans` with the bins that they touch: (zone_id, row, c0, c1, bin)."""
    return in_bins(row_spans(edges, width, height), bin)


@dataclass(frozen=True)
class Extent:
    """How many spans there are, and the rows and columns they touch, ends included."""

    spans: int
    row0: int
    row1: int
    col0: int
    col1: int


def span_extent(spans: DataFrame) -> Extent | None:
    """One aggregate; None without spans. Compute spans once (`settle`) before asking."""
    r = spans.agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("a"), F.max("row").alias("b"), F.min("c0").alias("c"), (F.max("c1") - 1).alias("d")).first()
    return Extent(r.n, r.a, r.b, r.c, r.d) if r.n else None


def cells_within(cells: DataFrame, extent: Extent) -> DataFrame:
    """A filter that lets a scan of cells skip what no zone touches."""
    return cells.filter(F.col("row").between(extent.row0, extent.row1) & F.col("col").between(extent.col0, extent.col1))


def tiles_within(tiles: DataFrame, extent: Extent, tile_w: int, tile_h: int) -> DataFrame:
    """The same on tiles, before they are unpacked."""
    return tiles.filter(F.col("tile_row").between(extent.row0 // tile_h, extent.row1 // tile_h) & F.col("tile_col").between(extent.col0 // tile_w, extent.col1 // tile_w))


def assign_zones(cells: DataFrame, spans: DataFrame, bin: int = BIN, count: int | None = None) -> DataFrame:
    """Each cell once for every zone that holds it (zones may overlap); cells of no zone go.

    Few enough spans go to every executor, and the cells stay where they are; give their `count` where it is known, else
    they are counted.
    """
    few = (spans.count() if count is None else count) <= SMALL_SPANS
    side = spans.select("zone_id", "row", "bin", "c0", "c1")
    keyed = cells.withColumn("bin", F.expr(f"col div {bin}").cast("int"))
    joined = keyed.join(F.broadcast(side) if few else side, ["row", "bin"]).filter((F.col("col") >= F.col("c0")) & (F.col("col") < F.col("c1")))
    return joined.select("zone_id", "row", "col", "value")


@dataclass(frozen=True)
class RowCells:
    """Cells that `write_cells_by_row` has laid out."""

    frame: DataFrame


def write_cells_by_row(cells: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Cells (row, col, value) as a table whose files are stripes of rows: all of a row lies in one bucket, in order. Made
    once for a product; every later join by row then reads the cells where they are.
    """
    laid = cells.select("row", "col", "value").repartition(buckets, "row")
    laid.write.bucketBy(buckets, "row").sortBy("row", "col").option("path", path).saveAsTable(table)
    return cells.sparkSession.table(table)


def packed_spans(spans: DataFrame) -> DataFrame:
    """(row, spans): one array a row, in order of their first column."""
    return spans.select("row", "zone_id", "c0", "c1").distinct().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("c0", "c1", "zone_id"))).alias("spans"))


def assign_zones_by_row(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """The same as `assign_zones` for any number of spans, without moving cells that `write_cells_by_row` has laid out:
    only the packed spans go to the rows' buckets, and each cell looks through the spans of its own row.
    """
    joined = cells.join(packed_spans(spans).hint("merge"), "row")
    holds = F.filter("spans", lambda s: (s["c0"] <= F.col("col")) & (F.col("col") < s["c1"]))
    return joined.select("row", "col", "value", F.explode(holds).alias("span")).select("span.zone_id", "row", "col", "value")


def overlapping_cells(assigned: DataFrame) -> DataFrame:
    """Cells that several zones hold, and how many; each zone counts such a cell. `overlap_runs` has the same without
    any cell.
    """
    return assigned.groupBy("row", "col").agg(F.count_distinct("zone_id").alias("zones")).filter("zones > 1")


def overlap_runs(spans: DataFrame) -> DataFrame:
    """(row, c0, c1, zones): runs of cells that several zones hold, c1 exclusive, each as long as their number stays.

    The ends of a row's spans are swept from left to right, one up where a span starts and one down where it ends. A
    zone's own spans do not overlap, so the depth is the number of zones; no cell is read.
    """
    own = spans.select("zone_id", "row", "c0", "c1").distinct()
    ends = own.select("row", F.explode(F.array(F.struct(F.col("c0").alias("c"), F.lit(1).alias("d")), F.struct(F.col("c1").alias("c"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("row", F.col("e.c").alias("c0")).agg(F.sum("e.d").alias("d")).filter("d != 0")
    order = W.partitionBy("row").orderBy("c0")
    runs = steps.select("row", "c0", F.lead("c0").over(order).alias("c1"), F.sum("d").over(order).alias("zones"))
    return runs.filter("zones > 1")


def overlap_by_zone(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """(zone_id, shared): how many of its cells each zone shares with another one."""
    own = spans.select("zone_id", "row", F.col("c0").alias("a"), F.col("c1").alias("b")).distinct()
    met = own.join(runs.select("row", "c0", "c1"), "row").filter((F.col("c0") < F.col("b")) & (F.col("a") < F.col("c1")))
    return met.groupBy("zone_id").agg(F.sum(F.least("b", "c1") - F.greatest("a", "c0")).alias("shared"))


def clipped_zones(edges: DataFrame, width: int, height: int) -> DataFrame:
    """Zones that reach beyond the grid, whose totals are therefore partial. `edges` in half-cell units."""
    ends = edges.groupBy("zone_id").agg(F.min(F.least("x1", "x2")).alias("x_min"), F.max(F.greatest("x1", "x2")).alias("x_max"), F.min("y1").alias("y_min"), F.max("y2").alias("y_max"))
    return ends.withColumn("clipped", (F.col("x_min") < 0) | (F.col("x_max") > 2 * width) | (F.col("y_min") < 0) | (F.col("y_max") > 2 * height))


def outside_share(rings: DataFrame, width: int, height: int) -> DataFrame:
    """(zone_id, area, inside, outside): a zone's area in cells, what of it lies on the grid, and the share that does not.

    `rings` in half-cell units, with a column `hole` or, without it, holes turning the other way than what they are in.
    Both areas are boundary integrals, edge by edge: of x dy, and of x held between the grid's sides, dy, over the part of
    the edge between its top and bottom. A zone without area has a null share.
    """
    flagged = "hole" in rings.columns
    w, h = float(2 * width), float(2 * height)
    nexts = F.concat(F.slice("ring", 2, F.greatest(F.size("ring") - 1, F.lit(1))), F.slice("ring", 1, 1))
    ringed = rings.filter(F.size("ring") > 2).select("zone_id", (F.when(F.col("hole"), -1).otherwise(1) if flagged else F.lit(0)).alias("sign"), F.arrays_zip(F.col("ring").alias("p"), nexts.alias("q")).alias("edges"))

    def clipped(e: Column) -> Column:
        x1, y1, x2, y2 = e["p"]["x"], e["p"]["y"], e["q"]["x"], e["q"]["y"]
        level = y1 == y2
        at = lambda y: x1 + (y - y1) * (x2 - x1) / F.when(level, F.lit(1.0)).otherwise(y2 - y1)
        a, b = F.greatest(F.lit(0.0), F.least(F.lit(h), y1)), F.greatest(F.lit(0.0), F.least(F.lit(h), y2))
        held = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(w), x))
        # The integral of x held between 0 and w, up to x.
        upto = lambda x: held(x) * held(x) / 2 + F.greatest(x - w, F.lit(0.0)) * w
        xa, xb = at(a), at(b)
        steep = F.abs(xb - xa) < 1e-12
        mean = F.when(steep, held(xa)).otherwise((upto(xb) - upto(xa)) / F.when(steep, F.lit(1.0)).otherwise(xb - xa))
        return F.when(level, F.lit(0.0)).otherwise(mean * (b - a))

    whole = lambda e: (e["p"]["x"] + e["q"]["x"]) / 2 * (e["q"]["y"] - e["p"]["y"])
    total = lambda f: F.aggregate("edges", F.lit(0.0), lambda s, e: s + f(e))
    areas = ringed.select("zone_id", "sign", total(whole).alias("area"), total(clipped).alias("inside"))
    signed = lambda c: F.abs(F.sum(F.when(F.col("sign") == 0, F.col(c)).otherwise(F.col("sign") * F.abs(c)))) / 4
    sums = areas.groupBy("zone_id").agg(signed("area").alias("area"), signed("inside").alias("inside"))
    return sums.withColumn("outside", F.try_divide(F.greatest(F.col("area") - F.col("inside"), F.lit(0.0)), "area"))
