"""Grid geometry as column arithmetic; no function here reads data.

Membership is decided in half-cell units: the centre of cell (row, col) is (2 * col + 1, 2 * row + 1), an integer, with
x to the right and y down from the grid's left top corner. Degrees are for output.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean radius of the sphere that stands for the earth, in km.
EARTH_KM = 6371.0088
TOLERANCE = 1e-9


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid: row 0 is at the top."""

    width: int
    height: int
    left: float
    top: float
    xres: float
    yres: float


def grid_of_product(meta: DataFrame) -> tuple[GridSpec, float | None]:
    """Grid and no-data value of one product, from its row of metadata."""
    rows = meta.select("width", "height", "bounds.left", "bounds.top", "resolution.x", "resolution.y", parse_nodata(F.col("nodata")).alias("nodata")).limit(2).collect()
    if len(rows) != 1:
        raise ValueError("metadata of one product is needed")
    m = rows[0]
    if any(v is None for k, v in m.asDict().items() if k != "nodata") or m.width < 1 or m.height < 1 or not (m.x > 0 and m.y > 0):
        raise ValueError(f"metadata is malformed or incomplete: {m}")
    return GridSpec(m.width, m.height, m.left, m.top, m.x, m.y), m.nodata


def parse_nodata(value: Column) -> Column:
    """A no-data value held as text, a number or "NaN", as double; anything else is null."""
    return value.try_cast("double")


def cell_center(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds lon and lat of each cell's centre."""
    return cells.withColumns({"lon": F.lit(grid.left) + (2 * F.col("col") + 1) * F.lit(grid.xres / 2), "lat": F.lit(grid.top) - (2 * F.col("row") + 1) * F.lit(grid.yres / 2)})


def cell_of(points: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds row and col of the cell that holds each point; left and top edges belong to a cell. Points outside the
    grid get indexes outside it, so clip first where that matters.
    """
    return points.withColumns({"row": F.floor((F.lit(grid.top) - F.col("lat")) / F.lit(grid.yres)).cast("int"), "col": F.floor((F.col("lon") - F.lit(grid.left)) / F.lit(grid.xres)).cast("int")})


def clip_to_extent(points: DataFrame, grid: GridSpec) -> DataFrame:
    """Points within the bounds: left and top inclusive, right and bottom exclusive. Null coordinates go."""
    right, bottom = grid.left + grid.width * grid.xres, grid.top - grid.height * grid.yres
    return points.filter((F.col("lon") >= grid.left) & (F.col("lon") < right) & (F.col("lat") <= grid.top) & (F.col("lat") > bottom))


def declared_geometry_ok(meta: DataFrame) -> DataFrame:
    """Adds width_ok and height_ok: cells times resolution gives the extent."""
    near = lambda a, b: F.abs(a - b) < TOLERANCE * F.greatest(F.abs(b), F.lit(1.0))
    return meta.withColumns({
        "width_ok": near(F.col("width") * F.col("resolution.x"), F.col("bounds.right") - F.col("bounds.left")),
        "height_ok": near(F.col("height") * F.col("resolution.y"), F.col("bounds.top") - F.col("bounds.bottom")),
    })


def resolution_arcsec(meta: DataFrame, declared: float | None = None) -> DataFrame:
    """Adds arcsec_x and arcsec_y and, with a declared resolution, whether both equal it."""
    out = meta.withColumns({"arcsec_x": F.round(F.col("resolution.x") * 3600, 6), "arcsec_y": F.round(F.col("resolution.y") * 3600, 6)})
    return out if declared is None else out.withColumn("as_declared", (F.col("arcsec_x") == declared) & (F.col("arcsec_y") == declared))


def grids_aligned(meta: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each pair (product_a, product_b) of products in `meta`: same reference system, same bounds, resolutions in a
    whole-number ratio, and that ratio. Pairs with a product that has no metadata go.
    """
    side = lambda s: meta.select(F.col("dataset_name").alias(f"product_{s}"), *[F.col(c).alias(f"{s}_{c}") for c in ("crs", "bounds", "resolution")])
    both = pairs.select("product_a", "product_b").join(side("a"), "product_a").join(side("b"), "product_b")
    same = lambda c: F.abs(F.col(f"a_bounds.{c}") - F.col(f"b_bounds.{c}")) < TOLERANCE
    ratio = lambda c: F.greatest(f"a_resolution.{c}", f"b_resolution.{c}") / F.least(f"a_resolution.{c}", f"b_resolution.{c}")
    whole = [F.abs(ratio(c) - F.round(ratio(c))) < TOLERANCE for c in ("x", "y")]
    bounds = same("left") & same("bottom") & same("right") & same("top")
    return both.select("product_a", "product_b", F.coalesce(F.col("a_crs") == F.col("b_crs"), F.lit(False)).alias("same_crs"), bounds.alias("same_bounds"), (whole[0] & whole[1]).alias("whole_ratio"), F.round(ratio("x"), 6).alias("ratio"))


@dataclass(frozen=True)
class Nesting:
    """How a fine grid lies in a coarse one: columns and rows of a block, and which of the two products is the fine one."""

    kx: int
    ky: int
    fine: str


def nesting_of(a: DataFrame, b: DataFrame) -> Nesting:
    """How one product's grid nests in another's, from their metadata. Grids of other bounds or reference systems, and
    those whose resolutions are in no whole-number ratio, the same way round on both axes, are an error.
    """
    names = ["dataset_name", "crs", "width", "height", "bounds", "resolution"]
    left, right = (m.select(*names).limit(2).collect() for m in (a, b))
    if len(left) != 1 or len(right) != 1:
        raise ValueError("metadata of one product each is needed")
    m, n = left[0], right[0]
    if m.crs is None or m.crs != n.crs:
        raise ValueError(f"reference systems differ: {m.crs} and {n.crs}")
    if any(not abs(m.bounds[c] - n.bounds[c]) < TOLERANCE for c in ("left", "bottom", "right", "top")):
        raise ValueError("bounds differ")
    down, across = (n.resolution[c] / m.resolution[c] for c in ("y", "x"))
    fine, kx, ky = (m, across, down) if across >= 1 and down >= 1 else (n, 1 / across, 1 / down)
    if any(k < 1 - TOLERANCE or abs(k - round(k)) >= TOLERANCE for k in (kx, ky)):
        raise ValueError(f"grids do not nest: ratios {across} and {down}")
    coarse = n if fine is m else m
    kx, ky = round(kx), round(ky)
    if fine.width != coarse.width * kx or fine.height != coarse.height * ky:
        raise ValueError("declared sizes do not nest")
    return Nesting(kx, ky, "a" if fine is m else "b")


def row_area(grid: GridSpec) -> Callable[[np.ndarray], np.ndarray]:
    """Area of a cell in square km by its row, as `cell_area` has it."""

    def area(row: np.ndarray) -> np.ndarray:
        edge = lambda k: np.sin(np.radians(grid.top - (row + k) * grid.yres))
        return EARTH_KM**2 * math.radians(grid.xres) * (edge(0) - edge(1))

    return area


def cell_area(cells: DataFrame, grid: GridSpec) -> DataFrame:
    """Adds area_km2, which falls towards the poles; for values that are densities rather than amounts."""
    edge = lambda k: F.sin(F.radians(F.lit(grid.top) - (F.col("row") + k) * F.lit(grid.yres)))
    return cells.withColumn("area_km2", F.lit(EARTH_KM**2 * math.radians(grid.xres)) * (edge(0) - edge(1)))
