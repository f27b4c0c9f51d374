"""Rasters, zones and truth derived from the star schema, since no raster or boundary file is at hand.

A grid of 150 columns holds one cell an order; five countries are bands of 30 columns; each has five first-level
regions with slanted borders. Both cover the grid exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 150
NODATA = -9999.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def height(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the grid: one number, from the largest key."""
    return table(spark, sf_dir, "orders").agg(F.expr(f"max(o_orderkey) div {WIDTH} + 1").alias("h")).first().h


def demand_cells(spark: SparkSession, sf_dir: str, sentinel: float = NODATA) -> DataFrame:
    """(row, col, value), with a sentinel in about a third of the cells."""
    key = F.col("o_orderkey")
    value = F.when(F.col("o_orderstatus") == "P", F.lit(sentinel)).otherwise(F.col("o_totalprice"))
    return table(spark, sf_dir, "orders").select(F.expr(f"o_orderkey div {WIDTH}").cast("int").alias("row"), (key % WIDTH).cast("int").alias("col"), value.alias("value"))


def spectrum_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demand_cells(spark, sf_dir, float("nan"))


def line_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that repeat and leave gaps: order by line number, seven columns."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("int").alias("row"), (F.col("l_linenumber") - 1).cast("int").alias("col"), F.col("l_extendedprice").alias("value"))


def _point(x: object, y: object) -> object:
    return F.struct(F.lit(x).cast("double").alias("x") if not hasattr(x, "cast") else x.cast("double").alias("x"), y.cast("double").alias("y"))


def country_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(zone_id, parent_id, ring) in half-cell units."""
    bottom = F.lit(2 * height(spark, sf_dir))
    x = F.col("r_regionkey") * 60
    ring = F.array(_point(x, F.lit(0)), _point(x + 60, F.lit(0)), _point(x + 60, bottom), _point(x, bottom))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("zone_id"), F.lit(None).cast("string").alias("parent_id"), ring.alias("ring"))


def region_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = height(spark, sf_dir)
    x, j = F.col("n_regionkey") * 60, F.expr("n_nationkey div 5")
    top_left, bottom_left = j * (2 * h) / 5, (j + 1) * (2 * h) / 5
    top_right = top_left + F.when(j > 0, h / 10).otherwise(0)
    bottom_right = bottom_left + F.when(j < 4, h / 10).otherwise(0)
    ring = F.array(_point(x, top_left), _point(x + 60, top_right), _point(x + 60, bottom_right), _point(x, bottom_left))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("zone_id"), F.col("n_regionkey").cast("string").alias("parent_id"), ring.alias("ring"))


def country_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(task, zone_id, truth): the last country is left out and an unknown code added."""
    customers = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    code = F.when(F.col("n_regionkey") == 4, F.lit("99")).otherwise(F.col("n_regionkey").cast("string"))
    return customers.groupBy(F.lit("country").alias("task"), code.alias("zone_id")).agg(F.sum("c_acctbal").alias("truth"))


def region_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.lit("region").alias("task"), F.col("c_nationkey").cast("string").alias("zone_id")).agg(F.sum("c_acctbal").alias("truth"))


def product_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One product a supplier, as its JSON: sizes, bounds and resolutions follow from the keys, and some do not fit."""
    n = table(spark, sf_dir, "supplier")
    k, r = F.col("s_suppkey"), F.col("s_suppkey") % 5
    cells = (r + 1) * 60
    res = F.lit(1.0) / (r + 1)
    fault = F.when(k % 7 == 3, 1.0).otherwise(0.0)
    meta = F.struct(
        F.col("s_name").alias("dataset_name"), F.lit("1").alias("version"), F.concat(F.lit("n"), k.cast("string")).alias("primary_file"), F.lit("GTiff").alias("format"), F.when(k % 3 == 2, "EPSG:3857").otherwise("EPSG:4326").alias("crs"), F.lit("float32").alias("dtype"),
        F.when(k % 2 == 0, "-9999.0").otherwise("NaN").alias("nodata"), cells.cast("long").alias("width"), cells.cast("long").alias("height"), F.lit(1).cast("long").alias("band_count"),
        F.struct(F.lit(-30.0).alias("left"), F.lit(-30.0).alias("bottom"), (F.lit(30.0) + fault).alias("right"), (F.lit(30.0) + F.when(k % 11 == 5, 1.0).otherwise(0.0)).alias("top")).alias("bounds"), F.struct(res.alias("x"), res.alias("y")).alias("resolution"),
    )
    return n.select(meta.alias("m"))


#: The stand-in's place on the globe: degrees of its left top corner, and of a cell, whose height is at most this.
LEFT, TOP, XRES, YRES = -180.0, 75.0, 0.25, 0.125


def yres(spark: SparkSession, sf_dir: str) -> float:
    """Height of a cell in degrees, halved until the whole grid lies on the globe; halves keep coordinates exact."""
    rows, size = height(spark, sf_dir), YRES
    while TOP - rows * size < -90:
        size /= 2
    return size


def own_metadata(spark: SparkSession, sf_dir: str, nodata: float | None) -> DataFrame:
    """The stand-in raster's own declaration in the form of a finished product's file: JSON over several lines, no-data
    a number, or "NaN" in quotes.
    """
    top, tall = table(spark, sf_dir, "orders").agg(F.expr(f"max(o_orderkey) div {WIDTH} + 1").alias("h")), yres(spark, sf_dir)
    no = F.lit("NaN") if nodata is None else F.lit(nodata)
    meta = F.struct(
        F.lit("stand-in").alias("dataset_name"), F.lit("1.0").alias("version"), F.lit("stand_in.tif").alias("primary_file"), F.lit("GTiff").alias("format"), F.lit("EPSG:4326").alias("crs"), F.lit(WIDTH).alias("width"), F.col("h").alias("height"), F.lit(1).alias("band_count"), F.lit("float32").alias("dtype"), no.alias("nodata"),
        F.struct(F.lit(LEFT).alias("left"), (F.lit(TOP) - F.col("h") * tall).alias("bottom"), F.lit(LEFT + WIDTH * XRES).alias("right"), F.lit(TOP).alias("top")).alias("bounds"), F.struct(F.lit(XRES).alias("x"), F.lit(tall).alias("y")).alias("resolution"),
    )
    return top.select(F.to_json(meta, {"pretty": "true"}).alias("value"))


def in_degrees(rings: DataFrame, tall: float) -> DataFrame:
    """Rings in half-cell units as a boundary file would have them; `tall` is the height of a cell, `yres`."""
    return rings.withColumn("ring", F.transform("ring", lambda p: F.struct((F.lit(LEFT) + p["x"] * (XRES / 2)).alias("x"), (F.lit(TOP) - p["y"] * (tall / 2)).alias("y"))))


def second_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second product's declaration: the same bounds at half the resolution."""
    top, tall = table(spark, sf_dir, "orders").agg(F.expr(f"max(o_orderkey) div {WIDTH} + 1").alias("h")), yres(spark, sf_dir)
    meta = F.struct(
        F.lit("second").alias("dataset_name"), F.lit("EPSG:4326").alias("crs"), F.lit(WIDTH // 2).alias("width"), F.expr("h div 2").alias("height"), F.lit(1).alias("band_count"), F.lit("NaN").alias("nodata"),
        F.struct(F.lit(LEFT).alias("left"), (F.lit(TOP) - F.col("h") * tall).alias("bottom"), F.lit(LEFT + WIDTH * XRES).alias("right"), F.lit(TOP).alias("top")).alias("bounds"), F.struct(F.lit(2 * XRES).alias("x"), F.lit(2 * tall).alias("y")).alias("resolution"),
    )
    return top.select(F.to_json(meta, {"pretty": "true"}).alias("value"))


def second_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the second product: every second order of every second row; NaN where the order is finished."""
    row, col = F.expr(f"o_orderkey div {WIDTH}"), F.col("o_orderkey") % WIDTH
    value = F.when(F.col("o_orderstatus") == "F", F.lit(float("nan"))).otherwise(F.col("o_totalprice") / 2)
    return table(spark, sf_dir, "orders").filter((row % 2 == 0) & (col % 2 == 0)).select(F.expr(f"cast(o_orderkey div {WIDTH} div 2 as int)").alias("row"), F.expr(f"cast(o_orderkey % {WIDTH} div 2 as int)").alias("col"), value.alias("value"))


def _feature(kind: object, coordinates: object, zone: str = "zone_id", parent: str = "parent_id") -> object:
    """One feature as JSON text, from the JSON text of its coordinates."""
    return F.concat(F.lit('{"type": "Feature", "properties": {"iso": "'), F.col(zone), F.lit('", "adm0": "'), F.col(parent), F.lit('"}, "geometry": {"type": "'), kind, F.lit('", "coordinates": '), coordinates, F.lit("}}"))


def _collection(features: DataFrame, path: str) -> str:
    whole = features.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": [\n'), F.array_join(F.collect_list("feature"), ",\n"), F.lit("]}")).alias("value"))
    whole.write.text(path)
    return path


def write_features(polygons: DataFrame, path: str) -> str:
    """Polygons (zone_id, parent_id, rings) as a GeoJSON file of features."""
    pair = lambda p: F.array(p["x"], p["y"])
    closed = F.transform("rings", lambda r: F.concat(F.transform(r, pair), F.array(pair(r[0]))))
    return _collection(polygons.select(_feature(F.lit("Polygon"), F.to_json(closed)).alias("feature")), path)


def nation_features(spark: SparkSession, sf_dir: str, path: str) -> str:
    """A GeoJSON file with a feature a nation: an outline, a hole in every other, a second part in every third; some are
    lines and some are not closed.
    """
    k = F.col("n_nationkey").cast("double")
    ring = lambda *points: F.array(*[F.array((k + x), F.lit(float(y))) for x, y in points])
    outline = F.when(F.col("n_nationkey") % 11 == 5, ring((0, 0), (1, 0), (1, 5), (0, 5))).otherwise(ring((0, 0), (1, 0), (1, 5), (0, 5), (0, 0)))
    hole = ring((0.25, 1), (0.5, 1), (0.25, 4), (0.25, 1))
    first = F.when(F.col("n_nationkey") % 2 == 0, F.array(outline, hole)).otherwise(F.array(outline))
    second = F.array(ring((0, -10), (1, -10), (0, 0), (0, -10)))
    several = F.col("n_nationkey") % 3 == 0
    text = F.when(several, F.to_json(F.array(first, second))).otherwise(F.to_json(first))
    kind = F.when(F.col("n_nationkey") % 7 == 3, "LineString").when(several, "MultiPolygon").otherwise("Polygon")
    named = table(spark, sf_dir, "nation").withColumns({"zone_id": F.col("n_nationkey").cast("string"), "parent_id": F.col("n_regionkey").cast("string")})
    return _collection(named.select(_feature(kind, text).alias("feature")), path)
