"""One query an operator on the stand-ins, and SQL that gets the same by another way where there is one.

Doubles are rounded where the order of a sum shows. In SQL, zones come from ray casting instead of scanlines.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grid as gr
from ..operators import agreement as ag
from ..operators import cells as ce
from ..operators import truth as tr
from ..operators import zonal as zo
from ..operators import zones as zn
from ..operators.tiles import Tiles, block_aggregate_any, zonal_sums_of_tiles
from ..sources import geojson as so_geo
from ..sources import products as so
from ..sources.shared import shared_dir
from . import stand_ins as st
from . import validation as va

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def shared(spark: SparkSession) -> str:
    """A new folder that all executors see."""
    return f"{shared_dir(spark)}/rastermill-{uuid.uuid4().hex}"


def r(c: str | Column, n: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# What both sides start from.
CELLS = """cells AS (SELECT CAST(o_orderkey // 150 AS INTEGER) AS "row", CAST(o_orderkey % 150 AS INTEGER) AS col, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END AS value FROM orders), size AS (SELECT max(o_orderkey) // 150 + 1 AS h FROM orders)"""
REGIONS = """corners AS (SELECT CAST(n_nationkey AS VARCHAR) AS zone_id, CAST(n_regionkey AS VARCHAR) AS parent_id, 60.0 * n_regionkey AS xl, 60.0 * n_regionkey + 60 AS xr, 2.0 * h * j / 5 AS tl, 2.0 * h * j / 5 + CASE WHEN j > 0 THEN h / 10.0 ELSE 0 END AS tr, 2.0 * h * (j + 1) / 5 AS bl, 2.0 * h * (j + 1) / 5 + CASE WHEN j < 4 THEN h / 10.0 ELSE 0 END AS br FROM (SELECT *, n_nationkey // 5 AS j FROM nation), size)"""
COUNTRIES = """corners AS (SELECT CAST(r_regionkey AS VARCHAR) AS zone_id, CAST(NULL AS VARCHAR) AS parent_id, 60.0 * r_regionkey AS xl, 60.0 * r_regionkey + 60 AS xr, 0.0 AS tl, 0.0 AS tr, 2.0 * h AS bl, 2.0 * h AS br FROM region, size)"""
EDGES = """edges AS (SELECT zone_id, parent_id, CASE WHEN f THEN xa ELSE xb END AS x1, CASE WHEN f THEN ya ELSE yb END AS y1, CASE WHEN f THEN xb ELSE xa END AS x2, CASE WHEN f THEN yb ELSE ya END AS y2 FROM (SELECT *, ya < yb OR (ya = yb AND xa <= xb) AS f FROM (SELECT zone_id, parent_id, xl AS xa, tl AS ya, xr AS xb, tr AS yb FROM corners UNION ALL SELECT zone_id, parent_id, xr, tr, xr, br FROM corners UNION ALL SELECT zone_id, parent_id, xr, br, xl, bl FROM corners UNION ALL SELECT zone_id, parent_id, xl, bl, xl, tl FROM corners)))"""
CAST_RAYS = """assigned AS (SELECT e.zone_id, any_value(e.parent_id) AS parent_id, c."row", c.col, any_value(c.value) AS value FROM cells c JOIN edges e ON e.y1 <= 2 * c."row" + 1 AND 2 * c."row" + 1 < e.y2 AND e.x1 + (2 * c."row" + 1 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) > 2 * c.col + 1 GROUP BY e.zone_id, c."row", c.col HAVING count(*) % 2 = 1)"""
BY_REGION = f"WITH {CELLS}, {REGIONS}, {EDGES}, {CAST_RAYS}"
BY_COUNTRY = f"WITH {CELLS}, {COUNTRIES}, {EDGES}, {CAST_RAYS}"
COUNTRY_TRUTH = """truth AS (SELECT 'country' AS task, CASE WHEN n_regionkey = 4 THEN '99' ELSE CAST(n_regionkey AS VARCHAR) END AS zone_id, sum(c_acctbal) AS truth FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"""
REGION_TRUTH = """truth AS (SELECT 'region' AS task, CAST(c_nationkey AS VARCHAR) AS zone_id, sum(c_acctbal) AS truth FROM customer GROUP BY ALL)"""
META = """meta AS (SELECT s_name AS dataset_name, s_suppkey AS k, s_suppkey % 5 AS r, CASE WHEN s_suppkey % 3 = 2 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS crs, CASE WHEN s_suppkey % 2 = 0 THEN '-9999.0' ELSE 'NaN' END AS nodata, CAST((s_suppkey % 5 + 1) * 60 AS BIGINT) AS width, 30.0 + CASE WHEN s_suppkey % 7 = 3 THEN 1 ELSE 0 END AS right_, 30.0 + CASE WHEN s_suppkey % 11 = 5 THEN 1 ELSE 0 END AS top_, CAST(1.0 AS DOUBLE) / (s_suppkey % 5 + 1) AS res FROM supplier)"""


def masked(spark: SparkSession, d: str) -> DataFrame:
    return ce.mask_nodata(st.demand_cells(spark, d), st.NODATA)


def region_edges(spark: SparkSession, d: str) -> DataFrame:
    return so.ring_edges(st.region_rings(spark, d))


def country_edges(spark: SparkSession, d: str) -> DataFrame:
    return so.ring_edges(st.country_rings(spark, d))


def in_zones(spark: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    return zn.assign_zones(masked(spark, d), zn.scanline_spans(edges, st.WIDTH, st.height(spark, d), bin=32), bin=32)


def in_regions(spark: SparkSession, d: str) -> DataFrame:
    return in_zones(spark, d, region_edges(spark, d))


def in_countries(spark: SparkSession, d: str) -> DataFrame:
    return in_zones(spark, d, country_edges(spark, d))


def region_totals(spark: SparkSession, d: str) -> DataFrame:
    return zo.with_parent(zo.zonal_stats(in_regions(spark, d)), st.region_rings(spark, d))


def grid_of(spark: SparkSession, d: str) -> gr.GridSpec:
    return gr.GridSpec(st.WIDTH, st.height(spark, d), -180.0, 75.0, 0.25, 0.125)


def metadata(spark: SparkSession, d: str) -> DataFrame:
    """The products' JSON, written and read as a user's files would be."""
    path = shared(spark)
    st.product_metadata(spark, d).select(F.to_json("m").alias("value")).write.text(path)
    return so.read_product_metadata(spark, path, multi_line=False)


@query(f"WITH {META} SELECT dataset_name, nodata, crs, width, width AS height, CAST(-30 AS DOUBLE) AS \"left\", CAST(right_ AS DOUBLE) AS \"right\", round(res, 6) AS xres FROM meta")
def r1_product_metadata(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).select("dataset_name", "nodata", "crs", "width", "height", F.col("bounds.left").alias("left"), F.col("bounds.right").alias("right"), r("resolution.x").alias("xres"))


@query(f"WITH {CELLS} SELECT * FROM cells")
def r2_read_cells(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    st.demand_cells(spark, d).write.parquet(f"{path}/cells")
    st.own_metadata(spark, d, st.NODATA).write.text(f"{path}/meta")
    return so.read_cells(spark, f"{path}/cells", so.read_product_metadata(spark, f"{path}/meta"))


@query(f"WITH {CELLS} SELECT * FROM cells")
def r3_tiles_to_cells(spark: SparkSession, d: str) -> DataFrame:
    return so.tiles_to_cells(so.cells_to_tiles(masked(spark, d), 64, 5), 64, 5, st.WIDTH, st.height(spark, d))


@query(f"WITH {CELLS}, {REGIONS} SELECT zone_id, parent_id, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS at, round(CAST(unnest([xl, xr, xr, xl]) AS DOUBLE), 6) AS x, round(CAST(unnest([tl, tr, br, bl]) AS DOUBLE), 6) AS y FROM corners")
def r4_boundaries(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    st.region_rings(spark, d).write.json(path)
    points = so.read_boundaries(spark, path, "json").select("zone_id", "parent_id", F.posexplode("ring").alias("at", "p"))
    return points.select("zone_id", "parent_id", "at", r("p.x").alias("x"), r("p.y").alias("y"))


@query(f"WITH {CELLS}, {REGIONS}, {EDGES} SELECT zone_id, parent_id, CAST(x1 AS DOUBLE) AS x1, round(CAST(y1 AS DOUBLE), 6) AS y1, CAST(x2 AS DOUBLE) AS x2, round(CAST(y2 AS DOUBLE), 6) AS y2 FROM edges")
def r5_ring_edges(spark: SparkSession, d: str) -> DataFrame:
    return region_edges(spark, d).select("zone_id", "parent_id", "x1", r("y1").alias("y1"), "x2", r("y2").alias("y2"))


@query(f"WITH {REGION_TRUTH} SELECT task, zone_id, round(truth, 2) AS truth FROM truth")
def r6_truth(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    st.region_truth(spark, d).select(F.col("zone_id").alias("code"), F.round("truth", 4).alias("amount")).write.option("header", True).csv(path)
    return so.read_truth(spark, path, "region", {"zone_id": "code", "truth": "amount"}).withColumn("truth", r("truth", 2))


@query(f"{BY_COUNTRY} SELECT 'country' AS task, zone_id AS subject, 'sum' AS measure, round(sum(value), 2) AS value FROM assigned GROUP BY zone_id")
def r7_report(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    totals = zo.zonal_stats(in_countries(spark, d))
    so.write_report(totals.select(F.lit("country").alias("task"), F.col("zone_id").alias("subject"), F.lit("sum").alias("measure"), F.col("sum").alias("value")), path)
    return spark.read.parquet(path).withColumn("value", r("value", 2))


@query(f"WITH {CELLS} SELECT * FROM cells")
def a1_mask_nodata(spark: SparkSession, d: str) -> DataFrame:
    return ce.mask_nodata(st.spectrum_cells(spark, d))


@query(f"WITH {CELLS}, {REGIONS}, {EDGES} SELECT zone_id, count(*) AS edges FROM edges WHERE parent_id = '2' GROUP BY zone_id")
def a2_select_parent(spark: SparkSession, d: str) -> DataFrame:
    return so.ring_edges(zn.select_parent(st.region_rings(spark, d), "2")).groupBy("zone_id").agg(F.count(F.lit(1)).alias("edges"))


@query("SELECT task, level, zone_id FROM (VALUES ('country', 0), ('province', 1), ('levels', 1)) t(task, level) JOIN (SELECT 0 AS level, CAST(r_regionkey AS VARCHAR) AS zone_id FROM region UNION ALL SELECT 1, CAST(n_nationkey AS VARCHAR) FROM nation) USING (level)")
def a3_boundaries_for_task(spark: SparkSession, d: str) -> DataFrame:
    tasks = spark.createDataFrame([("country", 0), ("province", 1), ("levels", 1)], "task string, level int")
    zones = st.country_rings(spark, d).withColumn("level", F.lit(0)).unionByName(st.region_rings(spark, d).withColumn("level", F.lit(1)))
    return zn.boundaries_for_task(tasks, zones).select("task", "level", "zone_id")


POINTS = "points AS (SELECT event_id, CAST(event_id * 7919 % 40000 AS DOUBLE) / 100 - 200 AS lon, CAST(event_id * 104729 % 18000 AS DOUBLE) / 100 - 90 AS lat FROM events)"


def points(spark: SparkSession, d: str) -> DataFrame:
    return st.table(spark, d, "events").select("event_id", ((F.col("event_id") * 7919 % 40000).cast("double") / 100 - 200).alias("lon"), ((F.col("event_id") * 104729 % 18000).cast("double") / 100 - 90).alias("lat"))


@query(f"WITH {CELLS}, {POINTS} SELECT event_id, lon, lat FROM points, size WHERE lon >= -180 AND lon < -142.5 AND lat <= 75 AND lat > 75 - h * 0.125")
def a4_clip_to_extent(spark: SparkSession, d: str) -> DataFrame:
    return gr.clip_to_extent(points(spark, d), grid_of(spark, d))


@query(f"WITH {META} SELECT dataset_name, CAST(nodata AS DOUBLE) AS nodata FROM meta")
def f1_parse_nodata(spark: SparkSession, d: str) -> DataFrame:
    return metadata(spark, d).select("dataset_name", gr.parse_nodata(F.col("nodata")).alias("nodata"))


@query(f'WITH {CELLS} SELECT "row", col, round(-180 + (2 * col + 1) * CAST(0.125 AS DOUBLE), 6) AS lon, round(75 - (2 * "row" + 1) * CAST(0.0625 AS DOUBLE), 6) AS lat FROM cells')
def f2_cell_center(spark: SparkSession, d: str) -> DataFrame:
    return gr.cell_center(masked(spark, d), grid_of(spark, d)).select("row", "col", r("lon").alias("lon"), r("lat").alias("lat"))


@query(f'WITH {POINTS} SELECT event_id, CAST(floor((75 - lat) / CAST(0.125 AS DOUBLE)) AS INTEGER) AS "row", CAST(floor((lon + 180) / CAST(0.25 AS DOUBLE)) AS INTEGER) AS col FROM points')
def f3_cell_of(spark: SparkSession, d: str) -> DataFrame:
    return gr.cell_of(points(spark, d), grid_of(spark, d)).select("event_id", "row", "col")


@query(f"WITH {META} SELECT dataset_name, right_ = 30 AS width_ok, top_ = 30 AS height_ok FROM meta")
def f4_declared_geometry(spark: SparkSession, d: str) -> DataFrame:
    return gr.declared_geometry_ok(metadata(spark, d)).select("dataset_name", "width_ok", "height_ok")


@query(f"WITH {META} SELECT dataset_name, round(res * 3600, 6) AS arcsec_x, r = 0 AS as_declared FROM meta")
def f5_resolution_arcsec(spark: SparkSession, d: str) -> DataFrame:
    return gr.resolution_arcsec(metadata(spark, d), 3600.0).select("dataset_name", "arcsec_x", "as_declared")


@query(f"""{BY_REGION} SELECT zone_id, "row", CAST(min(col) AS INTEGER) AS c0, CAST(max(col) + 1 AS INTEGER) AS c1 FROM assigned GROUP BY zone_id, "row" """)
def j1_scanline_spans(spark: SparkSession, d: str) -> DataFrame:
    return zn.scanline_spans(region_edges(spark, d), st.WIDTH, st.height(spark, d), bin=1000).select("zone_id", "row", "c0", "c1")


@query(f'{BY_REGION} SELECT zone_id, "row", col, value FROM assigned')
def j2_assign_zones(spark: SparkSession, d: str) -> DataFrame:
    return in_regions(spark, d)


def country_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tr.join_truth(zo.zonal_stats(in_countries(spark, d)).withColumn("task", F.lit("country")), st.country_truth(spark, d))


def region_pairs(spark: SparkSession, d: str) -> DataFrame:
    return tr.join_truth(zo.zonal_stats(in_regions(spark, d)).withColumn("task", F.lit("region")), st.region_truth(spark, d))


COUNTRY_PAIRS = f"{BY_COUNTRY}, {COUNTRY_TRUTH}, totals AS (SELECT 'country' AS task, zone_id, sum(value) AS prediction FROM assigned GROUP BY zone_id), pairs AS (SELECT task, zone_id, prediction, truth FROM totals FULL JOIN truth USING (task, zone_id))"
REGION_PAIRS = f"{BY_REGION}, {REGION_TRUTH}, totals AS (SELECT 'region' AS task, zone_id, sum(value) AS prediction FROM assigned GROUP BY zone_id), pairs AS (SELECT task, zone_id, prediction, truth FROM totals FULL JOIN truth USING (task, zone_id))"


@query(f"{COUNTRY_PAIRS} SELECT task, zone_id, round(prediction, 2) AS prediction, round(truth, 2) AS truth FROM pairs")
def j3_join_truth(spark: SparkSession, d: str) -> DataFrame:
    return country_pairs(spark, d).select("task", "zone_id", r("prediction", 2).alias("prediction"), r("truth", 2).alias("truth"))


@query(f"{COUNTRY_PAIRS} SELECT task, zone_id, CASE WHEN truth IS NULL THEN 'truth' ELSE 'zone' END AS missing FROM pairs WHERE truth IS NULL OR prediction IS NULL")
def j4_unmatched_zones(spark: SparkSession, d: str) -> DataFrame:
    return tr.unmatched_zones(zo.zonal_stats(in_countries(spark, d)).withColumn("task", F.lit("country")), st.country_truth(spark, d))


@query(f"{BY_REGION} SELECT parent_id, round(sum(value), 2) AS regions_sum, count(DISTINCT zone_id) AS regions, round(sum(value), 2) AS country_sum FROM assigned GROUP BY parent_id")
def j5_join_parent(spark: SparkSession, d: str) -> DataFrame:
    both = zo.join_parent(region_totals(spark, d), zo.zonal_stats(in_countries(spark, d)))
    return both.select("parent_id", r("regions_sum", 2).alias("regions_sum"), "regions", r("country_sum", 2).alias("country_sum"))


@query(f"WITH {COUNTRY_TRUTH} SELECT task, CASE WHEN zone_id = '99' THEN '4' ELSE zone_id END AS zone_id, round(truth, 2) AS truth FROM truth")
def j6_correct_codes(spark: SparkSession, d: str) -> DataFrame:
    codes = st.table(spark, d, "region").filter("r_regionkey = 4").select(F.lit("99").alias("code"), F.col("r_regionkey").cast("string").alias("corrected"))
    return tr.correct_codes(st.country_truth(spark, d), codes).select("task", "zone_id", r("truth", 2).alias("truth"))


STATS = 'count(*) AS cells, count(value) AS valid, round(sum(value), 2) AS "sum", round(avg(value), 4) AS mean, min(value) AS "min", max(value) AS "max", round(stddev_samp(value), 3) AS std'


@query(f"{BY_REGION} SELECT zone_id, {STATS} FROM assigned GROUP BY zone_id")
def g1_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return zo.zonal_stats(in_regions(spark, d)).select("zone_id", "cells", "valid", r("sum", 2).alias("sum"), r("mean", 4).alias("mean"), "min", "max", r("std", 3).alias("std"))


@query(f"{BY_REGION} SELECT zone_id, count(*) AS cells, count(value) AS valid, round(count(value) / count(*), 6) AS share FROM assigned GROUP BY zone_id")
def g2_zonal_coverage(spark: SparkSession, d: str) -> DataFrame:
    return zo.zonal_coverage(in_regions(spark, d)).withColumn("share", r("share"))


@query(f'WITH {CELLS} SELECT count(*) AS cells, count(value) AS valid, count(*) - count(value) AS nodata, min(value) AS "min", max(value) AS "max", round(avg(value), 4) AS mean FROM cells')
def g3_raster_summary(spark: SparkSession, d: str) -> DataFrame:
    return ce.raster_summary(masked(spark, d)).withColumn("mean", r("mean", 4))


@query(f'WITH {CELLS}, {META} SELECT dataset_name, width, width AS height, min("row") AS min_row, max("row") AS max_row, min(col) AS min_col, max(col) AS max_col, count(*) AS cells, min("row") = 0 AND max("row") = width - 1 AND min(col) = 0 AND max(col) = width - 1 AND count(*) = width * width AS as_declared FROM meta, cells GROUP BY dataset_name, width')
def g4_observed_shape(spark: SparkSession, d: str) -> DataFrame:
    return ce.observed_shape(masked(spark, d), metadata(spark, d))


LINES = 'lines AS (SELECT CAST(l_orderkey AS INTEGER) AS "row", CAST(l_linenumber - 1 AS INTEGER) AS col FROM lineitem)'


@query(f'WITH {LINES} SELECT "row", col, count(*) AS times FROM lines GROUP BY "row", col HAVING count(*) > 1')
def g5_duplicate_cells(spark: SparkSession, d: str) -> DataFrame:
    return ce.duplicate_cells(st.line_cells(spark, d), 7)


@query(f'WITH {LINES} SELECT CAST(g."row" AS INTEGER) AS "row", CAST(k.col AS INTEGER) AS col FROM (SELECT o_orderkey AS "row" FROM orders) g CROSS JOIN range(7) k(col) WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l."row" = g."row" AND l.col = k.col)')
def g6_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    return ce.missing_cells(st.line_cells(spark, d), 7, st.table(spark, d, "orders").count())


@query(f'{BY_REGION}, t AS (SELECT parent_id, zone_id, sum(value) AS s FROM assigned GROUP BY parent_id, zone_id) SELECT CAST(0 AS INTEGER) AS level, parent_id, zone_id, round(s, 2) AS "sum" FROM t UNION ALL SELECT 1, parent_id, NULL, round(sum(s), 2) FROM t GROUP BY parent_id UNION ALL SELECT 2, NULL, NULL, round(sum(s), 2) FROM t')
def g7_rollup_totals(spark: SparkSession, d: str) -> DataFrame:
    return zo.rollup_totals(region_totals(spark, d)).withColumn("sum", r("sum", 2))


BLOCKS = f'WITH {CELLS} SELECT CAST("row" // 2 AS INTEGER) AS "row", CAST(col // 2 AS INTEGER) AS col, round(sum(value), 2) AS value, round(avg(value), 4) AS mean, count(value) AS valid FROM cells GROUP BY 1, 2'


@query(BLOCKS)
def g8_block_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return ce.block_aggregate(masked(spark, d), 2).select("row", "col", r("value", 2).alias("value"), r("mean", 4).alias("mean"), "valid")


@query(BLOCKS)
def g8_block_aggregate_tiles(spark: SparkSession, d: str) -> DataFrame:
    tiles = so.cells_to_tiles(masked(spark, d), 50, 10)
    return ce.block_aggregate_tiles(tiles, 50, 10, 2).select("row", "col", r("value", 2).alias("value"), r("mean", 4).alias("mean"), "valid")


AGREEMENT = """SELECT task, count(*) AS n, round(avg(prediction - truth), 4) AS bias, round(avg(abs(prediction - truth)), 4) AS mae, round(sqrt(avg((prediction - truth) * (prediction - truth))), 4) AS rmse, round(abs(sum(prediction - truth)) / nullif(abs(sum(truth)), 0), 6) AS relative_error, round(regr_sxy(prediction, truth) / nullif(sqrt(regr_sxx(prediction, truth) * regr_syy(prediction, truth)), 0), 6) AS pearson, round(regr_sxy(prediction, truth) / nullif(regr_sxx(prediction, truth), 0), 6) AS slope FROM pairs WHERE prediction IS NOT NULL AND truth IS NOT NULL GROUP BY task"""


@query(f"{REGION_PAIRS} {AGREEMENT}")
def g9_agreement(spark: SparkSession, d: str) -> DataFrame:
    a = ag.agreement(region_pairs(spark, d))
    return a.select("task", "n", *[r(c, 4).alias(c) for c in ("bias", "mae", "rmse")], *[r(c).alias(c) for c in ("relative_error", "pearson", "slope")])


@query(f"{BY_REGION}, t AS (SELECT parent_id, zone_id, sum(value) AS s FROM assigned GROUP BY parent_id, zone_id) SELECT parent_id, zone_id, round(s / sum(s) OVER (PARTITION BY parent_id), 6) AS share FROM t")
def w1_share_of_parent(spark: SparkSession, d: str) -> DataFrame:
    return zo.share_of_parent(region_totals(spark, d)).select("parent_id", "zone_id", r("share").alias("share"))


@query(f"WITH {COUNTRY_TRUTH}, other AS (SELECT 'region' AS task, CAST(c_nationkey AS VARCHAR) AS zone_id, sum(c_acctbal) AS truth FROM customer GROUP BY ALL) SELECT task, zone_id, round(truth, 2) AS truth FROM (SELECT * FROM truth UNION ALL SELECT * FROM other)")
def u1_union_truth(spark: SparkSession, d: str) -> DataFrame:
    return tr.union_truth(st.country_truth(spark, d), st.region_truth(spark, d)).withColumn("truth", r("truth", 2))


@query(f"WITH {META} SELECT a.dataset_name AS product_a, b.dataset_name AS product_b, a.crs = b.crs AS same_crs, a.right_ = b.right_ AND a.top_ = b.top_ AS same_bounds, abs(greatest(a.res, b.res) / least(a.res, b.res) - round(greatest(a.res, b.res) / least(a.res, b.res))) < 1e-9 AS whole_ratio, round(greatest(a.res, b.res) / least(a.res, b.res), 6) AS ratio FROM meta a JOIN meta b ON b.k = a.k + 1 OR b.k = a.k + 30")
def u2_grids_aligned(spark: SparkSession, d: str) -> DataFrame:
    names = st.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("product_a"))
    other = names.select(F.explode(F.array(F.col("k") - 1, F.col("k") - 30)).alias("k"), F.col("product_a").alias("product_b"))
    return gr.grids_aligned(metadata(spark, d), names.join(other, "k"))


@query(f"""WITH {CELLS} SELECT "row", round(sum(value * 6371.0088 * 6371.0088 * radians(0.25) * (sin(radians(75 - "row" * CAST(0.125 AS DOUBLE))) - sin(radians(75 - ("row" + 1) * CAST(0.125 AS DOUBLE))))), 0) AS weighted FROM cells GROUP BY "row" """)
def c1_area_weighted(spark: SparkSession, d: str) -> DataFrame:
    return gr.cell_area(masked(spark, d), grid_of(spark, d)).groupBy("row").agg(F.round(F.sum(F.col("value") * F.col("area_km2")), 0).alias("weighted"))


RANKED = "ranked AS (SELECT task, rank() OVER (PARTITION BY task ORDER BY prediction) + (count(*) OVER (PARTITION BY task, prediction) - 1) / 2 AS p, rank() OVER (PARTITION BY task ORDER BY truth) + (count(*) OVER (PARTITION BY task, truth) - 1) / 2 AS t FROM pairs WHERE prediction IS NOT NULL AND truth IS NOT NULL)"


@query(f"{REGION_PAIRS}, {RANKED} SELECT task, count(*) AS n, round(corr(p, t), 6) AS spearman FROM ranked GROUP BY task")
def c2_rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    return ag.rank_agreement(region_pairs(spark, d)).withColumn("spearman", r("spearman"))


@query(f"{REGION_PAIRS}, e AS (SELECT task, zone_id, abs(prediction - truth) / nullif(abs(truth), 0) AS e FROM pairs) SELECT task, zone_id, round(e, 6) AS relative_error, CAST(place AS INTEGER) AS place FROM (SELECT *, rank() OVER (PARTITION BY task ORDER BY e DESC) AS place FROM e WHERE e IS NOT NULL) WHERE place <= 5")
def c3_worst_zones(spark: SparkSession, d: str) -> DataFrame:
    return ag.worst_zones(region_pairs(spark, d), 5).select("task", "zone_id", r("relative_error").alias("relative_error"), "place")


@query(f'{BY_REGION} SELECT "row", col, count(*) AS zones FROM (SELECT "row", col FROM assigned UNION ALL SELECT "row", col FROM cells WHERE col // 30 < 5) GROUP BY "row", col HAVING count(*) > 1')
def c4_overlapping_cells(spark: SparkSession, d: str) -> DataFrame:
    both = region_edges(spark, d).unionByName(country_edges(spark, d).withColumn("zone_id", F.concat(F.lit("c"), F.col("zone_id"))))
    return zn.overlapping_cells(in_zones(spark, d, both))


@query(f"WITH {CELLS}, {REGIONS}, {EDGES} SELECT zone_id, max(y2 + 7) > 2 * max(h) OR min(y1 + 7) < 0 OR min(x1) < 0 OR max(x1) > 300 OR min(x2) < 0 OR max(x2) > 300 AS clipped FROM edges, size GROUP BY zone_id")
def c5_clipped_zones(spark: SparkSession, d: str) -> DataFrame:
    lower = region_edges(spark, d).withColumns({"y1": F.col("y1") + 7, "y2": F.col("y2") + 7})
    return zn.clipped_zones(lower, st.WIDTH, st.height(spark, d)).select("zone_id", "clipped")


def _report(df: DataFrame, n: int = 4) -> DataFrame:
    return df.withColumn("value", r("value", n))


LONG = "long AS (SELECT task, unnest(['n', 'bias', 'mae', 'rmse', 'relative_error', 'pearson', 'r2', 'slope', 'spearman', 'zones_without_truth', 'truth_without_zone']) AS measure, unnest([n, bias, mae, rmse, relative_error, pearson, pearson * pearson, slope, spearman, a, b]) AS value FROM wide)"
WIDE = "wide AS (SELECT *, (SELECT corr(p, t) FROM ranked) AS spearman, (SELECT count(*) FROM pairs WHERE truth IS NULL) AS a, (SELECT count(*) FROM pairs WHERE prediction IS NULL) AS b FROM (SELECT task, count(*) AS n, avg(prediction - truth) AS bias, avg(abs(prediction - truth)) AS mae, sqrt(avg((prediction - truth) * (prediction - truth))) AS rmse, abs(sum(prediction - truth)) / nullif(abs(sum(truth)), 0) AS relative_error, regr_sxy(prediction, truth) / nullif(sqrt(regr_sxx(prediction, truth) * regr_syy(prediction, truth)), 0) AS pearson, regr_sxy(prediction, truth) / nullif(regr_sxx(prediction, truth), 0) AS slope FROM pairs WHERE prediction IS NOT NULL AND truth IS NOT NULL GROUP BY task))"


@query(f"{COUNTRY_PAIRS}, {RANKED}, {WIDE}, {LONG} SELECT task, 'zones' AS subject, measure, round(CAST(value AS DOUBLE), 4) AS value FROM long")
def job_country_consistency(spark: SparkSession, d: str) -> DataFrame:
    return _report(va.consistency(st.demand_cells(spark, d), country_edges(spark, d), st.country_truth(spark, d), st.WIDTH, st.height(spark, d), "country", st.NODATA))


def product(spark: SparkSession, d: str, nodata: float | None) -> tuple[va.Product, str]:
    """The stand-in raster as files, and the folder they lie in."""
    path = shared(spark)
    st.own_metadata(spark, d, nodata).write.text(f"{path}/meta")
    (st.spectrum_cells(spark, d) if nodata is None else st.demand_cells(spark, d)).write.parquet(f"{path}/cells")
    return va.Product(f"{path}/meta", f"{path}/cells"), path


PROVINCES = f"{BY_REGION}, {REGION_TRUTH}, totals AS (SELECT 'region' AS task, zone_id, sum(value) AS prediction FROM assigned WHERE parent_id = '2' GROUP BY zone_id), pairs AS (SELECT task, zone_id, prediction, truth FROM totals FULL JOIN (SELECT * FROM truth WHERE zone_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 2)) USING (task, zone_id))"


@query(f"{PROVINCES}, {RANKED}, {WIDE}, {LONG} SELECT task, 'zones' AS subject, measure, round(CAST(value AS DOUBLE), 4) AS value FROM long")
def job_province_consistency(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, st.NODATA)
    st.in_degrees(st.region_rings(spark, d), st.yres(spark, d)).write.parquet(f"{path}/regions")
    st.region_truth(spark, d).select(F.col("zone_id").alias("code"), F.col("truth").alias("amount")).write.option("header", True).csv(f"{path}/truth")
    return _report(va.run_consistency(spark, own, f"{path}/regions", f"{path}/truth", {"zone_id": "code", "truth": "amount"}, "region", f"{path}/report", parent_id="2"))


MEASURED = "SELECT unnest(['n', 'bias', 'mae', 'rmse', 'relative_error', 'pearson', 'r2', 'slope']) AS measure, round(CAST(unnest([n, bias, mae, rmse, relative_error, pearson, pearson * pearson, slope]) AS DOUBLE), 4) + 0.0 AS value FROM (SELECT count(*) AS n, avg(p - t) AS bias, avg(abs(p - t)) AS mae, sqrt(avg((p - t) * (p - t))) AS rmse, abs(sum(p - t)) / nullif(abs(sum(t)), 0) AS relative_error, regr_sxy(p, t) / nullif(sqrt(regr_sxx(p, t) * regr_syy(p, t)), 0) AS pearson, regr_sxy(p, t) / nullif(regr_sxx(p, t), 0) AS slope FROM two)"


@query(f"{BY_REGION}, t AS (SELECT parent_id, zone_id, sum(value) AS s, count(value) AS v, count(*) AS c FROM assigned GROUP BY parent_id, zone_id), whole AS (SELECT CAST(col // 30 AS VARCHAR) AS parent_id, sum(value) AS t FROM cells GROUP BY 1), two AS (SELECT sum(s) AS p, any_value(t) AS t FROM t JOIN whole USING (parent_id) GROUP BY parent_id) SELECT 'levels' AS task, 'countries' AS subject, measure, value FROM ({MEASURED}) UNION ALL SELECT 'levels', zone_id, unnest(['share', 'valid_share']), round(unnest([s / sum(s) OVER (PARTITION BY parent_id), v / c]), 4) FROM t")
def job_across_levels(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, st.NODATA)
    st.in_degrees(st.region_rings(spark, d), st.yres(spark, d)).write.parquet(f"{path}/regions")
    st.in_degrees(st.country_rings(spark, d), st.yres(spark, d)).write.parquet(f"{path}/countries")
    return _report(va.run_across_levels(spark, own, f"{path}/regions", f"{path}/countries", f"{path}/report"))


COARSE = """coarse AS (SELECT "row" // 2 AS "row", col // 2 AS col, sum(value) AS value FROM cells GROUP BY 1, 2), hit AS (SELECT zone_id, c."row", c.col, any_value(value) AS value FROM coarse c JOIN edges e ON e.y1 / 2 <= 2 * c."row" + 1 AND 2 * c."row" + 1 < e.y2 / 2 AND e.x1 / 2 + (2 * c."row" + 1 - e.y1 / 2) * (e.x2 - e.x1) / (e.y2 - e.y1) > 2 * c.col + 1 GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query(f"{BY_REGION}, {COARSE}, two AS (SELECT p, t FROM (SELECT zone_id, sum(value) AS p FROM assigned GROUP BY zone_id) JOIN (SELECT zone_id, sum(value) AS t FROM hit GROUP BY zone_id) USING (zone_id)) SELECT 'grids' AS task, 'zones' AS subject, measure, value FROM ({MEASURED})")
def job_across_grids(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, st.NODATA)
    st.in_degrees(st.region_rings(spark, d), st.yres(spark, d)).write.parquet(f"{path}/regions")
    return _report(va.run_across_grids(spark, own, f"{path}/regions", f"{path}/report"))


@query(f"WITH {CELLS} SELECT 'product' AS task, 'raster' AS subject, unnest(['width_ok', 'height_ok', 'as_declared', 'shape_as_declared', 'cells', 'valid', 'nodata', 'min', 'max', 'mean', 'duplicate_cells', 'missing_cells']) AS measure, round(CAST(unnest([1, 1, 0, CAST(count(*) = 150 * any_value(h) AS INTEGER), count(*), count(value), count(*) - count(value), min(value), max(value), avg(value), count(*) - count(DISTINCT (\"row\", col)), 150 * any_value(h) - count(DISTINCT (\"row\", col))]) AS DOUBLE), 4) AS value FROM cells, size")
def job_product_test(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, None)
    return _report(va.run_product_test(spark, own, f"{path}/report", arcsec=900.0))


# Totals from tiles, exact totals, cells in place, overlaps and what lies outside, other grids, GeoJSON.

UNITS = "SELECT {0}, count(*) AS cells, count(value) AS valid, CAST(coalesce(sum(CAST(floor(value * 1048576 + 0.5) AS HUGEINT)), 0) AS DOUBLE) / CAST(1048576 AS DOUBLE) AS s, CAST(coalesce(sum(CAST(floor(value * value * 4096 + 0.5) AS HUGEINT)), 0) AS DOUBLE) / CAST(4096 AS DOUBLE) AS q, min(value) AS low, max(value) AS high FROM assigned GROUP BY {0}"
EXACT_STATS = f'{BY_REGION}, u AS ({UNITS.format("zone_id")}) SELECT zone_id, cells, valid, CASE WHEN valid > 0 THEN s END AS "sum", CASE WHEN valid > 0 THEN s / valid END AS mean, low AS "min", high AS "max", CASE WHEN valid > 1 THEN sqrt(greatest(q - s * (s / valid), 0) / (valid - 1)) END AS std FROM u'


def raw_tiles(spark: SparkSession, d: str, tile_w: int = 64, tile_h: int = 7) -> Tiles:
    """The raster with its sentinels, in tiles that do not divide the grid."""
    return Tiles(so.cells_to_tiles(st.demand_cells(spark, d), tile_w, tile_h), tile_w, tile_h)


def region_spans(spark: SparkSession, d: str) -> DataFrame:
    return zn.row_spans(region_edges(spark, d), st.WIDTH, st.height(spark, d))


@query(EXACT_STATS)
def g1_exact_stats(spark: SparkSession, d: str) -> DataFrame:
    return zo.exact_zonal_stats(in_regions(spark, d).repartition(7))


@query(EXACT_STATS)
def g1_tile_stats(spark: SparkSession, d: str) -> DataFrame:
    return zo.zonal_stats_of_tiles(raw_tiles(spark, d), region_spans(spark, d), st.NODATA)


@query(f'{BY_REGION}, u AS ({UNITS.format("zone_id, parent_id")}) SELECT CAST(0 AS INTEGER) AS level, parent_id, zone_id, s AS "sum" FROM u UNION ALL SELECT 1, parent_id, NULL, sum(s) FROM u GROUP BY parent_id UNION ALL SELECT 2, NULL, NULL, sum(s) FROM u')
def g7_exact_rollup(spark: SparkSession, d: str) -> DataFrame:
    sums = zonal_sums_of_tiles(raw_tiles(spark, d), region_spans(spark, d), st.NODATA)
    parents = st.region_rings(spark, d).select("zone_id", "parent_id").distinct()
    return zo.exact_rollup(sums.join(parents, "zone_id"))


@query(f'{BY_REGION} SELECT zone_id, round(sum(value * 6371.0088 * 6371.0088 * radians(0.25) * (sin(radians(75 - "row" * CAST(0.125 AS DOUBLE))) - sin(radians(75 - ("row" + 1) * CAST(0.125 AS DOUBLE))))), 0) AS "sum", count(value) AS valid FROM assigned GROUP BY zone_id')
def c1_area_weighted_tiles(spark: SparkSession, d: str) -> DataFrame:
    found = zo.zonal_stats_of_tiles(raw_tiles(spark, d), region_spans(spark, d), st.NODATA, row_weight=gr.row_area(grid_of(spark, d)))
    return found.select("zone_id", F.round("sum", 0).alias("sum"), "valid")


@query(f"WITH {CELLS} SELECT * FROM cells")
def r2_read_tiles(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    raw_tiles(spark, d).frame.write.parquet(f"{path}/tiles")
    st.own_metadata(spark, d, st.NODATA).write.text(f"{path}/meta")
    return so.read_tiles(spark, f"{path}/tiles", 64, 7, so.read_product_metadata(spark, f"{path}/meta"))


@query(f'{BY_REGION} SELECT zone_id, "row", col, value FROM assigned')
def j2_assign_zones_by_row(spark: SparkSession, d: str) -> DataFrame:
    path = shared(spark)
    cells = zn.write_cells_by_row(masked(spark, d), f"cells_{uuid.uuid4().hex}", path, 8)
    return zn.assign_zones_by_row(cells, region_spans(spark, d))


#: Regions moved 20 half cells to the right, so that the last ones are cut off, and countries where they are.
SHIFTED = f"""{REGIONS.replace("corners AS", "moved AS").replace("60.0 * n_regionkey AS xl, 60.0 * n_regionkey + 60 AS xr", "60.0 * n_regionkey + 20 AS xl, 60.0 * n_regionkey + 80 AS xr")}, {COUNTRIES.replace("corners AS", "lands AS")}, corners AS (SELECT * FROM moved UNION ALL SELECT 'c' || zone_id, * EXCLUDE (zone_id) FROM lands)"""
BY_SHIFTED = f"WITH {CELLS}, {SHIFTED}, {EDGES}, {CAST_RAYS}"
DEPTH = 'depth AS (SELECT "row", col, count(*) AS zones FROM assigned GROUP BY "row", col)'


def shifted_rings(spark: SparkSession, d: str) -> DataFrame:
    moved = st.region_rings(spark, d).withColumn("ring", F.transform("ring", lambda p: F.struct((p["x"] + 20).alias("x"), p["y"].alias("y"))))
    return moved.unionByName(st.country_rings(spark, d).withColumn("zone_id", F.concat(F.lit("c"), F.col("zone_id"))))


def shifted_spans(spark: SparkSession, d: str) -> DataFrame:
    return zn.row_spans(so.ring_edges(shifted_rings(spark, d)), st.WIDTH, st.height(spark, d))


@query(f'{BY_SHIFTED}, {DEPTH}, flags AS (SELECT *, coalesce(col = lag(col) OVER w + 1 AND zones = lag(zones) OVER w, false) AS goes_on FROM depth WHERE zones > 1 WINDOW w AS (PARTITION BY "row" ORDER BY col)), runs AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY "row" ORDER BY col) AS run FROM flags) SELECT "row", CAST(min(col) AS INTEGER) AS c0, CAST(max(col) + 1 AS INTEGER) AS c1, any_value(zones) AS zones FROM runs GROUP BY "row", run')
def c4_overlap_runs(spark: SparkSession, d: str) -> DataFrame:
    return zn.overlap_runs(shifted_spans(spark, d))


@query(f'{BY_SHIFTED}, {DEPTH} SELECT zone_id, count(*) AS shared FROM assigned JOIN depth USING ("row", col) WHERE zones > 1 GROUP BY zone_id')
def c4_shared_cells(spark: SparkSession, d: str) -> DataFrame:
    spans = shifted_spans(spark, d)
    return zn.overlap_by_zone(spans, zn.overlap_runs(spans))


#: Area of what lies between a zone's upper and lower line, both held between the grid's borders, from column to column.
_HELD = "(greatest(least({0}, m), 0) * greatest(least({0}, m), 0) / 2 + greatest({0} - m, 0) * m)"
_UNDER = f"CASE WHEN abs({{1}} - {{0}}) < 1e-9 THEN greatest(least({{0}}, m), 0) ELSE ({_HELD.format('{1}')} - {_HELD.format('{0}')}) / ({{1}} - {{0}}) END * (x1 - x0)"
OUTSIDE = f"""shape AS (SELECT zone_id, CAST(2 * h AS DOUBLE) AS m, CAST(xl AS DOUBLE) AS x0, CAST(least(xr, 300) AS DOUBLE) AS x1, CAST(tl AS DOUBLE) AS t0, CAST(tl + (tr - tl) * (least(xr, 300) - xl) / (xr - xl) AS DOUBLE) AS t1, CAST(bl AS DOUBLE) AS b0, CAST(bl + (br - bl) * (least(xr, 300) - xl) / (xr - xl) AS DOUBLE) AS b1, CAST((xr - xl) * ((bl - tl) + (br - tr)) / 2 AS DOUBLE) AS whole FROM corners, size),
outside AS (SELECT zone_id, whole / 4 AS area, (({_UNDER.format("b0", "b1")}) - ({_UNDER.format("t0", "t1")})) / 4 AS inside FROM shape)"""


@query(f"WITH {CELLS}, {SHIFTED.replace('AS tl,', '+ 7 AS tl,').replace('END AS tr', 'END + 7 AS tr').replace('AS bl,', '+ 7 AS bl,').replace('END AS br', 'END + 7 AS br').replace('0.0 AS tr', '7.0 AS tr').replace('2.0 * h AS br', '2.0 * h + 7 AS br')}, {OUTSIDE} SELECT zone_id, round(area, 6) AS area, round(inside, 6) + 0.0 AS inside, round(1 - inside / area, 6) + 0.0 AS outside FROM outside")
def c5_outside_share(spark: SparkSession, d: str) -> DataFrame:
    lower = shifted_rings(spark, d).withColumn("ring", F.transform("ring", lambda p: F.struct(p["x"].alias("x"), (p["y"] + 7).alias("y"))))
    found = zn.outside_share(lower, st.WIDTH, st.height(spark, d))
    return found.select("zone_id", *[r(c).alias(c) for c in ("area", "inside", "outside")])


@query(f'WITH {CELLS}, b AS (SELECT CAST("row" // 7 AS INTEGER) AS "row", CAST(col // 7 AS INTEGER) AS col, CAST(sum(CAST(floor(value * 1048576 + 0.5) AS HUGEINT)) AS DOUBLE) / CAST(1048576 AS DOUBLE) AS value, count(value) AS valid FROM cells GROUP BY 1, 2) SELECT "row", col, value, value / valid AS mean, valid FROM b')
def g8_blocks_across_tiles(spark: SparkSession, d: str) -> DataFrame:
    return block_aggregate_any(raw_tiles(spark, d, 50, 10), 7, st.NODATA, st.WIDTH, st.height(spark, d))


#: Features from nations: an outline, a hole in every other, a second part in every third, and some that are no good.
GEO = "geo AS (SELECT n_nationkey AS k, CAST(n_nationkey AS VARCHAR) AS zone_id, CAST(n_regionkey AS VARCHAR) AS parent_id FROM nation WHERE n_nationkey % 7 != 3 AND n_nationkey % 11 != 5)"


@query(f"WITH {GEO} SELECT zone_id, parent_id, CAST(part AS INTEGER) AS part, hole, CAST(n AS INTEGER) AS points, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT *, 0 AS part, false AS hole, 4 AS n, 4 * k + 2 AS x, 10 AS y FROM geo UNION ALL SELECT *, 0, true, 3, 3 * k + 1, 6 FROM geo WHERE k % 2 = 0 UNION ALL SELECT *, 1, false, 3, 3 * k + 1, -20 FROM geo WHERE k % 3 = 0)")
def r4_geojson_rings(spark: SparkSession, d: str) -> DataFrame:
    rings, _ = so_geo.read_geojson(spark, st.nation_features(spark, d, shared(spark)), "iso", "adm0")
    total = lambda c: F.aggregate(F.transform("ring", lambda p: p[c]), F.lit(0.0), lambda a, v: a + v)
    return rings.select("zone_id", "parent_id", "part", "hole", F.size("ring").alias("points"), total("x").alias("x"), total("y").alias("y"))


@query("SELECT CASE WHEN n_nationkey % 7 = 3 THEN 'no polygon' ELSE 'bad ring' END AS fault, count(*) AS features FROM nation WHERE n_nationkey % 7 = 3 OR n_nationkey % 11 = 5 GROUP BY 1")
def r4_geojson_faults(spark: SparkSession, d: str) -> DataFrame:
    return so_geo.read_geojson(spark, st.nation_features(spark, d, shared(spark)), "iso", "adm0")[1]


def region_features(spark: SparkSession, d: str, path: str) -> str:
    """The first-level regions as a GeoJSON file."""
    return st.write_features(st.in_degrees(st.region_rings(spark, d), st.yres(spark, d)).select("zone_id", "parent_id", F.array("ring").alias("rings")), path)


CORRECTED = f"{BY_REGION}, truth AS (SELECT 'region' AS task, CAST(c_nationkey AS VARCHAR) AS zone_id, sum(c_acctbal) AS truth FROM customer GROUP BY ALL), totals AS (SELECT 'region' AS task, zone_id, sum(value) AS prediction FROM assigned WHERE parent_id = '2' GROUP BY zone_id), pairs AS (SELECT task, zone_id, prediction, truth FROM totals FULL JOIN (SELECT * FROM truth WHERE zone_id IN (SELECT CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 2) UNION ALL SELECT 'region', 'zz', 1.0) USING (task, zone_id))"


def old_codes(spark: SparkSession, d: str, path: str) -> tuple[str, DataFrame]:
    """Truth of regions as CSV, every other one under an old code, and one under a code that no region has; and the map
    of codes.
    """
    old = F.when(F.col("zone_id").cast("int") % 2 == 0, F.concat(F.lit("old-"), F.col("zone_id"))).otherwise(F.col("zone_id"))
    truth = st.region_truth(spark, d).select(old.alias("code"), F.col("truth").alias("amount"))
    truth.unionByName(spark.createDataFrame([("zz", 1.0)], "code string, amount double")).write.option("header", True).csv(path)
    return path, st.table(spark, d, "nation").select(F.concat(F.lit("old-"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_nationkey").cast("string").alias("corrected"))


@query(f"{CORRECTED}, {RANKED}, {WIDE}, {LONG} SELECT task, 'zones' AS subject, measure, round(CAST(value AS DOUBLE), 4) AS value FROM long")
def job_province_code_map(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, st.NODATA)
    truth, codes = old_codes(spark, d, f"{path}/truth")
    bounds = va.Boundaries({1: region_features(spark, d, f"{path}/regions.json")}, "geojson", "iso", "adm0")
    return _report(va.run_consistency(spark, own, bounds, truth, {"zone_id": "code", "truth": "amount"}, "region", f"{path}/report", parent_id="2", code_map=codes))


@query(f"{BY_COUNTRY}, truth AS (SELECT 'country' AS task, 'x' || CAST(n_regionkey AS VARCHAR) AS zone_id, sum(c_acctbal) AS truth FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) SELECT 'country' AS task, 'zones' AS subject, unnest(['n', 'bias', 'mae', 'rmse', 'relative_error', 'pearson', 'r2', 'slope', 'spearman', 'zones_without_truth', 'truth_without_zone']) AS measure, unnest([0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(DISTINCT zone_id) FROM assigned), (SELECT count(*) FROM truth)])::DOUBLE AS value")
def job_nothing_matches(spark: SparkSession, d: str) -> DataFrame:
    truth = st.country_truth(spark, d).withColumn("zone_id", F.concat(F.lit("x"), F.col("zone_id")))
    return _report(va.consistency(st.demand_cells(spark, d), country_edges(spark, d), truth, st.WIDTH, st.height(spark, d), "country", st.NODATA))


DETAILS = f"""{BY_SHIFTED}, {DEPTH}, {REGION_TRUTH}, {OUTSIDE}, totals AS (SELECT 'region' AS task, zone_id, sum(value) AS prediction FROM assigned GROUP BY zone_id), pairs AS (SELECT task, zone_id, prediction, truth FROM totals FULL JOIN truth USING (task, zone_id)), {RANKED}, {WIDE}, {LONG},
e AS (SELECT zone_id, abs(prediction - truth) / nullif(abs(truth), 0) AS e FROM pairs), worst AS (SELECT *, rank() OVER (ORDER BY e DESC) AS place FROM e WHERE e IS NOT NULL)
SELECT task, 'zones' AS subject, measure, round(CAST(value AS DOUBLE), 4) AS value FROM long UNION ALL SELECT 'region', zone_id, 'worst_relative_error', round(e, 4) FROM worst WHERE place <= 3
UNION ALL SELECT 'region', zone_id, 'share_outside', round(1 - inside / area, 4) FROM outside WHERE 1 - inside / area > 1e-9
UNION ALL SELECT 'region', zone_id, 'shared_cells', count(*) FROM assigned JOIN depth USING ("row", col) WHERE zones > 1 GROUP BY zone_id UNION ALL SELECT 'region', 'truth', 'unreadable_amounts', 0"""


@query(DETAILS)
def job_zone_details(spark: SparkSession, d: str) -> DataFrame:
    """Zones named by the report, from a product in tiles."""
    _, path = product(spark, d, st.NODATA)
    raw_tiles(spark, d).frame.write.parquet(f"{path}/tiles")
    own = va.Product(f"{path}/meta", tiles=f"{path}/tiles", tile_w=64, tile_h=7)
    st.in_degrees(shifted_rings(spark, d), st.yres(spark, d)).write.parquet(f"{path}/zones")
    st.region_truth(spark, d).select(F.col("zone_id").alias("code"), F.col("truth").alias("amount")).write.option("header", True).csv(f"{path}/truth")
    bounds = va.Boundaries({1: f"{path}/zones"})
    return _report(va.run_consistency(spark, own, bounds, f"{path}/truth", {"zone_id": "code", "truth": "amount"}, "region", f"{path}/report", worst=3, faults=True))


@query(f"{BY_REGION}, {COARSE.replace('// 2', '// 7').replace('/ 2', '/ 7')}, two AS (SELECT p, t FROM (SELECT zone_id, sum(value) AS p FROM assigned GROUP BY zone_id) FULL JOIN (SELECT zone_id, sum(value) AS t FROM hit GROUP BY zone_id) USING (zone_id) WHERE p IS NOT NULL AND t IS NOT NULL) SELECT 'grids' AS task, 'zones' AS subject, measure, value FROM ({MEASURED})")
def job_across_grids_tiles(spark: SparkSession, d: str) -> DataFrame:
    _, path = product(spark, d, st.NODATA)
    raw_tiles(spark, d, 50, 10).frame.write.parquet(f"{path}/tiles")
    st.in_degrees(st.region_rings(spark, d), st.yres(spark, d)).write.parquet(f"{path}/regions")
    own = va.Product(f"{path}/meta", tiles=f"{path}/tiles", tile_w=50, tile_h=10)
    return _report(va.run_across_grids(spark, own, f"{path}/regions", f"{path}/report", k=7))


#: A second product on a grid of half the resolution: NaN where the order is finished.
SECOND = """fine AS (SELECT "row" // 2 AS "row", col // 2 AS col, avg(value) AS p, count(value) AS v FROM cells GROUP BY 1, 2), second AS (SELECT o_orderkey // 150 // 2 AS "row", o_orderkey % 150 // 2 AS col, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 2 END AS t FROM orders WHERE o_orderkey // 150 % 2 = 0 AND o_orderkey % 150 % 2 = 0), both_ AS (SELECT p, t FROM fine FULL JOIN second USING ("row", col)), two AS (SELECT p, t FROM both_ WHERE p IS NOT NULL AND t IS NOT NULL)"""


@query(f"WITH {CELLS}, {SECOND} SELECT 'products' AS task, 'cells' AS subject, measure, value FROM ({MEASURED}) UNION ALL SELECT 'products', 'cells', unnest(['columns_per_cell', 'rows_per_cell', 'valid_a', 'valid_b']), unnest([2, 2, count(p), count(t)])::DOUBLE FROM both_")
def job_across_products(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, st.NODATA)
    st.second_metadata(spark, d).write.text(f"{path}/meta2")
    st.second_cells(spark, d).write.parquet(f"{path}/cells2")
    return _report(va.run_across_products(spark, own, va.Product(f"{path}/meta2", f"{path}/cells2"), f"{path}/report"))


@query(f"WITH {CELLS} SELECT 'product' AS task, subject, measure, value FROM (SELECT 'raster' AS subject, unnest(['width_ok', 'height_ok', 'as_declared', 'shape_as_declared', 'cells', 'valid', 'nodata', 'min', 'max', 'mean', 'duplicate_cells', 'missing_cells']) AS measure, round(CAST(unnest([1, 1, 0, CAST(count(*) = 150 * any_value(h) AS INTEGER), count(*), count(value), count(*) - count(value), min(value), max(value), avg(value), count(*) - count(DISTINCT (\"row\", col)), 150 * any_value(h) - count(DISTINCT (\"row\", col))]) AS DOUBLE), 4) AS value FROM cells, size) UNION ALL SELECT 'product', 'second', unnest(['same_crs', 'same_bounds', 'whole_ratio', 'ratio']), unnest([1.0, 1.0, 1.0, 2.0])::DOUBLE")
def job_product_alignment(spark: SparkSession, d: str) -> DataFrame:
    own, path = product(spark, d, None)
    st.second_metadata(spark, d).write.text(f"{path}/meta2")
    return _report(va.run_product_test(spark, own, f"{path}/report", arcsec=900.0, other=f"{path}/meta2"))
