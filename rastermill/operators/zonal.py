"""Totals by zone, and zones beside their parents. `assigned` is what `assign_zones` gives."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import Fixed, exact_sums, measures
from .tiles import Tiles, zonal_sums_of_tiles


def zonal_stats(assigned: DataFrame, weight: Column | None = None) -> DataFrame:
    """Per zone: cells, valid, sum, mean, min, max, std (of the sample). With a weight, sum and mean are weighted, and std
    is the root of the weighted mean square distance from that mean.

    Partial sums leave one row a zone and task, so a large zone moves no more than a small one. Zones without a valid
    cell have null measures.
    """
    value = F.col("value")
    counts = [F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid")]
    ends = [F.min("value").alias("min"), F.max("value").alias("max")]
    if weight is None:
        return assigned.groupBy("zone_id").agg(*counts, F.sum(value).alias("sum"), F.avg(value).alias("mean"), *ends, F.stddev_samp(value).alias("std"))
    own = F.when(value.isNotNull(), weight.cast("double"))
    sums = assigned.groupBy("zone_id").agg(*counts, F.sum(value * own).alias("sum"), F.sum(own).alias("w"), F.sum(value * value * own).alias("squares"), *ends)
    mean = F.try_divide("sum", "w")
    return sums.select("zone_id", "cells", "valid", "sum", mean.alias("mean"), "min", "max", F.sqrt(F.greatest(F.try_divide("squares", "w") - mean * mean, F.lit(0.0))).alias("std"))


def exact_zonal_stats(assigned: DataFrame, fixed: Fixed | None = None) -> DataFrame:
    """The same measures from sums of whole numbers, so that they do not depend on the order of the rows."""
    fixed = fixed or Fixed()
    return measures(exact_sums(assigned, fixed, "zone_id"), fixed, "zone_id")


def zonal_stats_of_tiles(tiles: Tiles, spans: DataFrame, nodata: float | None = None, fixed: Fixed | None = None, row_weight: Callable[[np.ndarray], np.ndarray] | None = None, count: int | None = None) -> DataFrame:
    """The same measures straight from tiles: no pixel becomes a row. With `row_weight`, the weight of a cell by its row,
    sum and mean are weighted, and std is as in `zonal_stats`.
    """
    fixed = fixed or Fixed()
    sums = zonal_sums_of_tiles(tiles, spans, nodata, fixed, row_weight, count)
    if row_weight is None:
        return measures(sums, fixed, "zone_id")
    mean, some = F.try_divide("weighted", "weight"), F.col("valid") > 0
    std = F.sqrt(F.greatest(F.try_divide("weighted_squares", "weight") - mean * mean, F.lit(0.0)))
    return sums.select("zone_id", "cells", "valid", F.when(some, F.col("weighted")).alias("sum"), mean.alias("mean"), "min", "max", std.alias("std"))


def exact_rollup(region_sums: DataFrame, fixed: Fixed | None = None) -> DataFrame:
    """`rollup_totals` of (parent_id, zone_id, units) as exact sums: regions add up to countries and these to the world
    without a difference in the last bit.
    """
    fixed = fixed or Fixed()
    up = region_sums.rollup("parent_id", "zone_id").agg(F.sum("units").cast("decimal(38,0)").alias("units"), F.grouping_id().alias("g"))
    return up.select(F.when(F.col("g") == 3, 2).otherwise(F.col("g")).cast("int").alias("level"), "parent_id", "zone_id", (F.col("units").cast("double") / float(2**fixed.bits)).alias("sum"))


def zonal_coverage(assigned: DataFrame) -> DataFrame:
    """Per zone: cells, valid cells and their share."""
    return assigned.groupBy("zone_id").agg(F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"), (F.count("value") / F.count(F.lit(1))).alias("share"))


def with_parent(totals: DataFrame, zones: DataFrame) -> DataFrame:
    """Totals (zone_id, sum) with the zone's parent_id."""
    return totals.join(zones.select("zone_id", "parent_id").distinct(), "zone_id")


def rollup_totals(region_totals: DataFrame) -> DataFrame:
    """Region, country and world totals of (parent_id, zone_id, sum) in one pass; level 0 region, 1 country, 2 world."""
    up = region_totals.rollup("parent_id", "zone_id").agg(F.sum("sum").alias("sum"), F.grouping_id().alias("g"))
    return up.select(F.when(F.col("g") == 3, 2).otherwise(F.col("g")).cast("int").alias("level"), "parent_id", "zone_id", "sum")


def join_parent(region_totals: DataFrame, country_totals: DataFrame) -> DataFrame:
    """Each country's own total beside the sum of its regions; a side that is missing is null."""
    regions = region_totals.groupBy("parent_id").agg(F.sum("sum").alias("regions_sum"), F.count(F.lit(1)).alias("regions"))
    countries = country_totals.select(F.col("zone_id").alias("parent_id"), F.col("sum").alias("country_sum"))
    return countries.join(regions, "parent_id", "full_outer")


def share_of_parent(region_totals: DataFrame) -> DataFrame:
    """Adds a region's part of its country's total; null where that total is zero or null."""
    return region_totals.withColumn("share", F.try_divide("sum", F.sum("sum").over(W.partitionBy("parent_id"))))
