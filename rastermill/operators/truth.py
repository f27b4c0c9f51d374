"""Truth tables: codes, keys, and totals beside them. Tasks keep their own truth, so the task is part of every key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_truth(*tables: DataFrame) -> DataFrame:
    """Truth of separate tasks as one table (task, zone_id, truth)."""
    return reduce(DataFrame.unionByName, [t.select("task", "zone_id", "truth") for t in tables])


def correct_codes(truth: DataFrame, code_map: DataFrame) -> DataFrame:
    """Zone codes replaced where `code_map` (code, corrected) has one. A code listed twice takes the least correction,
    so that no row of truth doubles.
    """
    once = code_map.groupBy(F.col("code").alias("zone_id")).agg(F.min("corrected").alias("corrected"))
    return truth.join(once, "zone_id", "left").select("task", F.coalesce("corrected", "zone_id").alias("zone_id"), "truth")


def join_truth(zone_totals: DataFrame, truth: DataFrame) -> DataFrame:
    """(task, zone_id, prediction, truth); a side that is missing is null."""
    return zone_totals.select("task", "zone_id", F.col("sum").alias("prediction")).join(truth.select("task", "zone_id", "truth"), ["task", "zone_id"], "full_outer")


def unmatched_zones(zone_totals: DataFrame, truth: DataFrame) -> DataFrame:
    """(task, zone_id, missing): zones without truth, and truth without a zone."""
    key = ["task", "zone_id"]
    no_truth = zone_totals.select(*key).join(truth.select(*key), key, "left_anti").withColumn("missing", F.lit("truth"))
    no_zone = truth.select(*key).join(zone_totals.select(*key), key, "left_anti").withColumn("missing", F.lit("zone"))
    return no_truth.unionByName(no_zone)
