"""Agreement of predictions with truth, by task. Pairs with a null side do not count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _whole(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("prediction").isNotNull() & F.col("truth").isNotNull())


def agreement(pairs: DataFrame) -> DataFrame:
    """Per task: n, bias, mae, rmse, relative_error, pearson, r2, slope.

    relative_error is |sum of predictions - sum of truth| over |sum of truth|. A measure that would divide by zero,
    as on constant truth, is null.
    """
    error = F.col("prediction") - F.col("truth")
    sums = _whole(pairs).groupBy("task").agg(
        F.count(F.lit(1)).alias("n"), F.avg(error).alias("bias"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"),
        F.try_divide(F.abs(F.sum(error)), F.abs(F.sum("truth"))).alias("relative_error"),
        F.regr_sxy("prediction", "truth").alias("sxy"), F.regr_sxx("prediction", "truth").alias("sxx"), F.regr_syy("prediction", "truth").alias("syy"),
    )
    pearson = F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy")))
    return sums.select("task", "n", "bias", "mae", "rmse", "relative_error", pearson.alias("pearson"), (pearson * pearson).alias("r2"), F.try_divide("sxy", "sxx").alias("slope"))


def rank_agreement(pairs: DataFrame) -> DataFrame:
    """Per task: n and Spearman's coefficient, with mean ranks on ties."""
    def mean_rank(c: str):
        return F.rank().over(W.partitionBy("task").orderBy(c)) + (F.count(F.lit(1)).over(W.partitionBy("task", c)) - 1) / 2

    ranks = _whole(pairs).select("task", mean_rank("prediction").alias("p"), mean_rank("truth").alias("t"))
    sums = ranks.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.regr_sxy("p", "t").alias("sxy"), F.regr_sxx("p", "t").alias("sxx"), F.regr_syy("p", "t").alias("syy"))
    return sums.select("task", "n", F.try_divide("sxy", F.sqrt(F.col("sxx") * F.col("syy"))).alias("spearman"))


def worst_zones(pairs: DataFrame, k: int) -> DataFrame:
    """The k zones of each task with the largest relative error, ties included; zones with zero truth do not rank."""
    scored = _whole(pairs).withColumn("relative_error", F.try_divide(F.abs(F.col("prediction") - F.col("truth")), F.abs(F.col("truth")))).filter(F.col("relative_error").isNotNull())
    return scored.withColumn("place", F.rank().over(W.partitionBy("task").orderBy(F.desc("relative_error")))).filter(F.col("place") <= k)


def as_report(measures: DataFrame, subject: str, names: list[str]) -> DataFrame:
    """A wide table by task as report rows (task, subject, measure, value)."""
    return measures.unpivot(["task"], [F.col(n).cast("double").alias(n) for n in names], "measure", "value").select("task", F.lit(subject).alias("subject"), "measure", "value")
