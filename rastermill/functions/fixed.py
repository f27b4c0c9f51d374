"""Sums that do not depend on their order: values as whole numbers of a power of two, added exactly."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scaled values must stay below this; a larger one is an error, never a wrong sum.
LIMIT = 2.0**62
#: Whole numbers are kept as upper and lower half where many are added in 64 bits.
HALF = 32


@dataclass(frozen=True)
class Fixed:
    """How fine values and their squares are kept: to 2 ** -bits, half rounded up."""

    bits: int = 20
    square_bits: int = 12

    def units(self, value: Column, bits: int) -> Column:
        scaled = value.cast("double") * float(2**bits)
        fits = F.when(F.abs(scaled) < LIMIT, scaled).otherwise(F.raise_error(F.concat(F.lit("value too large for fixed point: "), value.cast("string"))).cast("double"))
        return F.when(value.isNotNull(), F.floor(fits + 0.5)).cast("decimal(20,0)")

    def halves(self, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower halves of the same numbers. NaN, like what is too large, is an error."""
        scaled = values.astype(np.float64) * float(2**bits)
        if scaled.size and not max(scaled.max(), -scaled.min()) < LIMIT:
            raise ValueError("value too large for fixed point")
        scaled += 0.5
        whole = np.floor(scaled, out=scaled).astype(np.int64)
        return whole >> HALF, whole & ((1 << HALF) - 1)


def joined(upper: Column, lower: Column) -> Column:
    """Exact number from sums of halves, as a decimal."""
    return (upper.cast("decimal(20,0)") * F.lit(2**HALF).cast("decimal(11,0)") + lower.cast("decimal(20,0)")).cast("decimal(38,0)")


def exact_sums(assigned: DataFrame, fixed: Fixed, *keys: str) -> DataFrame:
    """Per group: cells, valid, units and squares (whole numbers), min, max. Groups may be summed again, exactly."""
    value = F.col("value")
    return assigned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"), F.count("value").alias("valid"),
        F.coalesce(F.sum(fixed.units(value, fixed.bits)), F.lit(0)).cast("decimal(38,0)").alias("units"), F.coalesce(F.sum(fixed.units(value * value, fixed.square_bits)), F.lit(0)).cast("decimal(38,0)").alias("squares"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )


def merged(sums: DataFrame, *keys: str) -> DataFrame:
    """Sums of groups added up to those of larger groups, as exactly."""
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("cells", "valid")], *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("units", "squares")], F.min("min").alias("min"), F.max("max").alias("max"))


def measures(sums: DataFrame, fixed: Fixed, *keys: str) -> DataFrame:
    """The keys, cells, valid, sum, mean, min, max, std (of the sample): functions of exact sums, so equal to the last bit
    however the rows were dealt. A group without a valid cell has null measures.
    """
    n = F.col("valid").cast("double")
    some = F.when(F.col("valid") > 0, F.col("units").cast("double") / float(2**fixed.bits))
    mean = F.try_divide(some, n)
    spread = F.col("squares").cast("double") / float(2**fixed.square_bits) - some * mean
    std = F.when(F.col("valid") > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0))))
    return sums.select(*keys, "cells", "valid", some.alias("sum"), mean.alias("mean"), "min", "max", std.alias("std"))
