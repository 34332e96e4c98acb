"""Fiscal-year price levels (OP-AGG-15, OP-MATH-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_MONTHS = 3


def fiscal_year_cpi(monthly: DataFrame, annual: DataFrame | None = None) -> DataFrame:
    """From (ym, value): (fy, cpi, months), the mean of a fiscal year's months; with fewer than three the annual average.

    A year of October to December belongs to the next fiscal year; holes are skipped, not filled (T-30).
    """
    year, month = F.split("ym", "-").getItem(0).cast("int"), F.split("ym", "-").getItem(1).cast("int")
    by = monthly.select((year + F.when(month >= 10, 1).otherwise(0)).alias("fy"), "value").groupBy("fy").agg(F.avg("value").alias("cpi"), F.count("*").cast("int").alias("months"))
    full = by.where(F.col("months") >= LEAST_MONTHS)
    if annual is None:
        return full
    other = annual.join(full, "fy", "left_anti").select("fy", F.col("value").alias("cpi"), F.col("months").cast("int").alias("months"))
    return full.unionByName(other)


def context(levels: DataFrame, base_fy: int, current_fy: int) -> DataFrame:
    """One row with both levels and the rate between them; none if a year lacks one."""
    side = lambda fy, n: levels.where(F.col("fy") == fy).select(F.lit(1).alias("k"), F.col("cpi").alias(f"{n}_cpi"), F.col("months").alias(f"{n}_months"))
    both = side(base_fy, "base").join(side(current_fy, "current"), "k").drop("k")
    return both.withColumn("rate", F.col("current_cpi") / F.col("base_cpi") - 1)
