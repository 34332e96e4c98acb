"""Account reference from a spreadsheet's rows (OP-SRC-19, OP-AGG-16, OP-SET-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fas_code, no_year
from ..operators.accounts import collapsed, discontinued


def fund_type(raw: Column) -> Column:
    """OP-STR-18: one word for a fund type."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    has = lambda x: F.contains(low, F.lit(x))
    return F.when(has("general"), "general").when(has("revolving"), "revolving").when(has("trust"), "trust").when(has("special"), "special").when(has("deposit"), "deposit").otherwise(F.trim(low))


def reference(active: DataFrame, changes: DataFrame) -> DataFrame:
    """From rows (tas, title, last_updated, fund, ord) the accounts by code, and from (tas, title, action) of changes
    those that are no longer active."""
    rows = active.select(fas_code(F.col("tas")).alias("fas_code"), "title", "last_updated", no_year(F.col("tas")).alias("no_year"), (~no_year(F.col("tas"))).alias("annual"), "ord").where("fas_code is not null")
    now = collapsed(rows).withColumn("status", F.lit("active"))
    gone = discontinued(changes.select(fas_code(F.col("tas")).alias("fas_code"), "title", "action").where("fas_code is not null"), now).withColumn("status", F.lit("discontinued"))
    return now.unionByName(gone, allowMissingColumns=True).withColumn("agency_code", F.substring_index("fas_code", "-", 1)).withColumn("main_account", F.substring_index("fas_code", "-", -1))
