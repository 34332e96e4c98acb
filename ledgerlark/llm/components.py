"""Connected components of an edge table by alternating large-star and small-star steps.

Each step keeps the edges in the shared folder and joins them with one minimum per node, so a node of any degree is
handled by map-side aggregation and a join that Spark can split; nothing is gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node either points to one smaller node that points nowhere, or is only pointed to."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("to")).unionAll(edges.select(F.col("v").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("to")))
    return ends.groupBy("id").agg(F.sum("out").alias("out"), F.max("to").alias("to")).where("out > 1 or (out > 0 and to > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): (id, comp) for every id in them, comp being the smallest id of its component."""
    at = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _is_stars(at):
        both = at.unionAll(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lowest.select("u", F.col("m").alias("v")))
        new = stored(small.distinct(), "edges")
        drop_stored(at)
        at = new
    return at.select(F.col("u").alias("id"), F.col("v").alias("comp")).unionAll(at.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())
