"""Incremental ingest: new bill files become provisions as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.model import provisions


def stream_provisions(spark: SparkSession, root: str, files_per_trigger: int = 100) -> DataFrame:
    """A streaming provisions view of ``extraction.json`` files below ``root``; files that don't parse are left out."""
    raw = spark.readStream.schema(f"{schemas.EXTRACTION}, _corrupt string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "extraction.json").option("columnNameOfCorruptRecord", "_corrupt").option("maxFilesPerTrigger", files_per_trigger).json(root)
    rows = raw.where("_corrupt is null and bill is not null").select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("bill_dir"), "bill.*", "provisions")
    return provisions(rows.withColumn("congress", F.split("bill_dir", "-").getItem(0).try_cast("int")))
