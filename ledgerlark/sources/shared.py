"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder in local mode; elsewhere an error, as executors
    wouldn't find each other's files."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="ledgerlark-"))
    return _OWN[0]


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows that are read more than once, as Parquet in that folder; their order is not kept."""
    root = f"{folder(rows.sparkSession)}/ledgerlark-kept/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(root)
    return rows.sparkSession.read.schema(rows.schema).parquet(root)
