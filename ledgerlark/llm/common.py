"""Shared helpers: storage in the cluster's shared folder, Arrow batches, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import folder

_WRITTEN: list[str] = []


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` for what runs inside, whole texts being large; then the session's own setting again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    if before is None or not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def stored(df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, which cuts its lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/ledgerlark/{name}-{uuid.uuid4().hex}"
    with small_batches(spark, rows):
        df.write.parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_stored(df: DataFrame) -> None:
    """Delete what ``stored`` wrote, once nothing reads it any more."""
    if path := getattr(df, "stored_path", None):
        _delete(df.sparkSession, path)
        _WRITTEN.remove(path)


def clear_stored(spark: SparkSession) -> int:
    """Delete all that this process has stored; results that were not written elsewhere can no longer be read."""
    count = len(_WRITTEN)
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())
    return count


BATCH_ROWS = 1000
#: Ids that may be broadcast: 8 bytes each, so a few megabytes.
BROADCAST_IDS = 200_000


def without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key isn't in ``keys`` (one column); few keys are broadcast, more are joined by shuffle."""
    gone = stored(keys.toDF("__gone"), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, key == F.col("__gone"), "left_anti")


def row_key(doc_id: str, text: str) -> Column:
    """A row's key, which is never null: a 64-bit hash of its id and text, the same for identical rows only."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("string"))


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, none of them empty."""
    for whole in batches:
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | list | None], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with one output (or None, or a list of them) per at most ``BATCH_ROWS`` input rows.

    Spark itself ends a batch at ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, BATCH_ROWS):
            out = fn(b)
            yield from out if isinstance(out, list) else [out] if out is not None else []

    return df.mapInArrow(run, schema)


def utf8(col: pa.Array) -> list[bytes | None]:
    """A string column's values as UTF-8 bytes, without decoding."""
    return col.cast(pa.binary()).to_pylist()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: A-Z to a-z for UTF-8 bytes; bytes.lower() does just that and bytes.split() splits at \x09-\x0D and \x20 only.
def space_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased."""
    return text.lower().split() if text else []
