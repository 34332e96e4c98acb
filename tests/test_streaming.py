"""Streams give what the batch operators give of the same rows."""

import datetime as dt
import random

import pytest

from ledgerlark.operators import reports
from ledgerlark.streaming.token_rate import event_rate

SCHEMA = "user_id long, ts timestamp, value double"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(STORE)


def _streamed(spark, tmp_path, batches, **how):
    """The rates of batches that arrive one after another."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        event_rate(events, **how).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{SCHEMA}, rate long").parquet(str(tmp_path / "out"))


def test_event_rate(spark, tmp_path, rocks):
    """Out of order, with ties, nulls and a null key: equal to the batch operator up to the watermark, each event once."""
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    batches = [[(rng.choice([1, 2, None]), start + dt.timedelta(seconds=30 * b + rng.randint(0, 40)), rng.choice([None, float(rng.randint(0, 500))])) for _ in range(60)] for b in range(2)]
    last = start + dt.timedelta(hours=1)
    batches.append([(9, last, 1.0)])
    got = sorted(map(tuple, _streamed(spark, tmp_path, batches, seconds=10, late="1 minute").collect()), key=repr)
    table = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    want = sorted(map(tuple, reports.token_rate(table, seconds=10).where(f"ts < timestamp'{last}'").collect()), key=repr)
    assert got == want and len(got) == 120 and any(r[3] for r in got)


def test_event_rate_late_and_empty(spark, tmp_path, rocks):
    """What comes behind the watermark is dropped; events without a time are left out; an empty batch gives nothing."""
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[(1, at(0), 10.0), (1, at(5), 60.0), (1, None, 1.0)], [(2, at(600), 0.0)], [], [(1, at(6), 99.0), (2, at(2000), 0.0)]]
    got = sorted((r.user_id, r.ts, r.rate) for r in _streamed(spark, tmp_path, batches, seconds=10, late="1 minute").collect())
    assert got == [(1, at(0), None), (1, at(5), 10), (2, at(600), None)]
