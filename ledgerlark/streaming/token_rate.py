"""Token rates over a stream of usage events (the streaming form of OP-WIN-07)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType, TimestampType


def windowed_rate(events: DataFrame, *, key: str = "user_id", at: str = "ts", value: str = "value", seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """From a streaming or static DataFrame: per key and window of ``seconds`` the rise of ``value`` a second, rounded down.

    Windows slide by a second; events later than ``late`` are dropped by the watermark; windows with one event or less
    than a second between the first and the last have a null rate.
    """
    rows = events.select(key, F.col(at).cast("timestamp").alias(at), value).withWatermark(at, late)
    first, last = F.min(F.struct(at, value)), F.max(F.struct(at, value))
    agg = rows.groupBy(F.window(at, f"{seconds} seconds", "1 second"), key).agg(first.alias("a"), last.alias("b"), F.count("*").alias("n"))
    span = (F.unix_micros(f"b.{at}") - F.unix_micros(f"a.{at}")) / 1e6
    rise = F.greatest(F.col(f"b.{value}") - F.col(f"a.{value}"), F.lit(0.0))
    return agg.select(key, F.col("window.start").alias("window_start"), F.when((F.col("n") > 1) & (span >= 1), F.floor(rise / span)).alias("rate"))


class _Rates(StatefulProcessor):
    """Per key the events of the last ``micros`` before the watermark and all after it, with one timer at the earliest that
    has no rate yet. An event gets its rate when the watermark has passed it, so nothing can come between any more."""

    def __init__(self, key: str, at: str, value: str, micros: int) -> None:
        self.names, self.micros = [key, at, value, "rate"], micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "t long, value double, done boolean")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 (Spark's names)
        kept = list(self.events.get())
        for r in rows:
            values = r[self.names[2]].astype("float64")
            kept += [(t, None if math.isnan(v) else v, False) for t, v in zip(r["t"].tolist(), values.tolist(), strict=True)]
        self._keep(kept)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.events.get(), key=lambda e: (e[0], e[1] is not None, e[1]))
        t = np.array([e[0] for e in rows], dtype=np.int64)
        v = np.array([math.nan if e[1] is None else e[1] for e in rows])
        now = np.flatnonzero((t < passed) & ~np.array([e[2] for e in rows], dtype=bool))
        a, b = np.searchsorted(t, t[now] - self.micros), np.searchsorted(t, t[now], "right") - 1
        rise, span = np.nan_to_num(np.maximum(v[b] - v[a], 0.0)), t[now] - t[a]
        rates = [int(r // (s / 1e6)) if m > 0 and s >= 1_000_000 else None for r, s, m in zip(rise.tolist(), span.tolist(), (b - a).tolist(), strict=True)]
        self._keep([(e[0], e[1], e[2] or e[0] < passed) for e in rows if e[0] >= passed - self.micros])
        if len(now):
            columns = [pd.Series([key[0]] * len(now)), pd.to_datetime(t[now], unit="us"), [rows[i][1] for i in now], pd.array(rates, dtype="Int64")]
            yield pd.DataFrame(dict(zip(self.names, columns, strict=True)))

    def _keep(self, events: list[tuple]) -> None:
        if events:
            self.events.put(events)
        else:
            self.events.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = [e[0] for e in events if not e[2]]
        if waiting:
            self.handle.registerTimer(min(waiting) // 1000 + 1)


def event_rate(events: DataFrame, *, key: str = "user_id", at: str = "ts", value: str = "value", seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """Of a stream: key, at, value and rate of each event, as ``reports.token_rate`` gives them for a table.

    A row comes once the watermark (``late`` behind the latest event) has passed it; later events are dropped. State holds a
    key's events of ``seconds`` and of what is not passed. Events without a time are left out; a value that is NaN counts
    as null. Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    rows = events.where(F.col(at).isNotNull()).select(key, F.col(at).cast("timestamp").alias(at), F.col(value).cast("double").alias(value))
    rows = rows.withColumn("t", F.unix_micros(at)).withWatermark(at, late)
    out = StructType([rows.schema[key], StructField(at, TimestampType()), StructField(value, DoubleType()), StructField("rate", LongType())])
    return rows.groupBy(key).transformWithStateInPandas(_Rates(key, at, value, seconds * 1_000_000), out, "Append", "EventTime")
