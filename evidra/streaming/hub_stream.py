"""Streams of repository events: windows with watermarks, sessions, newest event per key.

The functions take streaming or batch DataFrames of (ts, key, event_type,
value); time is the event's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "72 hours"


def read_events(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files of events that appear in a folder; times without a zone are the session's."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_counts(events: DataFrame, width: str = "48 hours", late: str = LATE) -> DataFrame:
    """Events and their values per window and type; events later than ``late`` are left out of closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("events"), F.sum("value").alias("value"))


def sliding_counts(events: DataFrame, width: str = "48 hours", slide: str = "24 hours", late: str = LATE) -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("events"))


def sessions(events: DataFrame, key: str, gap: str = "6 hours", late: str = LATE) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("events"))


def newest_per_key(events: DataFrame, key: str, late: str = LATE, keep_hours: int = 72) -> DataFrame:
    """Every time a key's newest event changes, that event.

    State is one row per key; it goes when the watermark has passed the
    key's last event by ``keep_hours``.
    """
    kind = events.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, ts timestamp, event_type string"

    def newest(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = [part.sort_values("ts").iloc[-1] for part in parts if len(part)]
        if not rows:
            return
        top = max(rows, key=lambda r: r["ts"])
        micros = int(pd.Timestamp(top["ts"]).value // 1000)
        if not state.exists or micros >= state.get[0]:
            state.update((micros, str(top["event_type"])))
            yield pd.DataFrame({key: [keys[0]], "ts": [top["ts"]], "event_type": [top["event_type"]]})
        until = state.get[0] // 1000 + keep_hours * 3_600_000
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))

    grouped = events.withWatermark("ts", late).select(key, "ts", "event_type").groupBy(key)
    return grouped.applyInPandasWithState(newest, schema, "micros long, event_type string", "append", GroupStateTimeout.EventTimeTimeout)
