"""Metric windows and alarms over an event stream.

The watermark bounds the state: a window is emitted once no event for it can arrive any more, and
events later than the allowed delay are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_stream(events: DataFrame, period_seconds: int, delay: str) -> DataFrame:
    """(window_start, window_end, metric_name, event_count, metric_sum, metric_average)."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{period_seconds} seconds"), "metric_name")
        .agg(
            F.count(F.lit(1)).alias("event_count"),
            F.sum("value").alias("metric_sum"),
            F.avg("value").alias("metric_average"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "metric_name",
            "event_count",
            "metric_sum",
            "metric_average",
        )
    )


def alarm_stream(windows: DataFrame, alarm: str, metric: str, statistic: str, threshold: float) -> DataFrame:
    """Closed windows of one metric, with whether the alarm was breached."""
    value = F.col("metric_sum") if statistic == "Sum" else F.col("metric_average")
    return windows.where(F.col("metric_name") == metric).select(
        F.lit(alarm).alias("alarm"),
        "window_start",
        value.alias("metric_value"),
        F.lit(float(threshold)).alias("threshold"),
        (value >= threshold).alias("breached"),
    )


def alarm_transitions(states: DataFrame, period_seconds: int) -> DataFrame:
    """One row for each change of an alarm between OK and ALARM: (alarm, changed_at, state).

    `states` is a stream over the table that `alarm_stream` is written to: closed windows in the order in which they closed.
    Alarms begin OK. A window without events is not breached: an alarm that was raised in the window before it is OK from its
    start on, which is known as soon as any later window of the alarm has closed. Kept for each alarm are its state and the
    start of the window that comes next.
    """
    period = pd.Timedelta(seconds=period_seconds)

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        raised, expected = state.get if state.exists else (False, 0)
        expected = pd.Timestamp(expected, unit="us")
        changes = []
        seen = pd.concat(list(frames)).sort_values("window_start")
        for start, breached in zip(seen["window_start"], seen["breached"], strict=True):
            if raised and start > expected:
                changes.append((expected, "OK"))
                raised = False
            if bool(breached) != raised:
                raised = not raised
                changes.append((start, "ALARM" if raised else "OK"))
            expected = start + period
        state.update((raised, int(expected.value // 1000)))
        yield pd.DataFrame(
            {"alarm": key[0], "changed_at": pd.Series([at for at, _ in changes], dtype="datetime64[us]"), "state": [s for _, s in changes]}
        )

    return (
        states.select("alarm", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "breached")
        .groupBy("alarm")
        .applyInPandasWithState(
            follow,
            "alarm string, changed_at timestamp_ntz, state string",
            "raised boolean, expected bigint",
            "append",
            GroupStateTimeout.NoTimeout,
        )
    )


def write_windows(windows: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append closed windows to a Parquet table."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def publish_batches(stream: DataFrame, publish, checkpoint: str, **trigger) -> StreamingQuery:
    """Hand every micro-batch to `publish(batch, batch_id)`, e.g. to append it to a metrics table."""
    return (
        stream.writeStream.foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
