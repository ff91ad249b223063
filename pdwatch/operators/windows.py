"""Metric events, their time series, and alarms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.config import ALARMS, DASHBOARD_SERIES, HIGH_RISK_THRESHOLD
from pdwatch.functions.expressions import high_risk
from pdwatch.operators.checks import require_columns


def _event(name: str, value: Column, unit: str = "Count", when: Column | None = None) -> Column:
    event = F.struct(F.lit(name).alias("metric_name"), value.cast("double").alias("value"), F.lit(unit).alias("unit"))
    return event if when is None else F.when(when, event)


def prediction_events(
    scored: DataFrame, probability: str, timestamp: str = "ts", threshold: float = HIGH_RISK_THRESHOLD
) -> DataFrame:
    """(ts, metric_name, value, unit) of every scored row."""
    require_columns(scored, [probability, timestamp])
    one, p = F.lit(1.0), F.col(probability)
    events = F.array(
        _event("PredictionCount", one),
        _event("DefaultProbability", p, "None"),
        _event("HighRiskPredictionCount", one, when=high_risk(p, threshold)),
    )
    return scored.select(F.col(timestamp).alias("ts"), F.inline(F.array_compact(events)))


def explanation_events(records: DataFrame) -> DataFrame:
    """One count per explanation, and one per explanation that needs a compliance review."""
    one = F.lit(1.0)
    events = F.array(
        _event("ExplanationCount", one),
        _event("ExplanationComplianceReviewCount", one, when=F.col("compliance_review_required")),
    )
    return records.select(F.col("prediction_timestamp").alias("ts"), F.inline(F.array_compact(events)))


def error_events(events: DataFrame, metric: str = "PredictionErrorCount") -> DataFrame:
    """Failed requests from an event log of (ts, event_type)."""
    require_columns(events, ["ts", "event_type"])
    return events.where(F.col("event_type") == "error").select(
        F.col("ts").cast("timestamp").alias("ts"), F.inline(F.array(_event(metric, F.lit(1.0))))
    )


def window_start(timestamp: Column, period: Column) -> Column:
    """Start of the tumbling window of `period` seconds, counted from the epoch."""
    return F.timestamp_seconds(F.floor(F.unix_micros(timestamp) / (period * 1_000_000)) * period)


def metric_series(events: DataFrame, series: Sequence[tuple[str, int, str]] = DASHBOARD_SERIES) -> DataFrame:
    """All series from one pass: (metric_name, period_seconds, statistic, window_start, metric_value).

    A series names a metric or its family, the part before the first underscore. The list of series
    is a short literal inside each row, so nothing is joined, and events are combined per window on
    the map side; a busy window costs one row per task.
    """
    family = F.split_part("metric_name", F.lit("_"), F.lit(1))
    specs = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("metric_name") == metric) | (family == metric),
                    F.struct(F.lit(period).cast("long").alias("period_seconds"), F.lit(stat).alias("statistic")),
                )
                for metric, period, stat in series
            ]
        )
    )
    placed = events.select("ts", "metric_name", "value", F.inline(specs))
    return (
        placed.withColumn("window_start", window_start(F.col("ts"), F.col("period_seconds")))
        .groupBy("metric_name", "period_seconds", "statistic", "window_start")
        .agg(F.sum("value").alias("total"), F.avg("value").alias("mean"))
        .select(
            "metric_name",
            "period_seconds",
            "statistic",
            "window_start",
            F.when(F.col("statistic") == "Sum", F.col("total")).otherwise(F.col("mean")).alias("metric_value"),
        )
    )


def alarm_states(events: DataFrame, alarms: Sequence[tuple[str, str, int, str, float]] = ALARMS) -> DataFrame:
    """Every window an alarm saw events in, and whether it was breached."""
    series = metric_series(events, list(dict.fromkeys((m, p, s) for _, m, p, s, _ in alarms)))
    watched = F.array_compact(
        F.array(
            *[
                F.when(
                    (F.col("metric_name") == metric) & (F.col("period_seconds") == period) & (F.col("statistic") == stat),
                    F.struct(F.lit(name).alias("alarm"), F.lit(float(limit)).alias("threshold")),
                )
                for name, metric, period, stat, limit in alarms
            ]
        )
    )
    return series.select("*", F.inline(watched)).select(
        "alarm",
        "metric_name",
        "period_seconds",
        "window_start",
        "metric_value",
        "threshold",
        (F.col("metric_value") >= F.col("threshold")).alias("breached"),
    )
