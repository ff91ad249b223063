"""Row-level expressions on scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdwatch.config import CLASSIFICATION_THRESHOLD, HIGH_RISK_THRESHOLD, STATUS_RULES
from pdwatch.operators.checks import require_unit_interval


def predicted_class(probability: Column, threshold: float = CLASSIFICATION_THRESHOLD) -> Column:
    """1 at or above the threshold."""
    require_unit_interval(threshold, "threshold")
    return (probability >= threshold).cast("int")


def decision(probability: Column, threshold: float = CLASSIFICATION_THRESHOLD) -> Column:
    """Decline at or above the threshold."""
    require_unit_interval(threshold, "decision threshold")
    return F.when(probability >= threshold, "decline").otherwise("approve")


def high_risk(probability: Column, threshold: float = HIGH_RISK_THRESHOLD) -> Column:
    return probability >= threshold


def metric_status(metric: str, value: Column, rules=STATUS_RULES) -> Column:
    """NORMAL, WARNING or ALERT by the metric's two levels; null when there is no value."""
    side, warning, alert = next((s, w, a) for name, s, w, a in rules if name == metric)
    if side == "below":
        chain = F.when(value < alert, "ALERT").when(value < warning, "WARNING")
    else:
        chain = F.when(value >= alert, "ALERT").when(value >= warning, "WARNING")
    return F.when(value.isNotNull(), chain.otherwise("NORMAL"))


def null_for_nan(value: Column) -> Column:
    """Records carry null where a frame has NaN."""
    return F.when(~F.isnan(value), value)
