"""Predictions wait on a stream for the labels that mature later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.operators.checks import require_columns
from pdwatch.schemas import ACTUAL, ID, PROBABILITY


def matured_stream(
    predictions: DataFrame,
    outcomes: DataFrame,
    maturity: str,
    delay: str,
    predicted_at: str = "predicted_at",
    labelled_at: str = "labelled_at",
    id_column: str = ID,
    actual: str = ACTUAL,
    probability: str = PROBABILITY,
) -> DataFrame:
    """Each prediction with its label, as soon as both have arrived.

    A label counts if it is dated from its prediction on and at most `maturity` after it; one that is dated later is
    dropped, whenever it arrives. `delay` says how much later than the newest row a row may arrive; beyond it, rows are
    dropped too. Both bounds together tell how long a prediction has to be kept: the state does not grow with the stream.
    """
    require_columns(predictions, [id_column, probability, predicted_at])
    require_columns(outcomes, [id_column, actual, labelled_at])
    scored = predictions.select(
        F.col(id_column).cast("string").alias(id_column), F.col(predicted_at).cast("timestamp").alias(predicted_at), probability
    ).withWatermark(predicted_at, delay)
    labels = outcomes.select(
        F.col(id_column).cast("string").alias("__id"), F.col(labelled_at).cast("timestamp").alias(labelled_at), actual
    ).withWatermark(labelled_at, delay)
    in_time = F.col(labelled_at).between(F.col(predicted_at), F.col(predicted_at) + F.expr(f"INTERVAL {maturity}"))
    return scored.join(labels, (F.col(id_column) == F.col("__id")) & in_time, "inner").select(
        id_column, predicted_at, labelled_at, probability, actual
    )
