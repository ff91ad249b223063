"""The production summary job: the latest features and predictions to one stored row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from pdwatch.operators.summary import production_summary
from pdwatch.plans.performance import with_metadata
from pdwatch.schemas import PROBABILITY, SUMMARY_FEATURES
from pdwatch.sources.tables import read_latest, store_report


def run_summary(
    spark: SparkSession,
    features_path: str,
    predictions_path: str,
    path: str,
    run_date: str,
    model_version: str,
    probability: str = PROBABILITY,
    names: Sequence[str] = SUMMARY_FEATURES,
) -> DataFrame:
    """Read the latest date of both tables, sum them up in one aggregate, store the row by run date and return it."""
    summary = production_summary(
        read_latest(spark, predictions_path), probability, names, features=read_latest(spark, features_path)
    )
    return store_report(with_metadata(summary, run_date=run_date, model_version=model_version), path, run_date)
