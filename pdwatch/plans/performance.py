"""The performance monitoring job: predictions and matured outcomes to a one-row report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.config import CLASSIFICATION_THRESHOLD, MINIMUM_SAMPLES, STATUS_RULES
from pdwatch.functions.expressions import metric_status
from pdwatch.operators.calibration import calibration_errors, calibration_table
from pdwatch.operators.joins import match_outcomes
from pdwatch.operators.metrics import performance_report
from pdwatch.operators.quality import check_scored_labels, enforce, enforce_size
from pdwatch.schemas import ACTUAL, ID, PROBABILITY
from pdwatch.session import settle
from pdwatch.sources.tables import store_report, write_csv


def with_metadata(report: DataFrame, **values: object) -> DataFrame:
    """Run metadata as constant columns."""
    return report.withColumns({n: v if isinstance(v, Column) else F.lit(v) for n, v in values.items()})


def report_with_metadata(
    report: DataFrame, run_date: str, prediction_dataset: str, outcome_dataset: str, model_version: str
) -> DataFrame:
    return with_metadata(
        report,
        run_date=run_date,
        prediction_dataset=prediction_dataset,
        outcome_dataset=outcome_dataset,
        matched_sample_size=F.col("record_count"),
        model_version=model_version,
        monitoring_type="model_performance",
    )


def run_performance(
    predictions: DataFrame,
    outcomes: DataFrame,
    run_date: str,
    prediction_dataset: str,
    outcome_dataset: str,
    model_version: str,
    threshold: float = CLASSIFICATION_THRESHOLD,
    minimum: int = MINIMUM_SAMPLES,
    path: str | None = None,
) -> DataFrame:
    """Join and validate in one pass, gate, report.

    With `path` the report is stored by run date, and the stored row is returned.
    """
    match = match_outcomes(predictions.select(ID, PROBABILITY), outcomes).enforce()
    enforce_size(match.size, minimum)
    match.enforce(both_classes=True)
    report = performance_report(match.rows, threshold)
    described = report_with_metadata(report, run_date, prediction_dataset, outcome_dataset, model_version)
    return store_report(described, path, run_date) if path else described


def status_rows(report: DataFrame) -> DataFrame:
    """Status of each metric that has alarm levels."""
    entries = [
        F.struct(
            F.lit(name).alias("metric"),
            F.col(name).alias("value"),
            F.lit(warning).alias("warning_level"),
            F.lit(alert).alias("alert_level"),
            metric_status(name, F.col(name)).alias("status"),
        )
        for name, _, warning, alert in STATUS_RULES
    ]
    return report.select(F.inline(F.array(*entries)))


def monitoring_tables(
    scored: DataFrame,
    folder: str | None = None,
    threshold: float = CLASSIFICATION_THRESHOLD,
    bands: int = 10,
    actual: str = ACTUAL,
    probability: str = PROBABILITY,
    tie_break: str = ID,
) -> Mapping[str, DataFrame]:
    """Performance report, calibration table and calibration errors of one table of labelled scores.

    The scores are written once, checked, and read by both branches; the two small results are written once
    as well, since several outputs are made from them. With a folder, both are also saved as CSV.
    """
    narrow = settle(scored.select(tie_break, actual, probability), "scored")
    enforce(check_scored_labels(narrow, actual, probability))
    report = settle(performance_report(narrow, threshold, actual=actual, probability=probability), "report")
    table = settle(calibration_table(narrow, bands, actual, probability, tie_break), "calibration")
    if folder:
        write_csv(report, f"{folder}/performance_metrics.csv")
        write_csv(table.orderBy("calibration_band"), f"{folder}/calibration_table.csv")
    return {"performance_metrics": report, "calibration_table": table, "calibration_errors": calibration_errors(table)}
