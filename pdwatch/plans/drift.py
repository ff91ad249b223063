"""The drift monitoring job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.config import MINIMUM_SAMPLES
from pdwatch.operators.drift import population_facts, psi_by_feature
from pdwatch.operators.quality import enforce_size
from pdwatch.plans.performance import with_metadata
from pdwatch.schemas import FEATURES
from pdwatch.sources.tables import store_report


def run_drift(
    reference: DataFrame,
    production: DataFrame,
    run_date: str,
    reference_dataset: str,
    production_dataset: str,
    model_version: str,
    features: Sequence[str] = FEATURES,
    minimum: int = MINIMUM_SAMPLES,
    path: str | None = None,
) -> DataFrame:
    """Gate on the production sample, then one row per feature with run metadata.

    The gate takes its count from the pass that finds the ranges. With `path` the report is stored by run date, and
    the stored rows are returned, so that metrics made from them do not compute it again.
    """
    facts = population_facts(reference, production, features)
    sample_size = enforce_size(facts["production_rows"], minimum)
    report = with_metadata(
        psi_by_feature(reference, production, features, facts=facts),
        run_date=run_date,
        reference_dataset=reference_dataset,
        production_dataset=production_dataset,
        sample_size=F.lit(sample_size).cast("long"),
        model_version=model_version,
    )
    return store_report(report, path, run_date) if path else report
