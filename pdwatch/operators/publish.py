"""Reports as long metric tables, ready to be published in batches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.config import METRICS_PER_REQUEST, MONITORING_METRICS
from pdwatch.operators.checks import require_columns, require_count, require_names, require_text
from pdwatch.operators.quality import QualityError


def dimensions(model_version: str, environment: str = "development", extra: Mapping[str, object] | None = None) -> dict[str, str]:
    named = {"ModelVersion": model_version, "Environment": environment}
    for name, value in {**named, **(extra or {})}.items():
        require_text(str(name), "dimension name")
        named[str(name)] = require_text(value if name in ("ModelVersion", "Environment") else str(value), "dimension value")
    return named


def dimension_map(values: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def single_row(report: DataFrame) -> dict:
    """The only row of a report; anything else is an error."""
    rows = report.limit(2).collect()
    if len(rows) != 1:
        raise QualityError("a report must have exactly one row")
    return rows[0].asDict()


def metrics_long(
    report: DataFrame,
    names: Sequence[tuple[str, str, str]] = MONITORING_METRICS,
    dims: Mapping[str, str] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """(keys, metric_name, value, unit, dimensions); absent columns and null values are left out."""
    require_columns(report, keys)
    entries = [
        F.struct(F.lit(metric).alias("metric_name"), F.col(c).cast("double").alias("value"), F.lit(unit).alias("unit"))
        for c, metric, unit in names
        if c in report.columns
    ]
    if not entries:
        raise ValueError("the report has none of the named columns")
    long = report.select(*keys, F.inline(F.array(*entries)))
    usable = long.where(F.col("value").isNotNull() & ~F.isnan("value"))
    return usable.withColumn("dimensions", dimension_map(dims)) if dims else usable


def psi_metrics(psi_report: DataFrame) -> DataFrame:
    return psi_report.select(
        F.concat(F.lit("FeaturePSI_"), F.col("feature")).alias("metric_name"),
        F.col("psi").alias("value"),
        F.lit("None").alias("unit"),
    )


def metric_batches(metrics: DataFrame, keys: Sequence[str], size: int = METRICS_PER_REQUEST) -> DataFrame:
    """Number the metrics of each report and cut them into requests of at most `size`.

    A report is one `keys` group; it has a fixed number of metrics, so a group stays small. Keys are required: without
    them all metrics of all reports would be one group.
    """
    require_columns(metrics, require_names(keys, "keys"))
    require_count(size, "batch size")
    order = Window.partitionBy(*keys).orderBy("metric_name")
    return metrics.withColumn("batch_id", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def batch_counts(batches: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Metrics and requests per report."""
    return batches.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("metric_count"), (F.max("batch_id") + 1).cast("long").alias("request_count")
    )
