"""The production summary: volume, score range, PD buckets, feature averages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.config import PD_BUCKETS
from pdwatch.operators.checks import require_columns
from pdwatch.schemas import PROBABILITY, SUMMARY_FEATURES


def pd_bucket(probability: Column) -> Column:
    chain = None
    for name, upper in PD_BUCKETS:
        if upper is None:
            return chain.otherwise(name)
        chain = F.when(probability < upper, name) if chain is None else chain.when(probability < upper, name)
    return chain


def pd_buckets(predictions: DataFrame, probability: str = PROBABILITY) -> DataFrame:
    require_columns(predictions, [probability])
    return predictions.groupBy(pd_bucket(F.col(probability)).alias("pd_bucket")).agg(
        F.count(F.lit(1)).alias("prediction_count")
    )


def feature_averages(features: DataFrame, names: Sequence[str] = SUMMARY_FEATURES) -> DataFrame:
    """Averages of those listed features that the table has."""
    present = [n for n in names if n in features.columns]
    if not present:
        raise ValueError("none of the features is present")
    return features.agg(*[F.avg(n).alias(f"avg_{n}") for n in present])


def production_summary(
    predictions: DataFrame,
    probability: str = PROBABILITY,
    names: Sequence[str] = SUMMARY_FEATURES,
    keys: Sequence[str] = (),
    features: DataFrame | None = None,
) -> DataFrame:
    """One row per `keys` group from one pass; without keys one row.

    The features may be a table of their own; both tables are then put under each other, so that nothing is joined.
    Without keys and predictions the count is zero and all else but the feature averages is null.
    """
    require_columns(predictions, [probability, *keys])
    described = predictions if features is None else features
    present = [n for n in names if n in described.columns]
    rows = predictions.withColumn("__scored", F.lit(True))
    if features is not None:
        require_columns(features, keys)
        own = features.select(*keys, *present, F.lit(False).alias("__scored"))
        rows = rows.select(*keys, probability, "__scored").unionByName(own, allowMissingColumns=True)
    scored = F.col("__scored")
    p = F.col(probability)
    bucket = pd_bucket(p)
    total = F.count_if(scored)
    counts = [
        F.when(total > 0, F.count_if(scored & (bucket == name))).alias(f"pd_{name}_count") for name, _ in PD_BUCKETS
    ]
    return rows.groupBy(*keys).agg(
        total.alias("prediction_count"),
        F.avg(p).alias("avg_default_probability"),
        F.min(p).alias("min_default_probability"),
        F.max(p).alias("max_default_probability"),
        *counts,
        *[F.avg(n).alias(f"avg_{n}") for n in present],
    )
