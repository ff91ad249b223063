"""Discrimination, classification and accuracy metrics of scored, labelled rows.

All metrics are sums over (score, pos, neg): a score with its number of defaults and non-defaults.
Single rows are already in that form, so plain metrics are one aggregate without a shuffle of rows.
AUC, KS and ROC need scores in order; there the rows are first combined per score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.functions.rounding import round_half_even
from pdwatch.operators.checks import require_columns, require_unit_interval
from pdwatch.operators.ordering import running_totals
from pdwatch.schemas import ACTUAL, PROBABILITY
from pdwatch.session import settle

LOG_LOSS_EPSILON = 2.220446049250313e-16

# The report's columns in order.
REPORT_COUNTS = (
    "record_count",
    "default_count",
    "non_default_count",
    "true_positive",
    "false_positive",
    "true_negative",
    "false_negative",
)
REPORT_COLUMNS = (
    "record_count",
    "default_count",
    "non_default_count",
    "auc",
    "ks",
    "gini",
    "bad_rate",
    "average_predicted_pd",
    "prediction_standard_deviation",
    "minimum_predicted_pd",
    "maximum_predicted_pd",
    "accuracy",
    "balanced_accuracy",
    "precision",
    "recall",
    "specificity",
    "f1",
    "false_positive_rate",
    "false_negative_rate",
    "predicted_positive_rate",
    "brier_score",
    "log_loss",
    "calibration_error",
    "true_positive",
    "false_positive",
    "true_negative",
    "false_negative",
    "classification_threshold",
)


def scored_rows(
    df: DataFrame, actual: str = ACTUAL, probability: str = PROBABILITY, keys: Sequence[str] = ()
) -> DataFrame:
    """Each row as (keys, score, pos, neg)."""
    require_columns(df, [actual, probability, *keys])
    return df.select(
        *keys,
        F.col(probability).cast("double").alias("score"),
        F.col(actual).cast("long").alias("pos"),
        (F.lit(1) - F.col(actual)).cast("long").alias("neg"),
    )


def score_distribution(
    df: DataFrame, actual: str = ACTUAL, probability: str = PROBABILITY, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per (keys, score). A score shared by many rows is combined before the shuffle."""
    return (
        scored_rows(df, actual, probability, keys)
        .groupBy(*keys, "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def ranked_distribution(
    df: DataFrame, actual: str = ACTUAL, probability: str = PROBABILITY, keys: Sequence[str] = ()
) -> DataFrame:
    """The distribution with running counts from the highest score down, and group totals."""
    return ranked_scores(score_distribution(df, actual, probability, keys), keys)


def ranked_scores(distribution: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """As `ranked_distribution`, from (keys, score, pos, neg) with one row per score.

    The distribution is written once: its rows are counted before they are ordered, which would combine the scores again.
    """
    return running_totals(
        settle(distribution, "distribution"),
        order_by=[F.col("score").desc()],
        running={"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        totals={
            "total_pos": F.col("pos"),
            "total_neg": F.col("neg"),
            "total_score": F.col("score") * (F.col("pos") + F.col("neg")),
        },
        keys=keys,
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    """A share that is zero when nothing is in the denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def _weight() -> Column:
    return F.col("pos") + F.col("neg")


def exact_sum(x: Column) -> Column:
    """A sum of doubles that does not depend on the order of the rows: at most 20 digits before and 18 after the point."""
    nan = F.isnan(x)
    return F.coalesce(F.max(F.when(nan, x)), F.sum(F.when(~nan, x).cast("decimal(38,18)")).cast("double"))


def count_aggregates() -> dict[str, Column]:
    return {
        "record_count": F.coalesce(F.sum(_weight()), F.lit(0)),
        "default_count": F.coalesce(F.sum("pos"), F.lit(0)),
        "non_default_count": F.coalesce(F.sum("neg"), F.lit(0)),
    }


def confusion_aggregates(threshold: float) -> dict[str, Column]:
    positive = F.col("score") >= F.lit(float(threshold))
    zero = F.lit(0)
    return {
        "true_positive": F.coalesce(F.sum(F.when(positive, F.col("pos")).otherwise(zero)), zero),
        "false_positive": F.coalesce(F.sum(F.when(positive, F.col("neg")).otherwise(zero)), zero),
        "true_negative": F.coalesce(F.sum(F.when(positive, zero).otherwise(F.col("neg"))), zero),
        "false_negative": F.coalesce(F.sum(F.when(positive, zero).otherwise(F.col("pos"))), zero),
    }


def spread_aggregates() -> dict[str, Column]:
    return {
        "average_predicted_pd": exact_sum(F.col("score") * _weight()) / F.sum(_weight()),
        "minimum_predicted_pd": F.min("score"),
        "maximum_predicted_pd": F.max("score"),
    }


def loss_aggregates() -> dict[str, Column]:
    inside = F.greatest(F.lit(LOG_LOSS_EPSILON), F.least(F.lit(1.0 - LOG_LOSS_EPSILON), F.col("score")))
    squared = F.col("pos") * F.pow(F.col("score") - 1.0, F.lit(2.0)) + F.col("neg") * F.pow("score", F.lit(2.0))
    likelihood = F.col("pos") * F.ln(inside) + F.col("neg") * F.ln(1.0 - inside)
    return {
        "brier_score": exact_sum(squared) / F.sum(_weight()),
        "log_loss": -exact_sum(likelihood) / F.sum(_weight()),
    }


def rank_aggregates() -> dict[str, Column]:
    """AUC with ties counted half, and KS; both null when a class is missing."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = neg * (F.col("cum_pos") - F.col("pos")) + F.lit(0.5) * pos * neg
    pairs = F.max("total_pos").cast("double") * F.max("total_neg").cast("double")
    gap = F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos").cast("double")) - F.try_divide(
        F.col("cum_neg").cast("double"), F.col("total_neg").cast("double")
    )
    best = F.max(gap)
    return {
        "auc": F.try_divide(F.sum(wins), pairs),
        "ks": F.when(best.isNotNull(), F.greatest(F.lit(0.0), best)),
    }


def classification_columns() -> dict[str, Column]:
    """Ratios of the confusion counts; a ratio of nothing is zero."""
    tp, fp = F.col("true_positive"), F.col("false_positive")
    tn, fn = F.col("true_negative"), F.col("false_negative")
    total = tp + fp + tn + fn
    recall, specificity = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return {
        "accuracy": _ratio(tp + tn, total),
        "balanced_accuracy": (recall + specificity) / 2.0,
        "precision": _ratio(tp, tp + fp),
        "recall": recall,
        "specificity": specificity,
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
        "false_positive_rate": 1.0 - specificity,
        "false_negative_rate": 1.0 - recall,
        "predicted_positive_rate": _ratio(tp + fp, total),
    }


def _aggregate(rows: DataFrame, keys: Sequence[str], aggregates: dict[str, Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def class_counts(df: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    return _aggregate(scored_rows(df, keys=keys, **columns), keys, count_aggregates())


def bad_rate(df: DataFrame, actual: str = ACTUAL, keys: Sequence[str] = ()) -> DataFrame:
    require_columns(df, [actual, *keys])
    return df.groupBy(*keys).agg(F.avg(F.col(actual).cast("double")).alias("bad_rate"))


def pd_distribution(df: DataFrame, probability: str = PROBABILITY, keys: Sequence[str] = ()) -> DataFrame:
    """Average, population deviation, minimum and maximum of the predicted probability."""
    require_columns(df, [probability, *keys])
    return df.groupBy(*keys).agg(
        F.avg(probability).alias("average_predicted_pd"),
        F.stddev_pop(probability).alias("prediction_standard_deviation"),
        F.min(probability).alias("minimum_predicted_pd"),
        F.max(probability).alias("maximum_predicted_pd"),
    )


def confusion_matrix(df: DataFrame, threshold: float, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    require_unit_interval(threshold, "threshold")
    return _aggregate(scored_rows(df, keys=keys, **columns), keys, confusion_aggregates(threshold))


def classification_metrics(df: DataFrame, threshold: float, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    metrics = classification_columns()
    return confusion_matrix(df, threshold, keys, **columns).select(*keys, *[c.alias(n) for n, c in metrics.items()])


def losses(df: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    return _aggregate(scored_rows(df, keys=keys, **columns), keys, loss_aggregates())


def portfolio_calibration(df: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    """How far the average predicted probability is from the observed bad rate."""
    rows = scored_rows(df, keys=keys, **columns)
    return rows.groupBy(*keys).agg(F.abs(F.avg("score") - F.avg("pos")).alias("calibration_error"))


def discrimination(df: DataFrame, keys: Sequence[str] = (), **columns: str) -> DataFrame:
    """AUC, KS and Gini."""
    ranked = ranked_distribution(df, keys=keys, **columns)
    return _aggregate(ranked, keys, rank_aggregates()).withColumn("gini", 2.0 * F.col("auc") - 1.0)


def roc_points(df: DataFrame, **columns: str) -> DataFrame:
    """One point per distinct score, from the highest down, after the origin."""
    ranked = ranked_distribution(df, **columns)
    points = ranked.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("cum_neg").cast("double"), F.col("total_neg").cast("double")).alias("false_positive_rate"),
        F.try_divide(F.col("cum_pos").cast("double"), F.col("total_pos").cast("double")).alias("true_positive_rate"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("false_positive_rate"),
        F.lit(0.0).alias("true_positive_rate"),
    )
    return origin.unionByName(points)


def performance_report(
    df: DataFrame,
    threshold: float,
    keys: Sequence[str] = (),
    digits: int | None = 4,
    **columns: str,
) -> DataFrame:
    """All metrics of one population, or of each group in `keys`, from one pass over the scores.

    With `digits`, every ratio is rounded to that many places; counts stay whole numbers.
    """
    return report_of_scores(score_distribution(df, keys=keys, **columns), threshold, keys, digits)


def report_of_scores(distribution: DataFrame, threshold: float, keys: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """As `performance_report`, from (keys, score, pos, neg): distributions add up, so a report needs no rows."""
    require_unit_interval(threshold, "threshold")
    mean = F.col("total_score") / (F.col("total_pos") + F.col("total_neg"))
    deviation = F.sqrt(F.sum(_weight() * F.pow(F.col("score") - mean, F.lit(2.0))) / F.sum(_weight()))
    ranked = ranked_scores(distribution, keys)
    sums = _aggregate(
        ranked,
        keys,
        {
            **count_aggregates(),
            **rank_aggregates(),
            **spread_aggregates(),
            "prediction_standard_deviation": deviation,
            **loss_aggregates(),
            **confusion_aggregates(threshold),
        },
    )
    rate = _ratio(F.col("default_count"), F.col("record_count"))
    report = sums.withColumns(
        {
            "gini": 2.0 * F.col("auc") - 1.0,
            "bad_rate": rate,
            **classification_columns(),
            "calibration_error": F.abs(F.col("average_predicted_pd") - rate),
            "classification_threshold": F.lit(float(threshold)),
        }
    )

    def shown(name: str) -> Column:
        if digits is None or name in REPORT_COUNTS:
            return F.col(name)
        return round_half_even(F.col(name), digits).alias(name)

    return report.select(*keys, *[shown(name) for name in REPORT_COLUMNS])
