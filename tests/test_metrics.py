import numpy as np
import pytest
from pyspark.sql import functions as F

from pdwatch.operators import metrics as M

GOLDEN = {
    "record_count": 10,
    "default_count": 4,
    "non_default_count": 6,
    "auc": 0.9583333333333334,
    "ks": 0.8333333333333334,
    "gini": 0.9166666666666667,
    "bad_rate": 0.4,
    "average_predicted_pd": 0.415,
    "prediction_standard_deviation": 0.2864000698,
    "minimum_predicted_pd": 0.05,
    "maximum_predicted_pd": 0.9,
    "accuracy": 0.8,
    "balanced_accuracy": 0.7916666667,
    "precision": 0.75,
    "recall": 0.75,
    "specificity": 5 / 6,
    "f1": 0.75,
    "false_positive_rate": 1 / 6,
    "false_negative_rate": 0.25,
    "predicted_positive_rate": 0.4,
    "brier_score": 0.09425,
    "log_loss": 0.325529361,
    "calibration_error": 0.015,
    "true_positive": 3,
    "false_positive": 1,
    "true_negative": 5,
    "false_negative": 1,
    "classification_threshold": 0.5,
}


def test_report_matches_known_values(labelled):
    row = M.performance_report(labelled, 0.5, digits=None).first().asDict()
    assert list(row) == list(M.REPORT_COLUMNS)
    for name, value in GOLDEN.items():
        assert row[name] == pytest.approx(value, abs=1e-9), name
    rounded = M.performance_report(labelled, 0.5).first()
    assert rounded["auc"] == 0.9583 and rounded["false_positive_rate"] == 0.1667


def test_single_metrics_equal_the_report(labelled):
    parts = [
        M.class_counts(labelled),
        M.bad_rate(labelled),
        M.pd_distribution(labelled),
        M.confusion_matrix(labelled, 0.5),
        M.classification_metrics(labelled, 0.5),
        M.losses(labelled),
        M.portfolio_calibration(labelled),
        M.discrimination(labelled),
    ]
    for part in parts:
        for name, value in part.first().asDict().items():
            assert value == pytest.approx(GOLDEN[name], abs=1e-9), name


def test_no_predicted_positive(labelled):
    row = M.performance_report(labelled, 1.0).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)


def test_threshold_is_inclusive(spark):
    df = spark.createDataFrame([(0.5, 1), (0.49, 0)], "predicted_probability double, actual_default int")
    assert M.confusion_matrix(df, 0.5).first().asDict() == {
        "true_positive": 1,
        "false_positive": 0,
        "true_negative": 1,
        "false_negative": 0,
    }


def test_auc_with_ties_and_hot_score_against_pairs(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(0, 1, 600), 2)
    p[:200] = 0.37  # a third of all rows share one score
    y = (rng.uniform(0, 1, 600) < p).astype(int)
    df = spark.createDataFrame(list(zip(map(float, p), map(int, y))), "predicted_probability double, actual_default int")
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    cuts = np.unique(p)
    ks = max((pos >= c).mean() - (neg >= c).mean() for c in cuts)
    row = M.discrimination(df).first()
    assert row["auc"] == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)
    assert row["ks"] == pytest.approx(ks, abs=1e-12)
    mirrored = M.discrimination(df.withColumn("predicted_probability", 1 - F.col("predicted_probability"))).first()
    assert mirrored["auc"] == pytest.approx(1 - row["auc"], abs=1e-9)


def test_log_loss_clips_certain_scores(spark):
    df = spark.createDataFrame([(1.0, 0), (0.0, 0)], "predicted_probability double, actual_default int")
    eps = M.LOG_LOSS_EPSILON
    assert M.losses(df).first()["log_loss"] == pytest.approx(-(np.log(1 - (1 - eps)) + np.log(1 - eps)) / 2)


def test_segment_without_a_class_has_no_auc(spark):
    df = spark.createDataFrame(
        [("a", 0.2, 0), ("a", 0.7, 1), ("b", 0.3, 0), (None, 0.4, 1), (None, 0.1, 0)],
        "segment string, predicted_probability double, actual_default int",
    )
    rows = {r["segment"]: r for r in M.performance_report(df, 0.5, keys=["segment"]).collect()}
    assert set(rows) == {"a", "b", None}
    assert rows["a"]["auc"] == 1.0 and rows[None]["auc"] == 1.0
    assert rows["b"]["auc"] is None and rows["b"]["ks"] is None and rows["b"]["bad_rate"] == 0.0


def test_report_does_not_depend_on_partitioning(spark, labelled):
    expected = M.performance_report(labelled, 0.5).first()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert M.performance_report(labelled.repartition(5), 0.5).first() == expected
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_roc_starts_at_origin_and_ends_at_one(labelled):
    points = [(r["false_positive_rate"], r["true_positive_rate"]) for r in M.roc_points(labelled).collect()]
    assert len(points) == 11 and (0.0, 0.0) in points and (1.0, 1.0) in points


def test_arguments(labelled):
    with pytest.raises(ValueError, match="threshold"):
        M.performance_report(labelled, 1.2)
    with pytest.raises(TypeError, match="threshold"):
        M.performance_report(labelled, "half")
    with pytest.raises(ValueError, match="missing columns"):
        M.bad_rate(labelled, actual="label")


def test_the_distribution_is_combined_once(spark, labelled, monkeypatch):
    from pdwatch.operators import metrics

    written, settle = [], metrics.settle
    monkeypatch.setattr(metrics, "settle", lambda df, name: written.append(name) or settle(df, name))
    report = metrics.performance_report(labelled, 0.5).first()
    assert written == ["distribution"] and report["record_count"] == 10


def test_applications_are_written_without_a_shuffle_of_wide_rows(spark, monkeypatch):
    from pdwatch.sources import applications

    written = []
    monkeypatch.setattr(applications, "_staged", {})
    monkeypatch.setattr(applications, "settle", lambda df, name: written.append(df) or df)
    rows = applications.staged_applications(spark, "/root/testdata/sf0.001")
    plan = written[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Rebalance" not in plan and "strategy=merge" in plan
    assert rows.count() == spark.read.parquet("/root/testdata/sf0.001/orders.parquet").count()
