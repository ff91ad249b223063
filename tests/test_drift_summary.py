import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pdwatch.functions import expressions as X
from pdwatch.functions.paths import artifact_paths, clean_prefix, report_folder
from pdwatch.functions.rounding import round_half_even
from pdwatch.operators import drift as D
from pdwatch.operators import sampling as S
from pdwatch.operators import summary as Y
from pdwatch.operators.quality import QualityError
from pdwatch.plans.drift import run_drift
from pdwatch.plans.training import split


def index_by_histogram(reference, production, bins=10):
    edges = np.linspace(min(reference.min(), production.min()), max(reference.max(), production.max()), bins + 1)
    share = [np.histogram(x, bins=edges)[0] / len(x) for x in (reference, production)]
    before, after = [np.where(s == 0, 0.0001, s) for s in share]
    return float(np.sum((after - before) * np.log(after / before)))


def test_index_equals_histograms(spark):
    rng = np.random.default_rng(2)
    a = pd.DataFrame({"x": rng.normal(0, 1, 800), "y": rng.integers(0, 11, 800).astype(float)})
    b = pd.DataFrame({"x": rng.normal(0.7, 1.2, 300), "y": rng.integers(3, 14, 300).astype(float)})
    got = {r["feature"]: r["psi"] for r in D.psi(spark.createDataFrame(a), spark.createDataFrame(b), ["x", "y"]).collect()}
    for name in ("x", "y"):
        assert got[name] == pytest.approx(index_by_histogram(a[name].to_numpy(), b[name].to_numpy()), abs=1e-12)
        assert got[name] >= 0


def test_same_population_and_constant_feature(spark):
    df = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit(3.0).alias("c"))
    rows = {r["feature"]: r for r in D.psi_by_feature(df, df, ["x", "c"]).collect()}
    assert rows["x"]["psi"] == 0.0 and rows["c"]["psi"] == 0.0 and rows["x"]["status"] == "NORMAL"


def test_status_levels(spark):
    df = spark.createDataFrame([(0.0999,), (0.1,), (0.2499,), (0.25,)], "v double")
    assert [r[0] for r in df.select(D.psi_status(F.col("v"))).collect()] == ["NORMAL", "WARNING", "WARNING", "ALERT"]


def test_missing_values_and_gate(spark):
    good = spark.range(120).select(F.col("id").cast("double").alias("x"))
    with pytest.raises(QualityError, match="missing values in: x"):
        D.psi(good, good.withColumn("x", F.when(F.col("x") > 3, F.col("x"))), ["x"])
    with pytest.raises(QualityError, match="99 rows found, 100 needed"):
        run_drift(good, good.limit(99), "2024-01-01", "r", "p", "v1", ["x"])
    report = run_drift(good, good, "2024-01-01", "r", "p", "v1", ["x"]).first().asDict()
    assert report["sample_size"] == 120 and report["model_version"] == "v1"


def test_summary_of_two_rows(spark):
    df = spark.createDataFrame(
        [(750.0, 90000.0, 10000.0, 0.15, 0.02), (700.0, 60000.0, 20000.0, 0.40, 0.25)],
        "fico double, income double, loan_amount double, utilization double, default_probability double",
    )
    row = Y.production_summary(df, "default_probability").first()
    assert (row["prediction_count"], row["pd_low_count"], row["pd_very_high_count"]) == (2, 1, 1)
    assert (row["avg_fico"], row["avg_income"]) == (725.0, 75000.0)
    empty = Y.production_summary(df.limit(0).drop("income"), "default_probability").first().asDict()
    assert empty["prediction_count"] == 0 and empty["pd_low_count"] is None and "avg_income" not in empty


def test_bucket_edges(spark):
    df = spark.createDataFrame([(0.049,), (0.05,), (0.1,), (0.2,)], "p double")
    assert [r[0] for r in df.select(Y.pd_bucket(F.col("p"))).collect()] == ["low", "medium", "high", "very_high"]


def test_expressions(spark):
    df = spark.createDataFrame([(0.4999, 0.65), (0.5, 0.75), (float("nan"), None)], "p double, auc double")
    rows = df.select(
        X.predicted_class(F.col("p")), X.decision(F.col("p")), X.metric_status("auc", F.col("auc")), X.null_for_nan(F.col("p"))
    ).collect()
    assert tuple(rows[0]) == (0, "approve", "WARNING", 0.4999)
    assert tuple(rows[1]) == (1, "decline", "NORMAL", 0.5)
    assert rows[2][2] is None and rows[2][3] is None


def test_rounding_follows_numpy(spark):
    values = [0.00005, 0.12345, 0.00015, 2.5, -0.12345, 0.33335]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(round_half_even(F.col("v"))).collect()] == list(np.round(values, 4))


def test_sampling(spark):
    df = spark.range(40).select(F.col("id").cast("string").alias("application_id"), F.col("id").cast("double").alias("x"))
    first, again = S.sample_rows(df, 10), S.sample_rows(df.repartition(7), 10)
    assert sorted(first.collect()) == sorted(again.collect()) and first.distinct().count() == 10
    assert sorted(first.collect()) != sorted(S.sample_rows(df, 10, seed=7).collect())
    assert S.sample_rows(df, 100).count() == 40 and S.sample_rows(df, None).count() == 40
    draws = S.bootstrap_rows(df, 60)
    assert draws.count() == 60 and draws.columns == ["draw", *df.columns]
    assert sorted(draws.collect()) == sorted(S.bootstrap_rows(df.repartition(7), 60).collect())
    assert S.load_background(df.withColumn("y", F.lit(1)), ["y", "x"], 5).columns == ["y", "x"]
    with pytest.raises(ValueError, match="sample size"):
        S.sample_rows(df, 0)
    with pytest.raises(TypeError, match="numeric"):
        S.load_background(df, ["application_id"], 5)
    with pytest.raises(QualityError, match="x_not_null"):
        S.load_background(df.withColumn("x", F.when(F.col("x") > 0, F.col("x"))), ["x"], 5)


def test_paths():
    day = dt.date(2026, 7, 30)
    assert clean_prefix(" /a/b/ ") == "a/b"
    assert report_folder("/reports/", "v1", day) == "reports/model_version=v1/dt=2026-07-30"
    assert artifact_paths(["m.csv"], "r", "v1", day) == {"m.csv": "r/model_version=v1/dt=2026-07-30/m.csv"}
    for bad in ("", " / "):
        with pytest.raises(ValueError):
            clean_prefix(bad)
    with pytest.raises(TypeError):
        report_folder("r", "v1", "2026-07-30")
    with pytest.raises(ValueError):
        report_folder("r", " ", day)


def test_index_by_key(spark):
    rows = [(k, float(x % (7 + k))) for k in (1, 2) for x in range(40)]
    before = spark.createDataFrame([*rows, (3, 1.0), (None, 1.0), (None, 2.0)], "k int, x double")
    after = spark.createDataFrame([*[(k, x * 1.2) for k, x in rows], (None, 1.0), (4, 5.0)], "k int, x double")
    found = {r["k"]: r["psi"] for r in D.psi(before, after, ["x"], keys=["k"]).collect()}
    for k in (1, 2, None):
        same = F.col("k").eqNullSafe(F.lit(k))
        alone = D.psi(before.where(same), after.where(same), ["x"]).first()["psi"]
        assert found[k] == pytest.approx(alone, abs=1e-12)
    assert found[3] is None and found[4] is None
    statuses = {r["k"]: r["status"] for r in D.psi_by_feature(before, after, ["x"], keys=["k"]).collect()}
    assert statuses[3] is None and statuses[1] is not None
    with pytest.raises(QualityError, match="missing values"):
        D.psi(before, after.withColumn("x", F.lit(None).cast("double")), ["x"], keys=["k"])


def test_summary_of_two_tables(spark):
    features = spark.createDataFrame([(750.0, 90000.0, "a"), (700.0, 60000.0, "b")], "fico double, income double, k string")
    scores = spark.createDataFrame([(0.02, "a"), (0.25, "a")], "predicted_probability double, k string")
    row = Y.production_summary(scores, features=features).first()
    assert (row["prediction_count"], row["pd_low_count"], row["pd_very_high_count"]) == (2, 1, 1)
    assert (row["avg_fico"], row["avg_income"]) == (725.0, 75000.0)
    none = Y.production_summary(scores.limit(0), features=features).first()
    assert (none["prediction_count"], none["pd_low_count"], none["avg_fico"]) == (0, None, 725.0)
    by_key = {r["k"]: r for r in Y.production_summary(scores, features=features, keys=["k"]).collect()}
    assert by_key["a"]["prediction_count"] == 2 and by_key["b"]["prediction_count"] == 0
    assert by_key["b"]["avg_fico"] == 700.0


def test_split_does_not_follow_the_layout(spark):
    rows = spark.range(500).select(F.col("id").cast("string").alias("application_id"))
    parts = [{r[0] for r in part.collect()} for part in split(rows)]
    again = [{r[0] for r in part.collect()} for part in split(rows.repartition(7))]
    assert parts == again and not parts[0] & parts[1] and 350 < len(parts[0]) < 450
