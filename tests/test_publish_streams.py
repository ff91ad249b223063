import datetime as dt

import pytest
from pyspark.sql import functions as F

from pdwatch import config
from pdwatch.catalog.model import FOREST as MODEL
from pdwatch.operators import calibration, forest, metrics, publish, shap, windows
from pdwatch.operators.quality import QualityError
from pdwatch.plans import training
from pdwatch.plans.performance import monitoring_tables, status_rows
from pdwatch.schemas import CALIBRATION_SCHEMA, FEATURES
from pdwatch.sources import tables
from pdwatch.streaming import scoring, windows as stream_windows


def test_seventeen_metrics_and_batches(spark, labelled):
    errors = calibration.calibration_errors(calibration.calibration_table(labelled, 5))
    report = metrics.performance_report(labelled, 0.5)
    dims = publish.dimensions("v1", extra={"Region": 3})
    long = publish.metrics_long(report, dims=dims).unionByName(publish.metrics_long(errors, dims=dims))
    rows = {r["metric_name"]: r for r in long.collect()}
    assert len(rows) == 17 and rows["RecordCount"]["unit"] == "Count" and rows["AUC"]["unit"] == "None"
    assert rows["AUC"]["dimensions"] == {"ModelVersion": "v1", "Environment": "development", "Region": "3"}
    assert publish.metrics_long(report.withColumn("auc", F.lit(None).cast("double")).drop("ks")).count() == 13
    many = spark.range(45).select(F.lit("r").alias("report"), F.format_string("m%02d", "id").alias("metric_name"), F.lit(1.0).alias("value"))
    batches = publish.metric_batches(many, ["report"])
    sizes = {r["batch_id"]: r["count"] for r in batches.groupBy("batch_id").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 5}
    assert publish.batch_counts(batches).first().asDict() == {"metric_count": 45, "request_count": 3}


def test_publication_arguments(spark):
    for bad in (("", "dev", {}), ("v1", " ", {}), ("v1", "dev", {"": "x"}), ("v1", "dev", {"k": " "})):
        with pytest.raises(ValueError):
            publish.dimensions(*bad)
    with pytest.raises(QualityError, match="exactly one row"):
        publish.single_row(spark.range(2))
    assert publish.single_row(spark.range(1)) == {"id": 0}
    with pytest.raises(ValueError, match="batch size"):
        publish.metric_batches(spark.range(1), ["id"], 0)


def test_status_rows(labelled):
    rows = {r["metric"]: r["status"] for r in status_rows(metrics.performance_report(labelled, 0.5)).collect()}
    assert rows == {"auc": "NORMAL", "ks": "NORMAL", "calibration_error": "NORMAL", "bad_rate": "ALERT"}


def test_monitoring_tables_as_csv(spark, labelled, tmp_path):
    made = monitoring_tables(labelled, str(tmp_path), bands=5)
    stored = tables.read_table(spark, f"{tmp_path}/calibration_table.csv", CALIBRATION_SCHEMA)
    assert sorted(stored.collect()) == sorted(made["calibration_table"].collect())
    with pytest.raises(ValueError, match="unsupported"):
        tables.read_table(spark, "scores.json")
    with pytest.raises(ValueError, match="schema"):
        tables.read_table(spark, "scores.csv")


def test_dated_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-02"), ("c", "2024-01-02")], "id string, dt string")
    tables.write_partitioned(df, path)
    tables.write_partitioned(df.where("id = 'a'"), path)
    assert tables.read_partitioned(spark, path).count() == 4
    assert sorted(r["id"] for r in tables.read_latest(spark, path).collect()) == ["b", "c"]
    one = tables.read_run_date(spark, path, "2024-01-02")
    assert one.count() == 2 and "PartitionFilters: [isnotnull(dt" in one._jdf.queryExecution().toString()
    tables.write_partitioned(df.where("id = 'b'"), path, mode="overwrite")
    assert tables.read_run_date(spark, path, dt.date(2024, 1, 2)).count() == 1
    assert tables.read_run_date(spark, path, dt.date(2024, 1, 1)).count() == 2
    with pytest.raises(ValueError):
        tables.read_run_date(spark, path, "yesterday")


def test_report_folder(spark, labelled, tmp_path):
    report = metrics.performance_report(labelled, 0.5)
    path = tables.write_report(report, str(tmp_path), "/reports/", "v1", dt.date(2024, 1, 2), "performance.parquet")
    assert path.endswith("reports/model_version=v1/dt=2024-01-02/performance.parquet")
    assert tables.read_table(spark, path).first() == report.first()


@pytest.fixture(scope="module")
def event_rows(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=37 * i), "error" if i % 3 == 0 else "view") for i in range(900)]
    return spark.createDataFrame(rows, "ts timestamp_ntz, event_type string")


def test_series_and_alarms(event_rows):
    errors = windows.error_events(event_rows)
    series = windows.metric_series(errors, [("PredictionErrorCount", 3600, "Sum"), ("PredictionErrorCount", 300, "Average")])
    hourly = series.where("period_seconds = 3600")
    plain = errors.groupBy(F.window("ts", "1 hour").start.alias("w")).agg(F.sum("value").alias("v"))
    assert sorted((r["window_start"], r["metric_value"]) for r in hourly.collect()) == sorted(tuple(r) for r in plain.collect())
    assert {r["metric_value"] for r in series.where("statistic = 'Average'").collect()} == {1.0}
    states = windows.alarm_states(errors, [("busy", "PredictionErrorCount", 3600, "Sum", 33.0)]).collect()
    assert all(r["breached"] == (r["metric_value"] >= 33.0) for r in states) and any(r["breached"] for r in states)


def test_prediction_and_explanation_events(spark):
    scored = spark.createDataFrame([(0.8,), (0.75,), (0.1,)], "p double").withColumn("ts", F.current_timestamp())
    counts = {r["metric_name"]: r["count"] for r in windows.prediction_events(scored, "p").groupBy("metric_name").count().collect()}
    assert counts == {"PredictionCount": 3, "DefaultProbability": 3, "HighRiskPredictionCount": 2}


def test_stream_equals_batch_for_closed_windows(spark, event_rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    event_rows.write.parquet(source)
    errors = windows.error_events(scoring.follow_parquet(spark, source, event_rows.schema))
    stream_windows.write_windows(
        stream_windows.windowed_stream(errors, 3600, "10 minutes"), out, str(tmp_path / "cp")
    ).awaitTermination()
    streamed = {r["window_start"]: r["metric_sum"] for r in spark.read.parquet(out).collect()}
    batch = windows.metric_series(windows.error_events(event_rows), [("PredictionErrorCount", 3600, "Sum")])
    expected = {r["window_start"]: r["metric_value"] for r in batch.collect()}
    last = windows.error_events(event_rows).agg(F.max("ts")).first()[0]
    closed = {w: v for w, v in expected.items() if w + dt.timedelta(hours=1) <= last - dt.timedelta(minutes=10)}
    assert streamed == closed and 0 < len(closed) < len(expected)
    alarms = stream_windows.alarm_stream(spark.read.parquet(out), "busy", "PredictionErrorCount", "Sum", 33.0)
    assert alarms.count() == len(closed)


def test_foreach_batch_publication(spark, event_rows, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    event_rows.write.parquet(source)
    errors = windows.error_events(scoring.follow_parquet(spark, source, event_rows.schema))
    stream_windows.publish_batches(
        errors, lambda batch, i: batch.write.mode("append").parquet(out), str(tmp_path / "cp")
    ).awaitTermination()
    assert spark.read.parquet(out).count() == 300


def test_boosted_trees_give_their_own_impacts(spark, tmp_path):
    df = spark.range(400).select(
        *[((F.col("id") * (i + 3) * 7919) % 101).cast("double").alias(f) for i, f in enumerate(FEATURES)]
    )
    df = df.withColumn("actual_default", ((F.col("fico") + F.col("debt") - F.col("age")) > 55).cast("int"))
    model = training.train(df, trees=4, depth=3, learning_rate=0.3)
    path = str(tmp_path / "booster")
    model.stages[-1].write().save(path)
    trees = forest.forest_from_gbt(spark, path, FEATURES)
    scored = training.scorer(model)(df)
    base = shap.background_counts(df, trees)
    rows = (
        shap.shap_vectors(scored, trees, base, FEATURES)
        .withColumn("mine", forest.probability(forest.margin(trees)))
        .withColumn("m", forest.margin(trees))
        .collect()
    )
    for r in rows:
        assert r["mine"] == pytest.approx(r["default_probability"], abs=1e-12)
        assert sum(r["impacts"]) == pytest.approx(r["m"] - base.expected_margin(trees), abs=1e-9)


def test_model_info(spark, tmp_path):
    path = training.write_model_info(spark, str(tmp_path / "i"), "m", "v1", "trees", dt.date(2024, 1, 1), FEATURES)
    info = training.read_model_info(spark, path)
    assert info.first()["features"] == list(FEATURES)
    joined = training.with_model_info(spark.createDataFrame([("v1", 3)], "model_version string, n int"), info)
    assert joined.first()["algorithm"] == "trees"


def test_model_uses_known_features():
    assert set(MODEL.features) <= set(FEATURES) and config.METRICS_PER_REQUEST == 20
