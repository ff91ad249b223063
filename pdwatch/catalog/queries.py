"""One query per operator, over the whole source tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdwatch import config
from pdwatch.catalog.model import ENVIRONMENT, FOREST, LENDER_RANGES, MODEL_VERSION, PRIORITY_REGISTRY, RUN_DATE
from pdwatch.functions import expressions as X
from pdwatch.functions.paths import report_path
from pdwatch.operators import calibration, drift, forest, impacts, joins, metrics, publish, quality, reasons, records
from pdwatch.operators import registry as reg
from pdwatch.operators import sampling, shap, summary, windows
from pdwatch.plans import performance as perf
from pdwatch.plans import states, training
from pdwatch.plans.drift import run_drift
from pdwatch.plans.explain import explain_batch, explained_rows
from pdwatch.plans.summary import run_summary
from pdwatch.schemas import ACTUAL, CALIBRATION_SCHEMA, FEATURES, ID, PROBABILITY
from pdwatch.session import SESSION_CONF, settle, staging_path
from pdwatch.sources import applications as src
from pdwatch.sources import tables
from pdwatch.streaming import outcomes as stream_outcomes
from pdwatch.streaming import scoring as stream_scoring
from pdwatch.streaming import windows as stream_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_kept: dict[tuple[str, str, str], object] = {}

# Impacts are rounded before ranking here, so that another engine's last float digit cannot decide
# a rank between equal impacts.
IMPACT_DIGITS = 10
MEAN_DIGITS = 8
# What the trained model must reach: how well it ranks test rows, and how closely its node table follows it.
GBT_AUC = 0.65
GBT_GAP = 1e-9


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit"):
            spark.conf.set(name, SESSION_CONF[name])
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return function


def keep(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], object]) -> object:
    """Make once per session and source folder: a written table, or a small model-sized summary."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def rounded(df: DataFrame, digits: int, **other: int) -> DataFrame:
    """Doubles to some digits, timestamps without zone: what two engines can be compared on.

    Averages of decimal data can lie exactly between two numbers of six digits, where the order of
    a sum decides the rounding. Such columns are compared on more digits.
    """

    def shown(field: T.StructField) -> Column:
        c = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            return (F.round(c, other.get(field.name, digits)) + F.lit(0.0)).alias(field.name)
        if isinstance(field.dataType, T.TimestampType):
            return c.cast("timestamp_ntz").alias(field.name)
        return c

    return df.select(*[shown(f) for f in df.schema.fields])


def six(df: DataFrame) -> DataFrame:
    return rounded(df, 6)


def with_year(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", F.date_format("ts", "yyyy"))


def apps(spark: SparkSession, sf: str) -> DataFrame:
    return src.staged_applications(spark, sf)


def matched(spark: SparkSession, sf: str) -> DataFrame:
    """The validated join, which is written once."""
    a = apps(spark, sf)
    return keep(spark, sf, "matched", lambda: settle(joins.join_outcomes(src.predictions(a), src.outcomes(a)), "matched"))


def segmented(spark: SparkSession, sf: str) -> DataFrame:
    a = apps(spark, sf)
    scores = with_year(a).select(ID, PROBABILITY, "segment")
    return keep(spark, sf, "segmented", lambda: settle(joins.join_outcomes(scores, src.outcomes(a)), "segmented"))


def reference(spark: SparkSession, sf: str) -> DataFrame:
    return src.reference_population(apps(spark, sf))


def production(spark: SparkSession, sf: str) -> DataFrame:
    return src.production_population(apps(spark, sf))


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def event_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Events read as if they were a careless feed of scores and labels: ids repeat, values overflow."""
    label = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 0)
    return src.table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias(ID),
        (F.col("value") / 50.0).alias(PROBABILITY),
        label.when(F.col("event_type") == "click", 2).alias(ACTUAL),
        "event_type",
    )


def background(spark: SparkSession, sf: str) -> shap.Background:
    return keep(spark, sf, "background", lambda: shap.background_counts(reference(spark, sf), FOREST))


def typical(spark: SparkSession, sf: str) -> dict:
    return keep(spark, sf, "typical", lambda: impacts.typical_values(reference(spark, sf), FEATURES))


def explained(spark: SparkSession, sf: str) -> DataFrame:
    return explained_rows(
        apps(spark, sf), FOREST, background(spark, sf), typical(spark, sf), digits=IMPACT_DIGITS
    )


def impact_table(spark: SparkSession, sf: str) -> DataFrame:
    return impacts.expand(explained(spark, sf), [ID], "contributions")


def explanations(spark: SparkSession, sf: str, **options) -> DataFrame:
    return explain_batch(apps(spark, sf), FOREST, reference(spark, sf), MODEL_VERSION, digits=IMPACT_DIGITS, **options)


def by_dataset(**checks: DataFrame) -> DataFrame:
    parts = [c.withColumn("dataset", F.lit(name)) for name, c in checks.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def reason_rows(df: DataFrame) -> DataFrame:
    return six(
        df.select(ID, "reason_rank", "attribute_name", "attribute_impact", "reason_code", "compliance_review_required")
    )


# Sources and sinks


def dated_predictions(spark: SparkSession, sf: str) -> str:
    """Predictions written by month; returns the folder."""

    def write() -> str:
        monthly = apps(spark, sf).select(ID, PROBABILITY, F.to_date(F.date_trunc("month", "ts")).alias("dt"))
        return tables.write_partitioned(monthly, staging_path(spark, "predictions"))

    return keep(spark, sf, "dated_predictions", write)


@query
def latest_partition(spark, sf):
    return tables.read_latest(spark, dated_predictions(spark, sf)).select(
        ID, PROBABILITY, F.col("dt").cast("string").alias("dt")
    )


@query
def scan_partition(spark, sf):
    return tables.read_run_date(spark, dated_predictions(spark, sf), dt.date(1998, 1, 1)).select(
        ID, PROBABILITY, F.col("dt").cast("string").alias("dt")
    )


@query
def scan_csv(spark, sf):
    path = staging_path(spark, "calibration") + ".csv"
    tables.write_csv(calibration.calibration_table(matched(spark, sf)), path)
    return six(tables.read_table(spark, path, CALIBRATION_SCHEMA))


@query
def sink_metrics(spark, sf):
    stored = psi_run(spark, sf, staging_path(spark, "psi"))
    return six(stored.select("feature", "psi", "status", "sample_size", "run_date"))


@query
def sink_explanations(spark, sf):
    path = staging_path(spark, "explanations")
    monthly = apps(spark, sf).withColumn("ts", F.date_trunc("month", "ts"))
    explain_batch(
        monthly, FOREST, reference(spark, sf), MODEL_VERSION, persistence="table", path=path, digits=IMPACT_DIGITS
    )
    return explanation_summary(tables.read_partitioned(spark, path))


@query
def report_path_by_month(spark, sf):
    months = apps(spark, sf).groupBy(F.to_date(F.date_trunc("month", "ts")).alias("dt")).agg(
        F.count(F.lit(1)).alias("record_count")
    )
    path = report_path(F.lit(" /monitoring/reports/ "), F.lit(MODEL_VERSION), F.col("dt"))
    return months.select(path.alias("report_path"), "record_count")


QUERIES["report_path"] = QUERIES.pop("report_path_by_month")


@query
def background_load(spark, sf):
    return six(sampling.load_background(reference(spark, sf), FEATURES, config.BACKGROUND_SAMPLE_SIZE))


@query
def background_sample(spark, sf):
    return six(sampling.sample_rows(reference(spark, sf).select(ID, *FEATURES), config.BACKGROUND_SAMPLE_SIZE))


@query
def bootstrap_sample(spark, sf):
    return six(sampling.bootstrap_rows(reference(spark, sf).select(ID, *FEATURES), config.BACKGROUND_SAMPLE_SIZE))


# Quality


@query
def dq_feature_ranges(spark, sf):
    accepted, rejected = quality.split_requests(apps(spark, sf).select(ID, *FEATURES), LENDER_RANGES, ID)
    return accepted.select(ID, F.lit(True).alias("accepted"), F.lit("").alias("violated_rules")).unionByName(
        rejected.select(ID, F.lit(False).alias("accepted"), F.array_join("violated_rules", ",").alias("violated_rules"))
    )


@query
def dq_predictions(spark, sf):
    return by_dataset(
        predictions=quality.check_predictions(src.predictions(apps(spark, sf))),
        events=quality.check_predictions(event_feed(spark, sf)),
    )


@query
def dq_outcomes(spark, sf):
    return by_dataset(
        outcomes=quality.check_outcomes(src.outcomes(apps(spark, sf))),
        events=quality.check_outcomes(event_feed(spark, sf)),
    )


@query
def dq_performance(spark, sf):
    return by_dataset(
        matched=quality.check_scored_labels(matched(spark, sf)),
        events=quality.check_scored_labels(event_feed(spark, sf)),
    )


@query
def dq_calibration(spark, sf):
    return by_dataset(
        matched=quality.check_scored_labels(matched(spark, sf), both_classes=False),
        events=quality.check_scored_labels(event_feed(spark, sf), both_classes=False),
    )


@query
def dq_background(spark, sf):
    orders, lines = src.table(spark, sf, "orders"), src.table(spark, sf, "lineitem")
    unfilled = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return by_dataset(
        reference=quality.check_background(reference(spark, sf), FEATURES),
        unfilled=quality.check_background(unfilled, ["o_totalprice", "l_quantity"]),
    )


@query
def dq_identifiers(spark, sf):
    return by_dataset(
        matched=quality.check_identifiers(matched(spark, sf), [ID]),
        events=quality.check_identifiers(event_feed(spark, sf), [ID, "event_type"]),
    )


@query
def dq_impacts(spark, sf):
    whole = impact_table(spark, sf)
    return by_dataset(
        whole=quality.check_impacts(whole, [ID], FEATURES),
        raising=quality.check_impacts(whole.where("attribute_impact > 0"), [ID], FEATURES),
    )


@query
def dq_scores(spark, sf):
    return by_dataset(
        scored=quality.check_scores(forest.score(apps(spark, sf), FOREST), "default_probability"),
        events=quality.check_scores(event_feed(spark, sf)),
    )


@query
def min_sample_gate(spark, sf):
    return by_dataset(
        performance=quality.sample_gate(matched(spark, sf), config.MINIMUM_SAMPLES),
        drift=quality.sample_gate(production(spark, sf), config.MINIMUM_SAMPLES),
        day=quality.sample_gate(apps(spark, sf).where("ts = TIMESTAMP '1998-01-01'"), config.MINIMUM_SAMPLES),
    )


# Row expressions and the join


@query
def predicted_class(spark, sf):
    return apps(spark, sf).select(ID, X.predicted_class(F.col(PROBABILITY)).alias("predicted_class"))


@query
def decision(spark, sf):
    return apps(spark, sf).select(ID, X.decision(F.col(PROBABILITY)).alias("decision"))


@query
def high_risk(spark, sf):
    return apps(spark, sf).select(ID, X.high_risk(F.col(PROBABILITY)).alias("high_risk"))


@query
def join_outcomes(spark, sf):
    a = apps(spark, sf)
    return joins.join_outcomes(src.predictions(a), src.outcomes(a))


@query
def observations(spark, sf):
    return six(impacts.observations(apps(spark, sf), FEATURES, timestamp="ts"))


# Metrics


@query
def bad_rate(spark, sf):
    return six(metrics.bad_rate(matched(spark, sf)))


@query
def class_counts(spark, sf):
    return metrics.class_counts(matched(spark, sf))


@query
def pd_distribution(spark, sf):
    return six(metrics.pd_distribution(matched(spark, sf)))


@query
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(matched(spark, sf), config.CLASSIFICATION_THRESHOLD)


@query
def classification_metrics(spark, sf):
    return six(metrics.classification_metrics(matched(spark, sf), config.CLASSIFICATION_THRESHOLD))


@query
def brier_logloss(spark, sf):
    return six(metrics.losses(matched(spark, sf)))


@query
def portfolio_calibration(spark, sf):
    return six(metrics.portfolio_calibration(matched(spark, sf)))


@query
def auc_ks_gini(spark, sf):
    return six(metrics.discrimination(matched(spark, sf)))


@query
def roc_points(spark, sf):
    return six(metrics.roc_points(matched(spark, sf)))


def report(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.performance_report(matched(spark, sf), config.CLASSIFICATION_THRESHOLD)


@query
def performance_report(spark, sf):
    return report(spark, sf)


@query
def performance_by_segment(spark, sf):
    return metrics.performance_report(segmented(spark, sf), config.CLASSIFICATION_THRESHOLD, keys=["segment"])


@query
def report_with_metadata(spark, sf):
    a = apps(spark, sf)
    return perf.run_performance(
        src.predictions(a), src.outcomes(a), RUN_DATE, "predictions", "outcomes", MODEL_VERSION
    )


@query
def performance_job(spark, sf):
    """The stored report of a run, and the metrics published from it."""
    a = apps(spark, sf)
    stored = perf.run_performance(
        src.predictions(a), src.outcomes(a), RUN_DATE, "predictions", "outcomes", MODEL_VERSION,
        path=staging_path(spark, "performance"),
    )
    return six(publish.metrics_long(stored, config.PERFORMANCE_METRICS, keys=["model_version"]))


@query
def report_summary(spark, sf):
    row = report(spark, sf)
    names = [c for c in metrics.REPORT_COLUMNS]
    return row.select(*[F.col(n).cast("double").alias(n) for n in names]).unpivot([], names, "metric", "metric_value")


@query
def metric_status(spark, sf):
    return perf.status_rows(report(spark, sf))


# Calibration


@query
def calibration_bands(spark, sf):
    return calibration.assign_bands(matched(spark, sf)).select(ID, PROBABILITY, "calibration_band")


@query
def calibration_table(spark, sf):
    return six(calibration.calibration_table(matched(spark, sf)))


@query
def calibration_by_segment(spark, sf):
    return six(calibration.calibration_table(segmented(spark, sf), bands=5, keys=["segment"]))


@query
def calibration_errors(spark, sf):
    return six(calibration.calibration_errors(calibration.calibration_table(matched(spark, sf))))


@query
def expected_vs_actual(spark, sf):
    return six(calibration.expected_vs_actual(calibration.calibration_table(matched(spark, sf))))


@query
def monitoring_tables(spark, sf):
    made = perf.monitoring_tables(matched(spark, sf), staging_path(spark, "monitoring"))
    names = list(metrics.REPORT_COLUMNS)
    scalars = made["performance_metrics"].select(*[F.col(n).cast("double").alias(n) for n in names])
    errors = made["calibration_errors"]
    return six(
        scalars.unpivot([], names, "metric", "metric_value").unionByName(
            errors.unpivot([], errors.columns, "metric", "metric_value")
        )
    )


# Drift and summary


@query
def psi_single(spark, sf):
    return six(drift.psi(reference(spark, sf), production(spark, sf), ["utilization"]))


#: Ranges of months, which overlap.
RANGES = {"first year": ("1995-01", "1995-12"), "turn": ("1995-07", "1997-06"), "all": ("0000-01", "9999-12")}


@query
def performance_by_range(spark, sf):
    """Reports of ranges of months, from distributions that are stored by month."""
    a = apps(spark, sf)
    scores = a.select(ID, PROBABILITY, F.date_format("ts", "yyyy-MM").alias("period"))
    path = staging_path(spark, "distributions")
    states.store_distributions(joins.join_outcomes(scores, src.outcomes(a)), path)
    schema = "score double, pos bigint, neg bigint, period string"
    return states.performance_by_range(tables.read_partitioned(spark, path, schema), RANGES, config.CLASSIFICATION_THRESHOLD)


@query
def psi_against_profile(spark, sf):
    """The index against a stored profile of the reference."""
    profile = settle(states.value_profile(reference(spark, sf), FEATURES), "reference-profile")
    return six(states.psi_against_profile(profile, production(spark, sf), FEATURES))


@query
def default_identifier(spark, sf):
    """Events numbered in the order of their values."""
    plain = event_log(spark, sf).select("ts", "user_id", "event_type", "value")
    return rounded(sampling.with_default_identifiers(plain), 6)


@query
def background_sample_large(spark, sf):
    """A tenth of the reference."""
    rows = reference(spark, sf)
    return sampling.sample_rows(rows.select(ID, "fico"), max(1, rows.count() // 10))


@query
def psi_by_feature(spark, sf):
    return six(drift.psi_by_feature(reference(spark, sf), production(spark, sf), FEATURES))


@query
def psi_levels(spark, sf):
    """Order lines of more than 15 pieces against all lines: one feature at each level of the index."""
    lines = tables.read_table(spark, f"{sf}/lineitem.parquet").select(
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (F.col("l_quantity") * F.col("l_extendedprice")).alias("volume"),
    )
    lines = lines.dropna()
    return six(drift.psi_by_feature(lines, lines.where("quantity > 15"), ["quantity", "discount", "volume"]))


@query
def prediction_drift(spark, sf):
    return six(drift.prediction_drift(reference(spark, sf), production(spark, sf)))


@query
def psi_by_segment(spark, sf):
    """The index per calendar month; the months that the later population lacks have none."""
    before, after = (
        p.withColumn("segment", F.date_format("ts", "MM")) for p in (reference(spark, sf), production(spark, sf))
    )
    return six(drift.psi(before, after, FEATURES, keys=["segment"]))


@query
def summary_by_date(spark, sf):
    daily = apps(spark, sf).withColumn("segment", F.date_format("ts", "yyyy-MM-dd"))
    return rounded(summary.production_summary(daily, names=(), keys=["segment"]), 6, avg_default_probability=10)


def psi_run(spark: SparkSession, sf: str, path: str | None = None) -> DataFrame:
    return run_drift(
        reference(spark, sf), production(spark, sf), RUN_DATE, "reference", "production", MODEL_VERSION, path=path
    )


@query
def drift_job(spark, sf):
    """The stored report of a run, and the metrics published from it."""
    return six(publish.psi_metrics(psi_run(spark, sf, staging_path(spark, "drift"))))


@query
def summary_job(spark, sf):
    """Features and predictions of the latest month, two dated tables, as one stored row."""

    def write() -> str:
        monthly = apps(spark, sf).select(ID, *FEATURES, F.to_date(F.date_trunc("month", "ts")).alias("dt"))
        return tables.write_partitioned(monthly, staging_path(spark, "features"))

    features = keep(spark, sf, "dated_features", write)
    return six(
        run_summary(spark, features, dated_predictions(spark, sf), staging_path(spark, "summary"), RUN_DATE, MODEL_VERSION)
    )


@query
def psi_report(spark, sf):
    return six(psi_run(spark, sf))


@query
def psi_metrics(spark, sf):
    return six(publish.psi_metrics(psi_run(spark, sf)))


@query
def production_summary(spark, sf):
    return six(summary.production_summary(apps(spark, sf)))


@query
def pd_buckets(spark, sf):
    return summary.pd_buckets(apps(spark, sf))


@query
def feature_averages(spark, sf):
    return six(summary.feature_averages(apps(spark, sf)))


@query
def background_means(spark, sf):
    return rounded(impacts.background_means(reference(spark, sf), FEATURES), MEAN_DIGITS)


# Model and impacts


@query
def score_applications(spark, sf):
    return six(forest.score(apps(spark, sf), FOREST).select(ID, "default_probability"))


@query
def custom_scorer(spark, sf):
    def scorer(df: DataFrame) -> DataFrame:
        return df.withColumn("default_probability", F.sqrt(PROBABILITY))

    return six(forest.apply_scorer(apps(spark, sf), scorer, "default_probability").select(ID, "default_probability"))


@query
def shap_values(spark, sf):
    vectors = shap.shap_vectors(apps(spark, sf), FOREST, background(spark, sf), FEATURES)
    names = F.lit(list(FEATURES))
    long = vectors.select(ID, F.posexplode_outer("impacts").alias("position", "attribute_impact"))
    return rounded(
        long.select(ID, F.get(names, F.col("position")).alias("attribute_name"), "attribute_impact"), IMPACT_DIGITS
    )


def with_gaps(df: DataFrame) -> DataFrame:
    """Applications as a careless source gives them: null or NaN where a value is not known."""
    return df.withColumns(
        {
            "balance": F.when(F.col("balance") > 0, F.col("balance")),
            "debt": F.when(F.col("accounts") > 1, F.col("debt")),
            "employment": F.when(F.col("employment") > 0, F.col("employment")).otherwise(F.lit(float("nan"))),
        }
    )


@query
def shap_dirty_features(spark, sf):
    """Impacts of applications with gaps, which have none, against the rows of the background without gaps."""
    base = shap.background_counts(with_gaps(reference(spark, sf)), FOREST)
    vectors = shap.shap_vectors(with_gaps(apps(spark, sf)), FOREST, base, FEATURES, check_additivity=True)
    named = vectors.select(ID, "impacts", F.posexplode(F.lit(list(FEATURES))).alias("position", "attribute_name"))
    impact = F.get("impacts", F.col("position")).alias("attribute_impact")
    return rounded(named.select(ID, "attribute_name", impact), IMPACT_DIGITS)


@query
def shap_additivity(spark, sf):
    base = background(spark, sf)
    vectors = shap.shap_vectors(apps(spark, sf), FOREST, base, FEATURES)
    return rounded(
        vectors.select(
            ID,
            F.aggregate("impacts", F.lit(0.0), lambda a, v: a + v).alias("impact_sum"),
            (forest.margin(FOREST) - F.lit(base.expected_margin(FOREST))).alias("margin_gap"),
        ),
        IMPACT_DIGITS,
    )


@query
def unpivot_features(spark, sf):
    return six(impacts.unpivot_features(apps(spark, sf), FEATURES))


@query
def feature_impact(spark, sf):
    return rounded(impact_table(spark, sf), 6, average_attribute_value=MEAN_DIGITS)


@query
def impact_ranks(spark, sf):
    return impact_table(spark, sf).select(
        ID, "attribute_name", "ranked_impact_positive", "ranked_impact_negative", "ranked_impact_absolute"
    )


@query
def shap_impacts_joined(spark, sf):
    long = impact_table(spark, sf).select(ID, "attribute_name", "attribute_value", "attribute_impact")
    return rounded(impacts.rank_impacts(long, FEATURES, typical(spark, sf)), 6, average_attribute_value=MEAN_DIGITS)


@query
def value_vs_typical(spark, sf):
    return rounded(
        impact_table(spark, sf).select(ID, "attribute_name", "average_attribute_value", "value_vs_typical"), MEAN_DIGITS
    )


@query
def risk_vs_typical(spark, sf):
    return impact_table(spark, sf).select(ID, "attribute_name", "risk_vs_typical")


# Reasons and records


@query
def registry_table(spark, sf):
    means = impacts.background_means(reference(spark, sf), FEATURES)
    typical_rows = means.unpivot([], list(FEATURES), "feature_name", "typical_value")
    table = reg.registry_frame(spark, PRIORITY_REGISTRY).drop("metadata")
    return rounded(typical_rows.join(F.broadcast(table), "feature_name"), MEAN_DIGITS)


@query
def registry_enrich(spark, sf):
    return six(
        reg.enrich(impact_table(spark, sf), PRIORITY_REGISTRY).select(
            ID,
            "attribute_name",
            "display_name",
            "reason_code",
            "adverse_reason",
            "favorable_reason",
            "compliance_review_required",
            "business_priority",
        )
    )


@query
def reasons_adverse(spark, sf):
    return reason_rows(
        reasons.select_reasons(impact_table(spark, sf), "adverse", top_n="all", registry=PRIORITY_REGISTRY, ids=[ID])
    )


@query
def reasons_favorable(spark, sf):
    return reason_rows(
        reasons.select_reasons(impact_table(spark, sf), "favorable", top_n="all", registry=PRIORITY_REGISTRY)
    )


@query
def reasons_all(spark, sf):
    return reason_rows(
        reasons.select_reasons(impact_table(spark, sf), "all", top_n="all", minimum=0.05, registry=PRIORITY_REGISTRY)
    )


@query
def reasons_top_n(spark, sf):
    return reason_rows(reasons.select_reasons(impact_table(spark, sf), top_n=2, registry=PRIORITY_REGISTRY))


@query
def reasons_business_priority(spark, sf):
    return reason_rows(
        reasons.select_reasons(
            impact_table(spark, sf), "adverse", "business_priority", top_n=4, registry=PRIORITY_REGISTRY
        )
    )


@query
def reasons_absolute(spark, sf):
    return reason_rows(
        reasons.select_reasons(impact_table(spark, sf), "all", "absolute_impact", top_n=3, registry=PRIORITY_REGISTRY)
    )


@query
def reason_rank(spark, sf):
    rows = explained(spark, sf).withColumn(
        "reasons", reasons.reasons_in_row(F.col("contributions"), PRIORITY_REGISTRY, "adverse", "impact", 4, 0.0)
    )
    return impacts.expand(rows, [ID], "reasons").select(ID, "attribute_name", "reason_rank")


def explanation_summary(nested: DataFrame) -> DataFrame:
    """A flat view of nested records: scalars, and the names in their order."""
    return six(
        nested.select(
            ID,
            "default_probability",
            "decision",
            "requested_top_n",
            "total_adverse_factors",
            F.array_join(F.transform("adverse_action_reasons", lambda r: r["attribute_name"]), ",").alias("reasons"),
            F.size("all_feature_contributions").alias("contribution_count"),
            F.array_join(
                F.transform("all_feature_contributions", lambda c: c["ranked_impact_positive"].cast("string")), ","
            ).alias("contribution_ranks"),
            "compliance_review_required",
            F.size("compliance_flags").alias("flag_count"),
        )
    )


@query
def explain_batch_records(spark, sf):
    return explanation_summary(explanations(spark, sf))


QUERIES["explain_batch"] = QUERIES.pop("explain_batch_records")


@query
def explanation_records(spark, sf):
    """The same records from long tables, one row per reason."""
    scored = forest.score(apps(spark, sf), FOREST).select(ID, "ts", "default_probability")
    long = impact_table(spark, sf)
    chosen = reasons.select_reasons(long, registry=PRIORITY_REGISTRY, ids=[ID])
    nested = records.explanation_records(
        records.nest(scored, chosen, long), "default_probability", config.CLASSIFICATION_THRESHOLD, MODEL_VERSION
    )
    flat = nested.withColumnRenamed("compliance_review_required", "any_flag")
    return six(
        flat.select(
            ID, "decision", "total_adverse_factors", "any_flag", F.inline_outer("adverse_action_reasons")
        ).select(
            ID,
            "decision",
            "total_adverse_factors",
            "any_flag",
            "reason_rank",
            "attribute_name",
            "attribute_impact",
            "adverse_reason",
        )
    )


@query
def compliance_flags(spark, sf):
    flagged = explanations(spark, sf, direction="all", top_n="all").withColumnRenamed(
        "compliance_review_required", "any_flag"
    )
    return impacts.expand(flagged, [ID, "any_flag"], "compliance_flags")


# Publication, windows, alarms


@query
def metrics_long(spark, sf):
    made = perf.monitoring_tables(matched(spark, sf))
    return six(
        publish.metrics_long(made["performance_metrics"]).unionByName(publish.metrics_long(made["calibration_errors"]))
    )


@query
def report_metrics(spark, sf):
    versioned = report(spark, sf).withColumn("model_version", F.lit(MODEL_VERSION))
    return six(publish.metrics_long(versioned, config.PERFORMANCE_METRICS, keys=["model_version"]))


@query
def metric_dimensions(spark, sf):
    dims = publish.dimensions(MODEL_VERSION, ENVIRONMENT, {"Portfolio": "all"})
    long = publish.metrics_long(report(spark, sf), dims=dims)
    return long.select("metric_name", F.explode("dimensions").alias("dimension", "dimension_value"))


@query
def metric_batches(spark, sf):
    yearly = metrics.performance_report(segmented(spark, sf), config.CLASSIFICATION_THRESHOLD, keys=["segment"])
    names = config.MONITORING_METRICS + tuple(m for m in config.PERFORMANCE_METRICS if m[1] != "AveragePredictedPD")
    batches = publish.metric_batches(publish.metrics_long(yearly, names, keys=["segment"]), keys=["segment"])
    return publish.batch_counts(batches, ["segment"])


def request_events(spark: SparkSession, sf: str) -> DataFrame:
    """Every logged event is a request; errors count as failed ones."""
    log = event_log(spark, sf)
    requests = log.select("ts", F.lit("PredictionCount").alias("metric_name"), F.lit(1.0).alias("value"), F.lit("Count").alias("unit"))
    return requests.unionByName(windows.error_events(log))


@query
def metric_events(spark, sf):
    made = (
        windows.prediction_events(apps(spark, sf), PROBABILITY)
        .unionByName(windows.explanation_events(explanations(spark, sf)))
        .unionByName(windows.error_events(event_log(spark, sf)))
        .unionByName(windows.error_events(event_log(spark, sf), "ExplanationErrorCount"))
    )
    return six(made)


@query
def windowed_metrics(spark, sf):
    drifted = publish.psi_metrics(psi_run(spark, sf)).withColumn("ts", F.lit(RUN_DATE).cast("timestamp"))
    stream = (
        windows.prediction_events(apps(spark, sf), PROBABILITY)
        .unionByName(request_events(spark, sf))
        .unionByName(drifted)
    )
    return rounded(windows.metric_series(stream), 12)


@query
def alarm_errors(spark, sf):
    _, metric, period, statistic, limit = config.ALARMS[0]
    alarms = [config.ALARMS[0], ("prediction_errors_hourly", metric, 3600, statistic, limit)]
    return six(windows.alarm_states(request_events(spark, sf), alarms))


@query
def alarm_high_risk(spark, sf):
    stream = windows.prediction_events(apps(spark, sf), PROBABILITY)
    _, metric, period, statistic, _ = config.ALARMS[1]
    return six(windows.alarm_states(stream, [config.ALARMS[1], ("high_risk_pair", metric, period, statistic, 2.0)]))


@query
def model_info(spark, sf):
    path = training.write_model_info(
        spark, staging_path(spark, "model-info"), "pd_forest", MODEL_VERSION, "tree ensemble", dt.date(2001, 12, 31), FEATURES
    )
    joined = training.with_model_info(
        report(spark, sf).withColumn("model_version", F.lit(MODEL_VERSION)), training.read_model_info(spark, path)
    )
    return six(
        joined.select(
            "model_version",
            "model_name",
            "algorithm",
            "training_date",
            F.array_join("features", ",").alias("features"),
            "record_count",
            "auc",
        )
    )


# Streaming


@query
def stream_windowed_metrics(spark, sf):
    schema = src.table(spark, sf, "events").schema
    events = stream_scoring.follow_parquet(spark, f"{sf}/events.parquet", schema)
    errors = windows.error_events(events)
    path = staging_path(spark, "windows")
    closed = stream_windows.windowed_stream(errors, 3600, "10 minutes")
    stream_windows.write_windows(closed, path, path + "-checkpoint").awaitTermination()
    return six(spark.read.schema(closed.schema).parquet(path))


@query
def stream_alarms(spark, sf):
    schema = src.table(spark, sf, "events").schema
    errors = windows.error_events(stream_scoring.follow_parquet(spark, f"{sf}/events.parquet", schema))
    name, metric, _, statistic, limit = config.ALARMS[0]
    closed = stream_windows.windowed_stream(errors, 3600, "10 minutes")
    states = stream_windows.alarm_stream(closed, name, metric, statistic, limit)
    path = staging_path(spark, "alarms")
    stream_windows.write_windows(states, path, path + "-checkpoint").awaitTermination()
    return six(spark.read.schema(states.schema).parquet(path))


@query
def stream_alarm_transitions(spark, sf):
    """Changes of the error alarm between hours."""
    schema = src.table(spark, sf, "events").schema
    errors = windows.error_events(stream_scoring.follow_parquet(spark, f"{sf}/events.parquet", schema))
    name, metric, _, statistic, limit = config.ALARMS[0]
    closed = stream_windows.windowed_stream(errors, 3600, "10 minutes")
    alarms = stream_windows.alarm_stream(closed, name, metric, statistic, limit)
    table = staging_path(spark, "alarms")
    stream_windows.write_windows(alarms, table, table + "-checkpoint").awaitTermination()
    changes = stream_windows.alarm_transitions(stream_scoring.follow_parquet(spark, table, alarms.schema), 3600)
    path = staging_path(spark, "transitions")
    stream_windows.write_windows(changes, path, path + "-checkpoint").awaitTermination()
    return spark.read.schema(changes.schema).parquet(path)


@query
def stream_join_outcomes(spark, sf):
    """Predictions and labels as streams. A label is dated 0 to 399 days after its application; 300 days are in time."""
    a = apps(spark, sf)
    waited = F.make_dt_interval(F.col(ID).cast("bigint") % 400)
    scored = a.select(ID, PROBABILITY, F.col("ts").alias("predicted_at"))
    labels = a.where("matured").select(ID, ACTUAL, (F.col("ts") + waited).alias("labelled_at"))
    sides = []
    for name, side in {"predictions": scored, "labels": labels}.items():
        folder = staging_path(spark, name)
        side.write.parquet(folder)
        sides.append(stream_scoring.follow_parquet(spark, folder, side.schema))
    matched = stream_outcomes.matured_stream(*sides, maturity="300 days", delay="10 days")
    path = staging_path(spark, "matured")
    stream_windows.write_windows(matched, path, path + "-checkpoint").awaitTermination()
    return six(spark.read.schema(matched.schema).parquet(path).select(ID, PROBABILITY, ACTUAL, "labelled_at"))


@query
def stream_scores(spark, sf):
    def write() -> str:
        return tables.write_table(
            apps(spark, sf).select(ID, F.date_trunc("month", "ts").alias("ts"), *FEATURES), staging_path(spark, "incoming")
        )

    incoming = keep(spark, sf, "incoming", write)
    stream = stream_scoring.follow_parquet(spark, incoming, spark.read.parquet(incoming).schema)
    scored = stream_scoring.scored_stream(stream, FOREST).select(ID, "ts", "default_probability")
    path = staging_path(spark, "scored")
    stream_scoring.append_by_date(scored, path, path + "-checkpoint").awaitTermination()
    return six(spark.read.parquet(path).select(ID, "default_probability", F.col("dt").cast("string").alias("dt")))


# Trained model


def trained(spark: SparkSession, sf: str) -> tuple[training.PipelineModel, str]:
    """The boosted trees fitted on labelled applications, and where their node table was saved."""

    def fit() -> tuple[training.PipelineModel, str]:
        model = training.train(training.split(apps(spark, sf).where("matured"))[0])
        path = staging_path(spark, "booster")
        model.stages[-1].write().save(path)
        return model, path

    return keep(spark, sf, "booster", fit)


@query
def train_gbt(spark, sf):
    """Rows and defaults of either part, and whether the test rows are ranked well."""
    model, _ = trained(spark, sf)
    parts = training.split(apps(spark, sf).where("matured"))
    scored = training.scorer(model, "score")(parts[1]).select(F.col("score").alias(PROBABILITY), ACTUAL)
    made = metrics.performance_report(settle(scored, "test-scores"), 0.5)
    fitted = metrics.class_counts(parts[0].select(PROBABILITY, ACTUAL)).first()
    return made.select(
        F.lit(fitted["record_count"]).alias("training_count"),
        F.lit(fitted["default_count"]).alias("training_default_count"),
        F.col("record_count").alias("test_count"),
        F.col("default_count").alias("test_default_count"),
        (F.col("auc") >= GBT_AUC).alias("ranks_well"),
    )


@query
def gbt_score(spark, sf):
    """Whether the saved node table gives the score of the fitted model, for each application."""
    model, path = trained(spark, sf)
    booster = forest.forest_from_gbt(spark, path, FEATURES)
    scored = forest.score(training.scorer(model)(apps(spark, sf)), booster, "table_probability")
    gap = F.abs(F.col("table_probability") - F.col("default_probability"))
    return scored.select(ID, (gap < GBT_GAP).alias("scores_agree"))


@query
def gbt_shap_additivity(spark, sf):
    """Impacts of the fitted trees sum to the log-odds of the fitted model, less the background's mean."""
    model, path = trained(spark, sf)
    booster = forest.forest_from_gbt(spark, path, FEATURES)
    base = shap.background_counts(reference(spark, sf), booster)
    scored = training.scorer(model)(apps(spark, sf))
    vectors = shap.shap_vectors(scored, booster, base, FEATURES)
    p = F.col("default_probability")
    total = F.aggregate("impacts", F.lit(0.0), lambda a, v: a + v)
    gap = F.abs(F.ln(p / (1.0 - p)) - F.lit(base.expected_margin(booster)) - total)
    return vectors.select(ID, (gap < GBT_GAP).alias("adds_up"))
