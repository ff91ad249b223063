import pytest
from pyspark.sql import functions as F

from pdwatch.operators import quality as Q
from pdwatch.operators.joins import join_outcomes, match_outcomes
from pdwatch.plans.performance import run_performance
from pdwatch.schemas import FEATURES

PREDICTIONS = [("app-001", 0.10), ("app-002", 0.30), ("app-003", 0.70), ("app-004", 0.90)]
OUTCOMES = [("app-001", 0), ("app-002", 0), ("app-003", 1), ("app-004", 1)]


def predictions(spark, rows=PREDICTIONS):
    return spark.createDataFrame(rows, "application_id string, predicted_probability double")


def outcomes(spark, rows=OUTCOMES):
    return spark.createDataFrame(rows, "application_id string, actual_default int")


def broken(frame):
    return {r["rule"]: r["violations"] for r in frame.collect() if r["violations"]}


@pytest.mark.parametrize(
    "rows, expected",
    [
        (PREDICTIONS, {}),
        ([], {"not_empty": 1}),
        ([(None, 0.1), ("a", 0.2)], {"id_not_null": 1}),
        ([("a", 0.1), ("a", 0.2), ("a", 0.3)], {"id_unique": 2}),
        ([("a", None), ("b", float("nan"))], {"probability_not_null": 2}),
        ([("a", -0.1), ("b", 1.1), ("c", 1.0)], {"probability_in_range": 2}),
    ],
)
def test_prediction_rules(spark, rows, expected):
    assert broken(Q.check_predictions(predictions(spark, rows))) == expected


@pytest.mark.parametrize(
    "rows, expected",
    [(OUTCOMES, {}), ([("a", None)], {"actual_not_null": 1}), ([("a", 2), ("a", 1)], {"id_unique": 1, "actual_binary": 1})],
)
def test_outcome_rules(spark, rows, expected):
    assert broken(Q.check_outcomes(outcomes(spark, rows))) == expected


def test_first_broken_rule_is_raised(spark):
    with pytest.raises(Q.QualityError, match="id_unique: 1"):
        Q.enforce(Q.check_outcomes(outcomes(spark, [("a", 2), ("a", 1)])))


def test_both_classes(spark):
    one_class = predictions(spark).withColumn("actual_default", F.lit(0))
    assert broken(Q.check_scored_labels(one_class)) == {"both_classes_present": 1}
    assert broken(Q.check_scored_labels(one_class, both_classes=False)) == {}


def test_identifier_and_background_rules(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 2, 3.0)], "k string, d int, x double")
    assert broken(Q.check_identifiers(df, ["k", "d"])) == {"identifiers_unique": 1}
    assert broken(Q.check_background(df, ["x", "d"])) == {"x_not_null": 1}
    for names in ([], ["x", "x"], [" "]):
        with pytest.raises(ValueError):
            Q.check_background(df, names)
    with pytest.raises(ValueError, match="missing columns"):
        Q.check_background(df, ["z"])


def test_request_split(spark):
    good = dict(
        income=90000.0, fico=750.0, loan_amount=10000.0, age=45.0, debt=5000.0,
        employment=10.0, balance=15000.0, utilization=0.15, accounts=8.0, history=15.0,
    )
    changes = [{}, {"fico": 950.0}, {"income": -50000.0}, {"utilization": 1.5, "age": 17.0}, {"income": 0.0}, {"debt": None}]
    rows = [(str(i), *[{**good, **c}[f] for f in FEATURES]) for i, c in enumerate(changes)] + [("", *good.values())]
    df = spark.createDataFrame(rows, "application_id string, " + ", ".join(f"{f} double" for f in FEATURES))
    accepted, rejected = Q.split_requests(df, id_column="application_id")
    assert [r["application_id"] for r in accepted.collect()] == ["0"]
    assert {r["application_id"]: r["violated_rules"] for r in rejected.collect()} == {
        "1": ["fico_range"],
        "2": ["income_range"],
        "3": ["age_range", "utilization_range"],
        "4": ["income_range"],
        "5": ["debt_range"],
        "": ["application_id_present"],
    }


def test_join(spark):
    p = predictions(spark)
    joined = join_outcomes(p, outcomes(spark, OUTCOMES[1:] + [("app-009", 1)]).withColumn("extra", F.lit(1)), validate=True)
    assert joined.columns == ["application_id", "predicted_probability", "actual_default"]
    assert sorted(r["application_id"] for r in joined.collect()) == ["app-002", "app-003", "app-004"]
    with pytest.raises(Q.QualityError, match="no prediction"):
        join_outcomes(p, outcomes(spark, [("zzz", 1)]), validate=True)


def test_join_counts_violations_of_both_sides(spark):
    p = predictions(spark, [("a", 0.1), ("a", 0.2), (None, 0.3), ("b", None), ("c", 1.5), ("d", 0.4)])
    o = outcomes(spark, [("a", 1), ("d", 2), ("e", 0), (None, 1), ("c", None)])
    match = match_outcomes(p, o)
    assert {rule: n for rule, n in match.violations.items() if n} == {
        "predictions_id_not_null": 1,
        "predictions_id_unique": 1,
        "predictions_probability_not_null": 1,
        "predictions_probability_in_range": 1,
        "outcomes_id_not_null": 1,
        "outcomes_actual_not_null": 1,
        "outcomes_actual_binary": 1,
    }
    with pytest.raises(Q.QualityError, match="predictions_id_not_null: 1"):
        join_outcomes(p, o)
    assert join_outcomes(p, o, validate=False).count() == 4
    with pytest.raises(Q.QualityError, match="predictions_not_empty"):
        join_outcomes(p.limit(0), o.limit(0))
    twice = outcomes(spark, [("app-001", 1), ("app-001", 1)])
    with pytest.raises(Q.QualityError, match="outcomes_id_unique: 1"):
        join_outcomes(predictions(spark), twice)


def test_integer_and_string_identifiers_meet(spark):
    p = spark.createDataFrame([(1001, 0.2)], "application_id long, predicted_probability double")
    assert join_outcomes(p, outcomes(spark, [("1001", 1)])).count() == 1


def test_performance_job(spark):
    args = ("2026-07-30", "p", "o", "v1")
    with pytest.raises(Q.QualityError, match="4 rows found, 100 needed"):
        run_performance(predictions(spark), outcomes(spark), *args)
    row = run_performance(predictions(spark), outcomes(spark), *args, minimum=4).first()
    assert row["auc"] == 1.0 and row["matched_sample_size"] == 4 and row["monitoring_type"] == "model_performance"
    with pytest.raises(ValueError, match="minimum sample size"):
        Q.sample_gate(predictions(spark), 0)
