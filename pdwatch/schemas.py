"""Column contracts: feature order, request constraints, table layouts."""

from __future__ import annotations

from pyspark.sql import types as T

# The model's features in contractual order, and the range each must lie in.
FEATURES = (
    "income",
    "fico",
    "loan_amount",
    "age",
    "debt",
    "employment",
    "balance",
    "utilization",
    "accounts",
    "history",
)

# (feature, lower bound, lower bound inclusive, upper bound); None means unbounded.
FEATURE_RANGES = (
    ("income", 0.0, False, None),
    ("fico", 300.0, True, 850.0),
    ("loan_amount", 0.0, False, None),
    ("age", 18.0, True, 100.0),
    ("debt", 0.0, True, None),
    ("employment", 0.0, True, None),
    ("balance", 0.0, True, None),
    ("utilization", 0.0, True, 1.0),
    ("accounts", 0.0, True, None),
    ("history", 0.0, True, None),
)

SUMMARY_FEATURES = ("fico", "income", "loan_amount", "utilization")

# The columns every impact table carries besides its identifiers.
IMPACT_COLUMNS = (
    "attribute_name",
    "attribute_value",
    "average_attribute_value",
    "attribute_impact",
    "absolute_impact",
    "ranked_impact_positive",
    "ranked_impact_negative",
    "ranked_impact_absolute",
    "risk_vs_typical",
    "value_vs_typical",
)

# The fields of one reason inside an explanation record.
REASON_FIELDS = (
    "reason_rank",
    "attribute_name",
    "display_name",
    "attribute_value",
    "average_attribute_value",
    "attribute_impact",
    "absolute_impact",
    "risk_vs_typical",
    "value_vs_typical",
    "reason_code",
    "adverse_reason",
    "compliance_review_required",
)

ID = "application_id"
ACTUAL = "actual_default"
PROBABILITY = "predicted_probability"

FEATURES_SCHEMA = T.StructType(
    [T.StructField(ID, T.StringType())] + [T.StructField(f, T.DoubleType()) for f in FEATURES]
)

PREDICTIONS_SCHEMA = T.StructType(
    [T.StructField(ID, T.StringType()), T.StructField(PROBABILITY, T.DoubleType())]
)

OUTCOMES_SCHEMA = T.StructType(
    [T.StructField(ID, T.StringType()), T.StructField(ACTUAL, T.IntegerType())]
)

CALIBRATION_SCHEMA = T.StructType(
    [
        T.StructField("calibration_band", T.LongType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("default_count", T.LongType()),
        T.StructField("minimum_predicted_pd", T.DoubleType()),
        T.StructField("maximum_predicted_pd", T.DoubleType()),
        T.StructField("average_predicted_pd", T.DoubleType()),
        T.StructField("actual_default_rate", T.DoubleType()),
        T.StructField("population_percentage", T.DoubleType()),
        T.StructField("calibration_gap", T.DoubleType()),
        T.StructField("absolute_calibration_gap", T.DoubleType()),
    ]
)
