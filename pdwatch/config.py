"""Default thresholds. Every one is a default of some parameter, never read inside an operator."""

from __future__ import annotations

# Fixed values.
CLASSIFICATION_THRESHOLD = 0.50
HIGH_RISK_THRESHOLD = 0.75
MINIMUM_SAMPLES = 100
BACKGROUND_SAMPLE_SIZE = 500
BACKGROUND_SEED = 42
METRICS_PER_REQUEST = 20
PSI_BINS = 10
PSI_WARNING = 0.10
PSI_ALERT = 0.25
PREDICTION_DRIFT_ALERT = 0.10
DEFAULT_BUSINESS_PRIORITY = 1_000_000

# Upper edges of the production PD buckets; the last bucket is open.
PD_BUCKETS = (("low", 0.05), ("medium", 0.10), ("high", 0.20), ("very_high", None))

# Fixed values: (report column, direction that is bad, warning level, alert level).
STATUS_RULES = (
    ("auc", "below", 0.70, 0.60),
    ("ks", "below", 0.30, 0.20),
    ("calibration_error", "above", 0.05, 0.10),
    ("bad_rate", "above", 0.15, 0.25),
)

# Report column -> published metric name and unit, for the monitoring namespace.
MONITORING_METRICS = (
    ("auc", "AUC", "None"),
    ("ks", "KS", "None"),
    ("gini", "Gini", "None"),
    ("bad_rate", "BadRate", "None"),
    ("average_predicted_pd", "AveragePredictedPD", "None"),
    ("accuracy", "Accuracy", "None"),
    ("balanced_accuracy", "BalancedAccuracy", "None"),
    ("precision", "Precision", "None"),
    ("recall", "Recall", "None"),
    ("specificity", "Specificity", "None"),
    ("f1", "F1", "None"),
    ("brier_score", "BrierScore", "None"),
    ("log_loss", "LogLoss", "None"),
    ("record_count", "RecordCount", "Count"),
    ("default_count", "DefaultCount", "Count"),
    ("expected_calibration_error", "ExpectedCalibrationError", "None"),
    ("maximum_calibration_error", "MaximumCalibrationError", "None"),
)

# The same for the performance job's own publication.
PERFORMANCE_METRICS = (
    ("auc", "ModelAUC", "None"),
    ("ks", "ModelKS", "None"),
    ("gini", "ModelGini", "None"),
    ("bad_rate", "ObservedBadRate", "None"),
    ("average_predicted_pd", "AveragePredictedPD", "None"),
    ("precision", "ModelPrecision", "None"),
    ("recall", "ModelRecall", "None"),
    ("calibration_error", "CalibrationError", "None"),
    ("record_count", "PerformanceRecordCount", "Count"),
    ("default_count", "PerformanceDefaultCount", "Count"),
    ("non_default_count", "PerformanceNonDefaultCount", "Count"),
)

# Alarms as (alarm, metric, period in seconds, statistic, threshold); breached at >=.
ALARMS = (
    ("prediction_errors", "PredictionErrorCount", 300, "Sum", 5.0),
    ("high_risk_spike", "HighRiskPredictionCount", 3600, "Sum", 100.0),
)

# Dashboard series as (metric, period in seconds, statistic).
DASHBOARD_SERIES = (
    ("PredictionCount", 300, "Sum"),
    ("DefaultProbability", 300, "Average"),
    ("HighRiskPredictionCount", 300, "Sum"),
    ("HighRiskPredictionCount", 300, "Average"),
    ("PredictionErrorCount", 300, "Sum"),
    ("FeaturePSI", 86400, "Average"),
)
