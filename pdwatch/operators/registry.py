"""Feature registry: display names, reason texts and review flags, as a small dimension table.

A registry is a plain dict of name -> Entry in registration order; `registry_frame` makes it a
DataFrame and `enrich` joins it to impacts.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdwatch.config import DEFAULT_BUSINESS_PRIORITY
from pdwatch.operators.checks import require_columns, require_text

BROADCAST_LIMIT = 10_000

SCHEMA = T.StructType(
    [
        T.StructField("feature_name", T.StringType(), False),
        T.StructField("display_name", T.StringType(), False),
        T.StructField("reason_code", T.StringType()),
        T.StructField("adverse_reason", T.StringType()),
        T.StructField("favorable_reason", T.StringType()),
        T.StructField("compliance_review_required", T.BooleanType(), False),
        T.StructField("business_priority", T.IntegerType(), False),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


class Entry(NamedTuple):
    feature_name: str
    display_name: str
    reason_code: str | None = None
    adverse_reason: str | None = None
    favorable_reason: str | None = None
    compliance_review_required: bool = False
    metadata: dict | None = None

    @property
    def business_priority(self) -> int:
        """Lower comes first; a feature without a priority comes last."""
        raw = (self.metadata or {}).get("business_priority")
        if raw is None:
            return DEFAULT_BUSINESS_PRIORITY
        try:
            return int(raw)
        except (TypeError, ValueError):
            raise ValueError(f"business_priority of {self.feature_name} must be an integer") from None


Registry = dict[str, Entry]


def with_entry(registry: Mapping[str, Entry], entry: Entry, overwrite: bool = False) -> Registry:
    name = require_text(entry.feature_name, "feature_name").strip()
    if name in registry and not overwrite:
        raise ValueError(f"{name} is in the registry already")
    return {**registry, name: entry}


def registry_from(config: Mapping[str, Mapping]) -> Registry:
    """A registry from name -> settings; the display name defaults to the feature's own name."""
    registry: Registry = {}
    for name, settings in config.items():
        registry = with_entry(registry, Entry(**{"display_name": name, **settings, "feature_name": name}))
    return registry


def registry_frame(spark: SparkSession, registry: Mapping[str, Entry]) -> DataFrame:
    def row(name: str, e: Entry) -> tuple:
        metadata = {str(k): str(v) for k, v in e.metadata.items()} if e.metadata else None
        return (
            name,
            e.display_name,
            e.reason_code,
            e.adverse_reason,
            e.favorable_reason,
            bool(e.compliance_review_required),
            e.business_priority,
            metadata,
        )

    return spark.createDataFrame([row(n, e) for n, e in registry.items()], SCHEMA)


def registry_map(registry: Mapping[str, Entry] | None) -> Column:
    """The registry as one constant: a map from feature name to its settings."""

    def text(value: str | None) -> str:
        if value is None:
            return "CAST(NULL AS STRING)"
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def pair(name: str, e: Entry) -> str:
        return f"""{text(name)}, named_struct('display_name', {text(e.display_name)}, 'reason_code', {text(e.reason_code)},
            'adverse_reason', {text(e.adverse_reason)}, 'favorable_reason', {text(e.favorable_reason)},
            'compliance_review_required', {str(bool(e.compliance_review_required)).lower()},
            'business_priority', {e.business_priority})"""

    # an entry under a name no feature can have keeps the type when the registry is empty
    entries = {"": Entry("", "")} | dict(registry or {})
    return F.expr(f"map({', '.join(pair(n, e) for n, e in entries.items())})")


def enrich(impacts: DataFrame, registry: Mapping[str, Entry] | None) -> DataFrame:
    """Left lookup by attribute name; an unregistered feature keeps its own name and defaults."""
    require_columns(impacts, ["attribute_name"])
    table = registry_frame(impacts.sparkSession, registry or {}).drop("metadata")
    if len(registry or {}) <= BROADCAST_LIMIT:
        table = F.broadcast(table)
    joined = impacts.join(table.withColumnRenamed("feature_name", "attribute_name"), "attribute_name", "left")
    return joined.select(
        *[impacts[c] if c != "attribute_name" else F.col("attribute_name") for c in impacts.columns],
        F.coalesce("display_name", "attribute_name").alias("display_name"),
        "reason_code",
        "adverse_reason",
        "favorable_reason",
        F.coalesce("compliance_review_required", F.lit(False)).alias("compliance_review_required"),
        F.coalesce("business_priority", F.lit(DEFAULT_BUSINESS_PRIORITY)).alias("business_priority"),
    )


# The registry of the current model.
DEFAULT_REGISTRY = registry_from(
    {
        "income": {
            "display_name": "Income",
            "reason_code": "INCOME_LEVEL",
            "adverse_reason": "Income level increased the modeled risk",
            "favorable_reason": "Income level reduced the modeled risk",
        },
        "fico": {
            "display_name": "Credit score",
            "reason_code": "CREDIT_SCORE",
            "adverse_reason": "Credit score increased the modeled risk",
            "favorable_reason": "Credit score reduced the modeled risk",
        },
        "loan_amount": {
            "display_name": "Requested loan amount",
            "reason_code": "REQUESTED_LOAN_AMOUNT",
            "adverse_reason": "Requested loan amount increased the modeled risk",
            "favorable_reason": "Requested loan amount reduced the modeled risk",
        },
        "age": {
            "display_name": "Age",
            "reason_code": "AGE_REVIEW",
            "adverse_reason": "Age-related information increased the modeled risk",
            "favorable_reason": "Age-related information reduced the modeled risk",
            "compliance_review_required": True,
        },
        "debt": {
            "display_name": "Existing debt",
            "reason_code": "EXISTING_DEBT",
            "adverse_reason": "Existing debt increased the modeled risk",
            "favorable_reason": "Existing debt reduced the modeled risk",
        },
        "employment": {
            "display_name": "Employment history",
            "reason_code": "EMPLOYMENT_HISTORY",
            "adverse_reason": "Employment history increased the modeled risk",
            "favorable_reason": "Employment history reduced the modeled risk",
        },
        "balance": {
            "display_name": "Account balance",
            "reason_code": "ACCOUNT_BALANCE",
            "adverse_reason": "Account balance increased the modeled risk",
            "favorable_reason": "Account balance reduced the modeled risk",
        },
        "utilization": {
            "display_name": "Credit utilization",
            "reason_code": "CREDIT_UTILIZATION",
            "adverse_reason": "Credit utilization increased the modeled risk",
            "favorable_reason": "Credit utilization reduced the modeled risk",
        },
        "accounts": {
            "display_name": "Number of credit accounts",
            "reason_code": "CREDIT_ACCOUNT_COUNT",
            "adverse_reason": "Credit account count increased the modeled risk",
            "favorable_reason": "Credit account count reduced the modeled risk",
        },
        "history": {
            "display_name": "Credit history length",
            "reason_code": "CREDIT_HISTORY_LENGTH",
            "adverse_reason": "Credit history length increased the modeled risk",
            "favorable_reason": "Credit history length reduced the modeled risk",
        },
    }
)
