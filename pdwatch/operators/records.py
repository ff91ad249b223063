"""Nested explanation records: one row per application with its reasons, contributions and flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.functions.expressions import decision
from pdwatch.operators.checks import require_columns, require_text, require_top_n, require_unit_interval
from pdwatch.schemas import ID, IMPACT_COLUMNS, REASON_FIELDS

REVIEW_MESSAGE = "Feature contribution requires compliance review"


def compliance_flags(reasons: Column) -> Column:
    """The reasons that need a review, as an array of structs."""
    return F.transform(
        F.filter(reasons, lambda r: r["compliance_review_required"]),
        lambda r: F.struct(
            r["attribute_name"].alias("attribute_name"),
            r["display_name"].alias("display_name"),
            r["reason_code"].alias("reason_code"),
            F.lit(REVIEW_MESSAGE).alias("message"),
        ),
    )


def explanation_records(
    df: DataFrame,
    probability: str,
    threshold: float,
    model_version: str,
    top_n: int | str = 4,
    direction: str = "adverse",
    timestamp: str = "ts",
    metadata: Mapping[str, str] | None = None,
) -> DataFrame:
    """Records from rows that carry `reasons` and `contributions` arrays.

    A row may bring its own `prediction_id` or `decision`. A missing id is derived from application,
    time and model, so that a task that runs twice writes the same id. The reasons keep their field
    name in every direction; `direction` says which one it is.
    """
    require_columns(df, [ID, probability, timestamp, "reasons", "contributions"])
    require_unit_interval(threshold, "decision threshold")
    require_text(model_version, "model_version")
    require_top_n(top_n)
    own_id = F.sha2(F.concat_ws("|", F.col(ID), F.col(timestamp).cast("string"), F.lit(model_version)), 256)
    given_id = F.col("prediction_id") if "prediction_id" in df.columns else F.lit(None).cast("string")
    given_decision = F.col("decision") if "decision" in df.columns else F.lit(None).cast("string")
    reasons = F.transform("reasons", lambda r: F.struct(*[r[f].alias(f) for f in REASON_FIELDS]))
    contributions = F.transform("contributions", lambda c: F.struct(*[c[f].alias(f) for f in IMPACT_COLUMNS]))
    extra = (
        F.create_map(*[F.lit(str(x)) for pair in metadata.items() for x in pair])
        if metadata
        else F.lit(None).cast("map<string,string>")
    )
    return df.select(
        F.coalesce(given_id, own_id).alias("prediction_id"),
        ID,
        F.col(timestamp).cast("timestamp").alias("prediction_timestamp"),
        F.lit(model_version).alias("model_version"),
        F.col(probability).alias("default_probability"),
        F.lit(float(threshold)).alias("decision_threshold"),
        F.coalesce(given_decision, decision(F.col(probability), threshold)).alias("decision"),
        F.lit(str(top_n)).alias("requested_top_n"),
        F.size("reasons").alias("total_adverse_factors"),
        reasons.alias("adverse_action_reasons"),
        contributions.alias("all_feature_contributions"),
        F.exists("reasons", lambda r: r["compliance_review_required"]).alias("compliance_review_required"),
        compliance_flags(F.col("reasons")).alias("compliance_flags"),
        extra.alias("additional_metadata"),
        F.lit(direction).alias("direction"),
    )


def nest(scored: DataFrame, reasons: DataFrame, contributions: DataFrame) -> DataFrame:
    """Attach long reasons and contributions to their applications as sorted arrays.

    An application without reasons keeps an empty array. The three tables meet on the identifier;
    a group is as long as the list of features.
    """

    def gathered(long: DataFrame, order: str, fields, name: str) -> DataFrame:
        names = list(dict.fromkeys([order, *fields]))
        require_columns(long, [ID, *names])
        return long.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct(*names))).alias(name))

    reason_fields = [c for c in reasons.columns if c != ID]
    nested = scored.join(gathered(reasons, "reason_rank", reason_fields, "reasons"), ID, "left").join(
        gathered(contributions, "ranked_impact_positive", IMPACT_COLUMNS, "contributions"), ID, "left"
    )
    return nested.withColumns({n: F.coalesce(F.col(n), F.array()) for n in ("reasons", "contributions")})
