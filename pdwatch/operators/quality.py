"""Data-quality rules as violation counts.

Every check returns one row per rule, in rule order: (rule_order, rule, violations). `enforce`
raises on the first broken rule. Counting is one aggregate; uniqueness adds one shuffle of the
identifier with partial counts, so a repeated identifier is combined before it moves.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.operators.checks import require_columns, require_count, require_names, require_numeric
from pdwatch.schemas import ACTUAL, FEATURE_RANGES, ID, IMPACT_COLUMNS, PROBABILITY


class QualityError(ValueError):
    """A data-quality rule was broken."""


def absent(column: Column) -> Column:
    """Null or NaN: a double without a usable value."""
    return column.isNull() | F.isnan(column)


def _rows(summary: DataFrame, rules: Sequence[str]) -> DataFrame:
    """One-row summary to one row per rule."""
    entries = [
        F.struct(F.lit(i).alias("rule_order"), F.lit(r).alias("rule"), F.col(r).cast("long").alias("violations"))
        for i, r in enumerate(rules, 1)
    ]
    return summary.select(F.inline(F.array(*entries)))


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def enforce(violations: DataFrame) -> None:
    """Raise on the broken rule that comes first. Reads one row per rule."""
    for row in sorted(violations.where("violations > 0").collect(), key=lambda r: r["rule_order"]):
        raise QualityError(f"{row['rule']}: {row['violations']} violations")


def keyed_checks(df: DataFrame, id_column: str, value_rules: Mapping[str, Column]) -> DataFrame:
    """Non-empty, identifier present and unique, then the given value rules."""
    per_id = df.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("__rows"), *[_count(c).alias(r) for r, c in value_rules.items()]
    )
    missing = F.col(id_column).isNull()
    summary = per_id.agg(
        F.when(F.coalesce(F.sum("__rows"), F.lit(0)) == 0, 1).otherwise(0).alias("not_empty"),
        F.coalesce(F.sum(F.when(missing, F.col("__rows"))), F.lit(0)).alias("id_not_null"),
        F.coalesce(F.sum(F.when(~missing, F.col("__rows") - 1)), F.lit(0)).alias("id_unique"),
        *[F.coalesce(F.sum(r), F.lit(0)).alias(r) for r in value_rules],
    )
    return _rows(summary, ["not_empty", "id_not_null", "id_unique", *value_rules])


def probability_rules(probability: str) -> dict[str, Column]:
    p = F.col(probability).cast("double")
    return {
        "probability_not_null": absent(p),
        "probability_in_range": ~absent(p) & ~p.between(0.0, 1.0),
    }


def label_rules(actual: str) -> dict[str, Column]:
    y = F.col(actual).cast("double")
    return {"actual_not_null": absent(y), "actual_binary": ~absent(y) & ~y.isin(0.0, 1.0)}


def check_predictions(df: DataFrame, id_column: str = ID, probability: str = PROBABILITY) -> DataFrame:
    require_columns(df, [id_column, probability])
    return keyed_checks(df, id_column, probability_rules(probability))


def check_outcomes(df: DataFrame, id_column: str = ID, actual: str = ACTUAL) -> DataFrame:
    require_columns(df, [id_column, actual])
    return keyed_checks(df, id_column, label_rules(actual))


def check_scored_labels(
    df: DataFrame, actual: str = ACTUAL, probability: str = PROBABILITY, both_classes: bool = True
) -> DataFrame:
    """Rules for metrics over labelled scores; calibration does without the both-classes rule."""
    require_columns(df, [actual, probability])
    rules = {**label_rules(actual), **probability_rules(probability)}
    y = F.col(actual).cast("double")
    summary = df.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("not_empty"),
        *[_count(c).alias(r) for r, c in rules.items()],
        F.when((_count(y == 0.0) > 0) & (_count(y == 1.0) > 0), 0).otherwise(1).alias("both_classes_present"),
    )
    names = ["not_empty", *rules] + (["both_classes_present"] if both_classes else [])
    return _rows(summary, names)


def check_scores(df: DataFrame, probability: str = PROBABILITY) -> DataFrame:
    """A scorer's output lies in [0, 1] and is never missing."""
    require_columns(df, [probability])
    rules = probability_rules(probability)
    return _rows(df.agg(*[_count(c).alias(r) for r, c in rules.items()]), list(rules))


def check_background(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """A background population: not empty, and no missing value in any feature."""
    names = require_names(features, "features")
    require_columns(df, names)
    require_numeric(df, names)
    rules = {f"{n}_not_null": absent(F.col(n).cast("double")) for n in sorted(names)}
    summary = df.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("not_empty"), *[_count(c).alias(r) for r, c in rules.items()]
    )
    return _rows(summary, ["not_empty", *rules])


def check_identifiers(df: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """The combination of identifiers names each row once."""
    names = require_names(id_columns, "identifier columns")
    require_columns(df, names)
    sizes = df.groupBy(*names).agg(F.count(F.lit(1)).alias("__rows"))
    summary = sizes.agg(
        F.when(F.coalesce(F.sum("__rows"), F.lit(0)) == 0, 1).otherwise(0).alias("not_empty"),
        F.coalesce(F.sum(F.col("__rows") - 1), F.lit(0)).alias("identifiers_unique"),
    )
    return _rows(summary, ["not_empty", "identifiers_unique"])


def check_impacts(df: DataFrame, id_columns: Sequence[str], features: Sequence[str]) -> DataFrame:
    """An impact table: not empty, impacts present, every identifier with every feature once."""
    require_columns(df, [*id_columns, *IMPACT_COLUMNS])
    name = F.col("attribute_name")
    # One group an identifier: counts by feature are columns. Rows without a name count as a feature of their own.
    cells = {f"__cell_{i}": name == f for i, f in enumerate(dict.fromkeys(features))} | {"__cell_null": name.isNull()}
    counted = df.groupBy(*id_columns).agg(
        _count(absent(F.col("attribute_impact"))).alias("missing"),
        _count(~name.isin(*features)).alias("unknown"),
        *[_count(cell).alias(n) for n, cell in cells.items()],
    )
    per_id = counted.select(
        "missing",
        "unknown",
        sum((F.when(F.col(n) > 0, 1).otherwise(0) for n in cells), F.lit(0)).alias("present"),
        sum((F.greatest(F.col(n) - 1, F.lit(0)) for n in cells), F.lit(0)).alias("repeated"),
    )
    summary = per_id.agg(
        F.when(F.count(F.lit(1)) == 0, 1).otherwise(0).alias("not_empty"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(n)
            for n, c in {
                "impact_not_null": F.col("missing"),
                "feature_known": F.col("unknown"),
                "feature_repeated": F.col("repeated"),
                "feature_missing": F.lit(len(features)) - F.col("present"),
            }.items()
        ],
    )
    return _rows(summary, ["not_empty", "impact_not_null", "feature_known", "feature_repeated", "feature_missing"])


def range_violations(ranges: Sequence[tuple[str, float, bool, float | None]] = FEATURE_RANGES) -> dict[str, Column]:
    """Per feature, the condition under which a request must be rejected."""
    conditions = {}
    for name, low, inclusive, high in ranges:
        value = F.col(name).cast("double")
        bad = absent(value) | ((value < low) if inclusive else (value <= low))
        conditions[f"{name}_range"] = (bad | (value > high)) if high is not None else bad
    return conditions


def split_requests(
    df: DataFrame, ranges: Sequence[tuple[str, float, bool, float | None]] = FEATURE_RANGES, id_column: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows list their broken rules in `violated_rules`."""
    checks = range_violations(ranges)
    if id_column:
        identifier = F.col(id_column).cast("string")
        checks = {f"{id_column}_present": identifier.isNull() | (F.length(identifier) == 0), **checks}
    marked = df.withColumn(
        "violated_rules", F.array_compact(F.array(*[F.when(bad, F.lit(rule)) for rule, bad in checks.items()]))
    )
    accepted = marked.where(F.size("violated_rules") == 0).drop("violated_rules")
    return accepted, marked.where(F.size("violated_rules") > 0)


def sample_gate(df: DataFrame, minimum: int) -> DataFrame:
    """One row: how many rows there are, and whether they suffice."""
    require_count(minimum, "minimum sample size")
    return df.agg(F.count(F.lit(1)).alias("sample_size")).select(
        "sample_size",
        F.lit(minimum).cast("long").alias("minimum_samples"),
        (F.col("sample_size") >= minimum).alias("sufficient"),
    )


def enforce_size(rows: int, minimum: int) -> int:
    """The gate over a count that is known already."""
    if rows < require_count(minimum, "minimum sample size"):
        raise QualityError(f"{rows} rows found, {minimum} needed")
    return rows


def enforce_gate(gate: DataFrame) -> int:
    row = gate.first()
    return enforce_size(row["sample_size"], row["minimum_samples"])
