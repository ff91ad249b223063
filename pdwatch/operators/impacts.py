"""Feature impacts: value, typical value, impact, and three ranks per feature and application.

An application's impacts arrive as one array, so ranking happens inside the row and the long table
comes from expanding that array: no shuffle. Impacts that arrive in long form are ranked with
windows that share one partitioning.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.functions.expressions import null_for_nan
from pdwatch.operators.checks import require_columns, require_names
from pdwatch.operators.forest import sql_name, sql_number
from pdwatch.schemas import ID, IMPACT_COLUMNS


def observations(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (ID,), timestamp: str | None = None) -> DataFrame:
    """Identifiers, an optional UTC timestamp, and the features in model order."""
    names = require_names(features, "features")
    keys = require_names(ids, "identifier columns")
    require_columns(df, [*keys, *names, *([timestamp] if timestamp else [])])
    at = [F.col(timestamp).cast("timestamp").alias("observation_timestamp")] if timestamp else []
    return df.select(
        *[F.col(k).cast("string").alias(k) for k in keys], *at, *[F.col(n).cast("double").alias(n) for n in names]
    )


def identifier_columns(impacts: DataFrame) -> list[str]:
    """Every column that is not one of the standard impact columns."""
    found = [c for c in impacts.columns if c not in IMPACT_COLUMNS]
    if not found:
        raise ValueError("at least one identifier column is required")
    return found


def unpivot_features(df: DataFrame, features: Sequence[str], ids: Sequence[str] = (ID,)) -> DataFrame:
    """(identifiers, attribute_name, attribute_value)."""
    names = require_names(features, "features")
    require_columns(df, [*ids, *names])
    wide = df.select(*ids, *[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot(list(ids), names, "attribute_name", "attribute_value")


def background_means(background: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row with the mean of every feature."""
    names = require_names(features, "features")
    require_columns(background, names)
    return background.agg(*[F.avg(n).alias(n) for n in names])


def typical_values(background: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """The same on the driver: one number per feature, to be used as literals."""
    return background_means(background, features).first().asDict()


def value_vs_typical(value: Column, typical: Column) -> Column:
    return F.when(value > typical, "more").when(value < typical, "less").otherwise("equal")


def risk_vs_typical(impact: Column) -> Column:
    return F.when(impact > 0, "more").when(impact < 0, "less").otherwise("neutral")


def _sorted_positions(impacts: str) -> dict[str, Column]:
    """The feature positions in each of the three orders."""

    def order(key) -> Column:
        keyed = F.transform(impacts, lambda v, i: F.struct(key(v).alias("key"), i.alias("at")))
        # Unlike array_sort, this order has no comparator that is called as an expression.
        return F.sort_array(keyed)["at"]

    return {
        "__positive": order(lambda v: -v),
        "__negative": order(lambda v: v),
        "__absolute": order(lambda v: -F.abs(v)),
    }


def with_impact_entries(
    df: DataFrame,
    features: Sequence[str],
    typical: Mapping[str, float],
    impacts: str = "impacts",
    column: str = "contributions",
) -> DataFrame:
    """Add one array of structs, in feature order, with the ten standard impact columns."""
    names = require_names(features, "features")
    require_columns(df, [*names, impacts])
    if set(names) - set(typical):
        raise ValueError(f"no typical value for: {', '.join(sorted(set(names) - set(typical)))}")

    helpers = _sorted_positions(impacts)

    def rank(order: str, i: int) -> str:
        return f"CAST(array_position({order}, {i}) - 1 AS INT)"

    def entry(i: int, name: str) -> str:
        value, mean = f"CAST({sql_name(name)} AS DOUBLE)", sql_number(typical[name])
        impact = f"get({sql_name(impacts)}, {i})"
        label = name.replace("'", "\\'")
        return f"""named_struct(
            'attribute_name', '{label}',
            'attribute_value', IF(isnan({value}), NULL, {value}),
            'average_attribute_value', {mean},
            'attribute_impact', {impact},
            'absolute_impact', abs({impact}),
            'ranked_impact_positive', {rank('__positive', i)},
            'ranked_impact_negative', {rank('__negative', i)},
            'ranked_impact_absolute', {rank('__absolute', i)},
            'risk_vs_typical', CASE WHEN {impact} > 0 THEN 'more' WHEN {impact} < 0 THEN 'less' ELSE 'neutral' END,
            'value_vs_typical', CASE WHEN {value} > {mean} THEN 'more' WHEN {value} < {mean} THEN 'less' ELSE 'equal' END)"""

    entries = F.expr(f"array({', '.join(entry(i, n) for i, n in enumerate(names))})")
    return df.withColumns(helpers).withColumn(column, entries).drop(*helpers)


def expand(df: DataFrame, ids: Sequence[str], column: str, key: str = "attribute_name") -> DataFrame:
    """One row per struct of an array column; a row with an empty array gives none.

    The plain generator makes the optimizer test the array for being empty below the expressions
    that compute it, which evaluates them twice; here the test is on the expanded rows.
    """
    return df.select(*ids, F.inline_outer(column)).where(F.col(key).isNotNull())


def feature_impacts(
    df: DataFrame, features: Sequence[str], typical: Mapping[str, float], ids: Sequence[str] = (ID,), impacts: str = "impacts"
) -> DataFrame:
    """The long impact table from rows that carry an impact array."""
    require_columns(df, ids)
    return expand(with_impact_entries(df, features, typical, impacts), ids, "contributions")


def rank_impacts(
    long: DataFrame,
    features: Sequence[str],
    typical: Mapping[str, float],
    ids: Sequence[str] = (ID,),
) -> DataFrame:
    """The long impact table from (identifiers, attribute_name, attribute_value, attribute_impact)."""
    names = require_names(features, "features")
    require_columns(long, [*ids, "attribute_name", "attribute_value", "attribute_impact"])
    impact = F.col("attribute_impact")
    position = F.array_position(F.lit(names), F.col("attribute_name"))
    means = F.create_map(*[F.lit(x) for n in names for x in (n, float(typical[n]))])

    def rank(*order: Column) -> Column:
        return (F.row_number().over(Window.partitionBy(*ids).orderBy(*order, "__position")) - 1).cast("int")

    described = long.withColumns(
        {
            "__position": position,
            "average_attribute_value": means[F.col("attribute_name")],
            "absolute_impact": F.abs(impact),
        }
    )
    return described.select(
        *ids,
        "attribute_name",
        null_for_nan(F.col("attribute_value")).alias("attribute_value"),
        "average_attribute_value",
        "attribute_impact",
        "absolute_impact",
        rank(impact.desc()).alias("ranked_impact_positive"),
        rank(impact.asc()).alias("ranked_impact_negative"),
        rank(F.col("absolute_impact").desc()).alias("ranked_impact_absolute"),
        risk_vs_typical(impact).alias("risk_vs_typical"),
        value_vs_typical(F.col("attribute_value"), F.col("average_attribute_value")).alias("value_vs_typical"),
    )
