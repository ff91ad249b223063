"""Reason selection: enrich with the registry, filter by direction, rank, keep the first N."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.config import DEFAULT_BUSINESS_PRIORITY
from pdwatch.operators.checks import require_choice, require_columns, require_non_negative, require_top_n
from pdwatch.operators.impacts import identifier_columns
from pdwatch.operators.registry import Entry, enrich, registry_map
from pdwatch.schemas import IMPACT_COLUMNS

# Fixed values.
DIRECTIONS = ("adverse", "favorable", "all")
RANKINGS = ("impact", "absolute_impact", "business_priority")
RANK_OF_DIRECTION = {
    "adverse": "ranked_impact_positive",
    "favorable": "ranked_impact_negative",
    "all": "ranked_impact_absolute",
}


def check_parameters(direction: str, ranking: str, top_n: int | str, minimum: float) -> None:
    require_choice(direction, DIRECTIONS, "direction")
    require_choice(ranking, RANKINGS, "ranking")
    require_top_n(top_n)
    require_non_negative(minimum, "minimum contribution")


def in_direction(impact: Column, direction: str, minimum: float) -> Column:
    """Adverse and favorable are strict, so a zero impact is neither; "all" includes its minimum."""
    if direction == "adverse":
        return impact > minimum
    if direction == "favorable":
        return impact < -minimum
    return F.lit(True) if minimum == 0 else F.abs(impact) >= minimum


def sort_keys(field, direction: str, ranking: str) -> list[Column]:
    """Ascending sort keys; equal impacts follow the absolute rank, hence the feature order."""
    if ranking == "impact":
        return [field(RANK_OF_DIRECTION[direction])]
    strongest = [-field("absolute_impact"), field("ranked_impact_absolute")]
    return [field("business_priority"), *strongest] if ranking == "business_priority" else strongest


def select_reasons(
    impacts: DataFrame,
    direction: str = "adverse",
    ranking: str = "impact",
    top_n: int | str = 4,
    minimum: float = 0.0,
    registry: Mapping[str, Entry] | None = None,
    ids: Sequence[str] | None = None,
) -> DataFrame:
    """Ranked reasons of a long impact table; `reason_rank` counts from one.

    One shuffle by identifier, without the registry's texts. With a number for `top_n` the rank filter is pushed below it, so each
    task sends at most N rows per identifier.
    """
    check_parameters(direction, ranking, top_n, minimum)
    require_columns(impacts, IMPACT_COLUMNS)
    keys = list(ids) if ids else identifier_columns(impacts)
    require_columns(impacts, keys)
    chosen = impacts.where(in_direction(F.col("attribute_impact"), direction, minimum))
    # What the registry tells follows from the name, so only the priority that a ranking needs goes through the shuffle.
    known = F.try_element_at(registry_map(registry), F.col("attribute_name"))
    priority = F.coalesce(known["business_priority"], F.lit(DEFAULT_BUSINESS_PRIORITY))
    order = sort_keys(lambda name: priority if name == "business_priority" else F.col(name), direction, ranking)
    ranked = chosen.withColumn("reason_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked if top_n == "all" else ranked.where(F.col("reason_rank") <= top_n)
    described = enrich(kept, registry)
    return described.select(*[c for c in described.columns if c != "reason_rank"], "reason_rank")


def reasons_in_row(
    contributions: Column,
    registry: Mapping[str, Entry] | None,
    direction: str = "adverse",
    ranking: str = "impact",
    top_n: int | str = 4,
    minimum: float = 0.0,
) -> Column:
    """The same selection within one row's array of contributions, without a shuffle."""
    check_parameters(direction, ranking, top_n, minimum)

    table = registry_map(registry)

    def field_of(c: Column):
        def field(name: str) -> Column:
            if name != "business_priority":
                return c[name]
            known = F.try_element_at(table, c["attribute_name"])
            return F.coalesce(known["business_priority"], F.lit(DEFAULT_BUSINESS_PRIORITY))

        return field

    def keyed(c: Column) -> Column:
        keys = sort_keys(field_of(c), direction, ranking)
        return F.struct(*[k.alias(f"key_{i}") for i, k in enumerate(keys)], c.alias("entry"))

    def described(k: Column, position: Column) -> Column:
        c = k["entry"]
        known = F.try_element_at(table, c["attribute_name"])
        return F.struct(
            *[c[f].alias(f) for f in IMPACT_COLUMNS],
            F.coalesce(known["display_name"], c["attribute_name"]).alias("display_name"),
            known["reason_code"].alias("reason_code"),
            known["adverse_reason"].alias("adverse_reason"),
            known["favorable_reason"].alias("favorable_reason"),
            F.coalesce(known["compliance_review_required"], F.lit(False)).alias("compliance_review_required"),
            field_of(c)("business_priority").alias("business_priority"),
            (position + 1).alias("reason_rank"),
        )

    chosen = F.filter(contributions, lambda c: in_direction(c["attribute_impact"], direction, minimum))
    ordered = F.sort_array(F.transform(chosen, keyed))
    return F.transform(ordered if top_n == "all" else F.slice(ordered, 1, top_n), described)
