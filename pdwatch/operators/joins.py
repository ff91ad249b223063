"""Predictions meet their matured outcomes."""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.operators.checks import require_columns
from pdwatch.operators.quality import QualityError, label_rules, probability_rules
from pdwatch.schemas import ACTUAL, ID, PROBABILITY


class Match(NamedTuple):
    """The joined rows, the violations of each rule in rule order, and the joined rows of each class."""

    rows: DataFrame
    violations: Mapping[str, int]
    size: int
    defaults: int
    non_defaults: int

    def enforce(self, both_classes: bool = False) -> Match:
        """Raise on the broken rule that comes first, or if nothing matched."""
        for rule, count in self.violations.items():
            if count:
                raise QualityError(f"{rule}: {count} violations")
        if not self.size:
            raise QualityError("no prediction has a matching outcome")
        if both_classes and not (self.defaults and self.non_defaults):
            raise QualityError("both_classes_present: 1 violations")
        return self


def match_outcomes(
    predictions: DataFrame, outcomes: DataFrame, id_column: str = ID, actual: str = ACTUAL, probability: str = PROBABILITY
) -> Match:
    """Join and validate.

    The rules need only identifiers, labels and flags: those of both sides are put under each other and added up by
    identifier, with partial sums before the shuffle, so rows that repeat an identifier, missing ones included, meet as one
    row. The rows themselves are a plain lazy join, which shuffles each side once or not at all.
    """
    require_columns(predictions, [id_column, probability])
    require_columns(outcomes, [id_column, actual])
    label = outcomes[f"`{actual}`"]
    of_side = {
        "predictions": (predictions, predictions[f"`{id_column}`"], probability_rules(f"`{probability}`"), F.lit(None)),
        "outcomes": (outcomes, outcomes[f"`{id_column}`"], label_rules(f"`{actual}`"), label),
    }
    broken = [f"{name}_{rule}" for name, (_, _, checks, _) in of_side.items() for rule in checks]
    sides = []
    for name, (side, identifier, checks, value) in of_side.items():
        own = {f"{name}_{rule}": F.coalesce(bad, F.lit(False)).cast("long") for rule, bad in checks.items()}
        sides.append(
            side.select(
                identifier.cast("string").alias("id"),
                value.cast("double").alias("label"),
                *[F.lit(int(name == other)).cast("long").alias(other) for other in of_side],
                *[own.get(column, F.lit(0).cast("long")).alias(column) for column in broken],
            )
        )
    by_id = sides[0].unionByName(sides[1]).groupBy("id").agg(
        F.max("label").alias("label"), *[F.sum(c).alias(c) for c in [*of_side, *broken]]
    )

    def total(column: Column) -> Column:
        return F.coalesce(F.sum(column), F.lit(0))

    known = F.col("id").isNotNull()
    facts = {}
    for name, (_, _, checks, _) in of_side.items():
        n = F.col(name)
        facts[f"{name}_not_empty"] = F.when(total(n) == 0, 1).otherwise(0)
        facts[f"{name}_id_not_null"] = total(F.when(~known, n))
        facts[f"{name}_id_unique"] = total(F.when(known & (n > 1), n - 1))
        for rule in checks:
            facts[f"{name}_{rule}"] = total(F.col(f"{name}_{rule}"))
    both = known & (F.col("predictions") > 0) & (F.col("outcomes") > 0)
    classes = {
        "size": F.count_if(both),
        "defaults": F.count_if(both & (F.col("label") == 1)),
        "non_defaults": F.count_if(both & (F.col("label") == 0)),
    }
    seen = by_id.agg(*[c.alias(n) for n, c in {**facts, **classes}.items()]).first().asDict()
    rows = join_outcomes(predictions, outcomes, id_column, actual, probability, validate=False)
    return Match(rows, {rule: seen[rule] for rule in facts}, *[seen[n] for n in classes])


def join_outcomes(
    predictions: DataFrame,
    outcomes: DataFrame,
    id_column: str = ID,
    actual: str = ACTUAL,
    probability: str = PROBABILITY,
    validate: bool = True,
) -> DataFrame:
    """Inner one-to-one join on the identifier; only the label is taken from the outcomes.

    Both sides are validated (among others, identifiers are present and unique), and an empty result is an error. Without
    `validate` this is a plain lazy join, in which repeated identifiers give a row for each pair.
    """
    if validate:
        return match_outcomes(predictions, outcomes, id_column, actual, probability).enforce().rows
    require_columns(predictions, [id_column, probability])
    require_columns(outcomes, [id_column, actual])
    columns = [c for c in predictions.columns if c != actual]
    scored = predictions.select(
        *[predictions[f"`{c}`"].cast("string").alias(c) if c == id_column else predictions[f"`{c}`"] for c in columns]
    )
    labels = outcomes.select(outcomes[f"`{id_column}`"].cast("string").alias("__id"), outcomes[f"`{actual}`"].alias(actual))
    matched = F.col("__id") == scored[f"`{id_column}`"]
    return scored.join(labels, matched, "inner").select(*[scored[f"`{c}`"] for c in columns], F.col(f"`{actual}`"))
