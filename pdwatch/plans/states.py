"""Stored states of populations that add up: later reports and drift read the states instead of the rows.

A score distribution by period holds how many defaults and non-defaults each score has; the report of any range of periods
follows from the sum of its distributions. A value profile holds how many rows have each value of each feature; shares
for any bin edges follow from it, so a reference population needs to be read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdwatch.config import PSI_BINS
from pdwatch.operators.checks import require_columns, require_count, require_names
from pdwatch.operators.drift import absent, bin_edges, bin_index, index_of_shares, shown_index
from pdwatch.operators.metrics import report_of_scores, score_distribution
from pdwatch.operators.quality import QualityError
from pdwatch.schemas import ACTUAL, PROBABILITY
from pdwatch.session import settle
from pdwatch.sources.tables import write_partitioned


def store_distributions(
    scored: DataFrame, path: str, period: str = "period", actual: str = ACTUAL, probability: str = PROBABILITY
) -> str:
    """Write the score distribution of each period; periods that are stored already are replaced."""
    return write_partitioned(score_distribution(scored, actual, probability, [period]), path, [period], "overwrite")


def distributions_between(states: DataFrame, ranges: Mapping[str, tuple[str, str]], period: str = "period") -> DataFrame:
    """(range, score, pos, neg) of each named range of periods, both ends included. Ranges may overlap.

    Only partitions of periods inside some range are read.
    """
    require_columns(states, [period, "score", "pos", "neg"])
    if not ranges:
        raise ValueError("at least one range is required")
    at = F.col(period).cast("string")
    wanted = [at.between(first, last) for first, last in ranges.values()]
    read = states.where(F.expr("false") if not wanted else _any(wanted))
    names = F.array_compact(F.array(*[F.when(inside, F.lit(name)) for name, inside in zip(ranges, wanted, strict=True)]))
    return (
        read.select(F.explode(names).alias("range"), "score", "pos", "neg")
        .groupBy("range", "score")
        .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    )


def _any(conditions):
    found = conditions[0]
    for condition in conditions[1:]:
        found = found | condition
    return found


def performance_by_range(
    states: DataFrame, ranges: Mapping[str, tuple[str, str]], threshold: float, digits: int | None = 4, period: str = "period"
) -> DataFrame:
    """The performance report of each range, from stored distributions. A range without rows gives no row."""
    return report_of_scores(distributions_between(states, ranges, period), threshold, ["range"], digits)


def value_profile(population: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, value, rows): rows that have each value. Profiles of parts of a population add up.

    A missing value is an error of the index later, so it is kept, as a null value.
    """
    names = require_names(features, "features")
    require_columns(population, names)
    wide = population.select(*[F.when(~absent(F.col(n)), F.col(n).cast("double")).alias(n) for n in names])
    return wide.unpivot([], names, "feature", "value").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("rows"))


def psi_against_profile(
    reference: DataFrame, production: DataFrame, features: Sequence[str], bins: int = PSI_BINS, digits: int = 4
) -> DataFrame:
    """The index of each feature against a stored profile of the reference; no row of the reference is read.

    Equal to the index from the rows: bins are cut over the range of both, and the profile tells exactly how many rows of the
    reference are in any bin.
    """
    names = require_names(features, "features")
    require_count(bins, "bins")
    require_columns(reference, ["feature", "value", "rows"])
    later = settle(value_profile(production, names), "profile")
    both = reference.select("feature", "value", "rows", F.lit(True).alias("before")).unionByName(
        later.select("feature", "value", "rows", F.lit(False).alias("before"))
    ).where(F.col("feature").isin(names))
    # One row per feature.
    facts = {
        row["feature"]: row
        for row in both.groupBy("feature").agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.sum(F.when(F.col("before"), F.col("rows")).otherwise(0)).alias("n_before"),
            F.sum(F.when(~F.col("before"), F.col("rows")).otherwise(0)).alias("n_after"),
            F.count_if(F.col("value").isNull()).alias("missing"),
        ).collect()
    }
    if any(n not in facts or not facts[n]["n_before"] or not facts[n]["n_after"] for n in names):
        raise QualityError("both populations need rows")
    if incomplete := sorted(n for n in names if facts[n]["missing"]):
        raise QualityError(f"missing values in: {', '.join(incomplete)}")
    value, feature = F.col("value"), F.col("feature")
    bin_of, before, after = F.lit(0), F.lit(0), F.lit(0)
    for n in names:
        here = feature == n
        bin_of = F.when(here, bin_index(value, bin_edges(facts[n]["low"], facts[n]["high"], bins))).otherwise(bin_of)
        before = F.when(here, F.lit(facts[n]["n_before"])).otherwise(before)
        after = F.when(here, F.lit(facts[n]["n_after"])).otherwise(after)
    shares = (
        both.groupBy("feature", bin_of.alias("bin"))
        .agg(
            F.sum(F.when(F.col("before"), F.col("rows")).otherwise(0)).alias("reference"),
            F.sum(F.when(~F.col("before"), F.col("rows")).otherwise(0)).alias("production"),
        )
        .select(
            "feature",
            "bin",
            (F.col("reference") / before).alias("reference_share"),
            (F.col("production") / after).alias("production_share"),
        )
    )
    return shown_index(index_of_shares(shares), digits)
