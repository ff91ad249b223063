"""Population Stability Index per feature.

Two passes, whatever the number of features: one aggregate for every feature's range, one for all
bin counts. The ranges (two numbers per feature) become literals, so binning is plain comparison
inside generated code, and the second pass shuffles at most features x bins x 2 partial counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from pdwatch.config import PREDICTION_DRIFT_ALERT, PSI_ALERT, PSI_BINS, PSI_WARNING
from pdwatch.functions.rounding import round_half_even
from pdwatch.operators.checks import require_columns, require_count, require_names
from pdwatch.operators.quality import QualityError, absent
from pdwatch.schemas import PROBABILITY

EMPTY_SHARE = 0.0001


def psi_status(psi: Column, warning: float = PSI_WARNING, alert: float = PSI_ALERT) -> Column:
    return F.when(psi < warning, "NORMAL").when(psi < alert, "WARNING").when(psi >= alert, "ALERT")


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    """Equal-width edges; the last one is exactly `high`."""
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]


def bin_index(value: Column, edges: Sequence[float]) -> Column:
    """Zero-based bin of a value within the edges; the last bin includes its upper edge."""
    reached = [(value >= F.lit(e)).cast("int") for e in edges[1:-1]]
    return sum(reached[1:], reached[0]) if reached else F.lit(0)


def _tagged(reference: DataFrame, production: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    def side(df: DataFrame, is_reference: bool) -> DataFrame:
        return df.select(F.lit(is_reference).alias("is_reference"), *keys, *[F.col(f).cast("double").alias(f) for f in features])

    return side(reference, True).unionByName(side(production, False))


def population_facts(reference: DataFrame, production: DataFrame, features: Sequence[str]) -> Row:
    """Rows of either population and the range of each feature, from one aggregate over both.

    A population without rows and a missing value are errors.
    """
    names = require_names(features, "features")
    require_columns(reference, names)
    require_columns(production, names)
    facts = _tagged(reference, production, names).agg(
        F.count_if("is_reference").alias("reference_rows"),
        F.count_if(~F.col("is_reference")).alias("production_rows"),
        *[F.min(n).alias(f"min_{n}") for n in names],
        *[F.max(n).alias(f"max_{n}") for n in names],
        *[F.count_if(absent(F.col(n))).alias(f"missing_{n}") for n in names],
    ).first()
    if not facts["reference_rows"] or not facts["production_rows"]:
        raise QualityError("both populations need rows")
    incomplete = sorted(n for n in names if facts[f"missing_{n}"])
    if incomplete:
        raise QualityError(f"missing values in: {', '.join(incomplete)}")
    return facts


def psi_bins(
    reference: DataFrame, production: DataFrame, features: Sequence[str], bins: int = PSI_BINS, facts: Row | None = None
) -> DataFrame:
    """Rows of both populations per (feature, bin): reference_share and production_share.

    `facts` are those of `population_facts`, for a caller that has read them already.
    """
    names = require_names(features, "features")
    require_count(bins, "bins")
    facts = facts or population_facts(reference, production, names)
    binned = _tagged(reference, production, names).select(
        "is_reference",
        *[bin_index(F.col(n), bin_edges(facts[f"min_{n}"], facts[f"max_{n}"], bins)).alias(n) for n in names],
    )
    counts = (
        binned.unpivot(["is_reference"], names, "feature", "bin")
        .groupBy("feature", "bin")
        .agg(F.count_if("is_reference").alias("reference"), F.count_if(~F.col("is_reference")).alias("production"))
    )
    return counts.select(
        "feature",
        "bin",
        (F.col("reference") / F.lit(facts["reference_rows"])).alias("reference_share"),
        (F.col("production") / F.lit(facts["production_rows"])).alias("production_share"),
    )


def psi_bins_by_key(
    reference: DataFrame, production: DataFrame, features: Sequence[str], keys: Sequence[str], bins: int = PSI_BINS
) -> DataFrame:
    """As `psi_bins`, per `keys` group with the group's own ranges: (keys, feature, bin, shares).

    Ranges and row counts are one row per group, joined back to the rows; the optimizer picks the join, and a group that
    holds much of the table is split by it. A share of a population without rows in the group is null.
    """
    names, by = require_names(features, "features"), require_names(keys, "keys")
    require_columns(reference, [*names, *by])
    require_columns(production, [*names, *by])
    require_count(bins, "bins")
    both = _tagged(reference, production, names, by)
    facts = both.groupBy(*[F.col(k).alias(f"__{k}") for k in by]).agg(
        F.count_if("is_reference").alias("__reference_rows"),
        F.count_if(~F.col("is_reference")).alias("__production_rows"),
        *[F.min(n).alias(f"__min_{n}") for n in names],
        *[F.max(n).alias(f"__max_{n}") for n in names],
        *[F.count_if(absent(F.col(n))).alias(f"__missing_{n}") for n in names],
    )
    missing = facts.agg(*[F.coalesce(F.sum(f"__missing_{n}"), F.lit(0)).alias(n) for n in names]).first().asDict()
    if incomplete := sorted(n for n in names if missing[n]):
        raise QualityError(f"missing values in: {', '.join(incomplete)}")

    def bin_of(name: str) -> Column:
        low, high = F.col(f"__min_{name}"), F.col(f"__max_{name}")
        step = (high - low) / F.lit(bins)
        return sum([(F.col(name) >= low + F.lit(i) * step).cast("int") for i in range(1, bins)], F.lit(0))

    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    rows = ["__reference_rows", "__production_rows"]
    binned = both.join(facts, same).select(*by, *rows, "is_reference", *[bin_of(n).alias(n) for n in names])
    counts = (
        binned.unpivot([*by, *rows, "is_reference"], names, "feature", "bin")
        .groupBy(*by, *rows, "feature", "bin")
        .agg(F.count_if("is_reference").alias("reference"), F.count_if(~F.col("is_reference")).alias("production"))
    )
    return counts.select(
        *by,
        "feature",
        "bin",
        F.when(F.col(rows[0]) > 0, F.col("reference") / F.col(rows[0])).alias("reference_share"),
        F.when(F.col(rows[1]) > 0, F.col("production") / F.col(rows[1])).alias("production_share"),
    )


def psi(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str],
    bins: int = PSI_BINS,
    keys: Sequence[str] = (),
    facts: Row | None = None,
) -> DataFrame:
    """Unrounded index per feature, and per `keys` group if there are keys.

    A group that only one population has gets a null index.
    """
    if keys:
        shares = psi_bins_by_key(reference, production, features, keys, bins)
    else:
        shares = psi_bins(reference, production, features, bins, facts)
    return index_of_shares(shares, keys)


def index_of_shares(shares: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The index from (keys, feature, bin, reference_share, production_share).

    An empty share counts as 0.0001. A bin empty on both sides adds nothing, so it needs no row.
    """

    def filled(name: str) -> Column:
        return F.when(F.col(name) == 0.0, F.lit(EMPTY_SHARE)).otherwise(F.col(name))

    before, after = filled("reference_share"), filled("production_share")
    return shares.groupBy(*keys, "feature").agg(F.sum((after - before) * F.ln(after / before)).alias("psi"))


def psi_by_feature(
    reference: DataFrame,
    production: DataFrame,
    features: Sequence[str],
    bins: int = PSI_BINS,
    digits: int = 4,
    keys: Sequence[str] = (),
    facts: Row | None = None,
) -> DataFrame:
    """Index rounded for the report, status from the unrounded index."""
    return shown_index(psi(reference, production, features, bins, keys, facts), digits, keys)


def shown_index(index: DataFrame, digits: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    return index.select(
        *keys,
        "feature", round_half_even(F.col("psi"), digits).alias("psi"), psi_status(F.col("psi")).alias("status")
    )


def prediction_drift(
    reference: DataFrame,
    production: DataFrame,
    probability: str = PROBABILITY,
    alert: float = PREDICTION_DRIFT_ALERT,
    bins: int = PSI_BINS,
) -> DataFrame:
    """Index of the predicted probability itself, with its one alert level."""
    return psi(reference, production, [probability], bins).select(
        F.lit("prediction_drift").alias("metric"),
        F.col("psi").alias("value"),
        F.lit(float(alert)).alias("alert_level"),
        F.when(F.col("psi") >= alert, "ALERT").otherwise("NORMAL").alias("status"),
    )
