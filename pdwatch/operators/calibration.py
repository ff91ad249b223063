"""Calibration by quantile band: are predicted probabilities as high as observed default rates?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pdwatch.functions.rounding import round_half_even
from pdwatch.operators.checks import require_columns, require_count
from pdwatch.operators.ordering import running_totals
from pdwatch.schemas import ACTUAL, ID, PROBABILITY


def band_edges(count: Column, bands: int) -> Column:
    """Band edges over the ranks 1..count, as an array of at most bands + 1 numbers.

    Edge k is the linearly interpolated k/q quantile of the ranks, where q = min(bands, count).
    The float operations follow NumPy's, because an edge that should fall on a whole rank may miss
    it by one unit in the last place, and that decides the band of the row with this rank.
    """
    n = count.cast("double")
    q = F.least(F.lit(float(bands)), n)

    def edge(k: Column) -> Column:
        share = F.when(k == q, F.lit(1.0)).otherwise(k * (F.lit(1.0) / q))
        position = share * 100.0 / 100.0 * (n - 1.0)
        low = F.floor(position).cast("double")
        part = position - low
        inside = F.when(part < 0.5, low + 1.0 + part).otherwise(low + 2.0 - (1.0 - part))
        return F.when(low >= n - 1.0, n).otherwise(inside)

    return F.transform(F.sequence(F.lit(0), q.cast("int")), lambda k: edge(k.cast("double")))


def band_of_rank(rank: Column, edges: Column, bands: int) -> Column:
    """Number of edges below the rank, at least one."""
    below = [F.coalesce((F.get(edges, F.lit(k)) < rank).cast("int"), F.lit(0)) for k in range(bands + 1)]
    return F.greatest(F.lit(1), sum(below[1:], below[0])).cast("int")


def assign_bands(
    df: DataFrame,
    bands: int = 10,
    probability: str = PROBABILITY,
    tie_break: str = ID,
    keep: Sequence[str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Each row's `calibration_band` by the rank of its probability; equal scores rank by `tie_break`."""
    require_count(bands, "bands", 2)
    require_columns(df, [probability, tie_break, *keep, *keys])
    columns = list(dict.fromkeys([*keys, tie_break, probability, *keep]))
    ranked = running_totals(
        df.select(*columns),
        order_by=[F.col(probability).asc(), F.col(tie_break).asc()],
        running={"score_rank": F.lit(1)},
        totals={"group_size": F.lit(1)},
        keys=keys,
        derive={"edges": band_edges(F.col("group_size"), bands)},
    )
    return ranked.select(
        *columns, "group_size", band_of_rank(F.col("score_rank"), F.col("edges"), bands).alias("calibration_band")
    )


def calibration_table(
    df: DataFrame,
    bands: int = 10,
    actual: str = ACTUAL,
    probability: str = PROBABILITY,
    tie_break: str = ID,
    keys: Sequence[str] = (),
    digits: int = 4,
) -> DataFrame:
    """Counts, score range, predicted and observed rate of every band."""
    require_columns(df, [actual, probability, tie_break, *keys])
    banded = assign_bands(df, bands, probability, tie_break, keep=[actual], keys=keys)
    rates = banded.groupBy(*keys, "calibration_band").agg(
        F.count(F.lit(1)).alias("record_count"),
        F.sum(F.col(actual).cast("long")).alias("default_count"),
        F.min(probability).alias("low"),
        F.max(probability).alias("high"),
        F.avg(probability).alias("predicted"),
        F.avg(F.col(actual).cast("double")).alias("observed"),
        F.max("group_size").alias("group_size"),
    )
    gap = F.col("predicted") - F.col("observed")
    return rates.select(
        *keys,
        F.col("calibration_band").cast("long").alias("calibration_band"),
        "record_count",
        "default_count",
        round_half_even(F.col("low"), digits).alias("minimum_predicted_pd"),
        round_half_even(F.col("high"), digits).alias("maximum_predicted_pd"),
        round_half_even(F.col("predicted"), digits).alias("average_predicted_pd"),
        round_half_even(F.col("observed"), digits).alias("actual_default_rate"),
        round_half_even(F.col("record_count") / F.col("group_size"), digits).alias("population_percentage"),
        round_half_even(gap, digits).alias("calibration_gap"),
        round_half_even(F.abs(gap), digits).alias("absolute_calibration_gap"),
    )


def calibration_errors(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error of a calibration table."""
    require_columns(table, ["population_percentage", "absolute_calibration_gap", *keys])
    return table.groupBy(*keys).agg(
        F.sum(F.col("population_percentage") * F.col("absolute_calibration_gap")).alias("expected_calibration_error"),
        F.max("absolute_calibration_gap").alias("maximum_calibration_error"),
    )


def expected_vs_actual(table: DataFrame) -> DataFrame:
    """The two series drawn against the band: predicted probability and observed rate."""
    series = ["average_predicted_pd", "actual_default_rate"]
    require_columns(table, ["calibration_band", *series])
    return table.unpivot(["calibration_band"], series, "series", "rate")
