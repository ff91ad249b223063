"""The application table: one row per order, with the model's features, a score and an outcome.

`applications` is the lazy definition over the source tables. `staged_applications` writes it once
per session to the shared folder, as a scoring pipeline would, so that each later query is a
pruned columnar scan and multi-pass operators do not repeat the three-table join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pdwatch.schemas import ACTUAL, FEATURES, ID, PROBABILITY
from pdwatch.session import settle

REFERENCE_END = "1998-01-01"
_staged: dict[tuple[str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer and the totals of their lines, as scored applications.

    Lines are summed before the join, so a popular order is combined on the map side. Orders and sums meet in a shuffle by
    order, which also spreads the rows evenly over the tasks that follow, however few files the source has. The customer
    join is left to the optimizer: broadcast when the statistics allow it, otherwise a sort-merge
    join whose skewed customers are split at run time.
    """
    discount = F.col("l_discount").cast("decimal(4,2)")
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * discount).cast("double").alias("debt"),
            F.sum(discount).cast("double").alias("discounts"),
            F.count(F.lit(1)).cast("double").alias("accounts"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"
    )
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    featured = (
        orders.join(customers, "o_custkey")
        .join(lines.hint("merge"), "o_orderkey", "left")
        .select(
            order.cast("string").alias(ID),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            (F.col("o_orderstatus") != "O").alias("matured"),
            # (key * multiplier) mod m, reduced first so that large keys cannot overflow
            ((order % 1000003) * F.lit(2654435761 % 1000003) % 1000003).alias("draw"),
            (F.lit(20000.0) + F.lit(15.0) * (F.col("c_acctbal") + F.lit(1000.0))).alias("income"),
            (F.lit(300) + (order * 7919 + customer * 104729) % 551).cast("double").alias("fico"),
            F.col("o_totalprice").alias("loan_amount"),
            (F.lit(18) + (customer * 31) % 63).cast("double").alias("age"),
            F.coalesce("debt", F.lit(0.0)).alias("debt"),
            ((customer * 17) % 41).cast("double").alias("employment"),
            F.greatest("c_acctbal", F.lit(0.0)).alias("balance"),
            F.coalesce(F.round(F.col("discounts") / F.col("accounts") * 10.0, 6), F.lit(0.0)).alias("utilization"),
            F.coalesce("accounts", F.lit(0.0)).alias("accounts"),
            ((customer * 13) % 31).cast("double").alias("history"),
        )
    )
    log_odds = (
        F.lit(-1.0)
        - F.lit(0.008) * (F.col("fico") - 575.0)
        + F.lit(2.0) * (F.col("utilization") - 0.5)
        + F.lit(0.000003) * (F.col("loan_amount") - 250000.0)
        - F.lit(0.03) * (F.col("history") - 15.0)
    )
    scored = featured.withColumn(PROBABILITY, F.round(1.0 / (1.0 + F.exp(-log_odds)), 6))
    return scored.select(
        ID,
        "ts",
        "matured",
        *FEATURES,
        PROBABILITY,
        (F.col("draw") / F.lit(1000003.0) < F.col(PROBABILITY)).cast("int").alias(ACTUAL),
    )


def staged_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The application table, written once per session and source folder.

    The join by order has spread the rows already, so they are written as they come, without a shuffle of the wide rows.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _staged:
        _staged[key] = settle(applications(spark, sf_dir), "applications")
    return _staged[key]


def predictions(apps: DataFrame) -> DataFrame:
    return apps.select(ID, PROBABILITY)


def outcomes(apps: DataFrame) -> DataFrame:
    """Labels of matured applications only; an open order has no outcome yet."""
    return apps.where("matured").select(ID, ACTUAL)


def reference_population(apps: DataFrame) -> DataFrame:
    return apps.where(F.col("ts") < F.lit(REFERENCE_END).cast("timestamp"))


def production_population(apps: DataFrame) -> DataFrame:
    """Applications from then on."""
    return apps.where(F.col("ts") >= F.lit(REFERENCE_END).cast("timestamp"))
