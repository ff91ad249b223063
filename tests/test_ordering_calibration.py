import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pdwatch.operators import calibration as C
from pdwatch.operators.ordering import running_totals


@pytest.mark.parametrize("chunks", [1, 3, 16])
def test_running_totals_equal_a_plain_window(spark, chunks):
    df = spark.range(500).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("k"),
        (F.col("id") * 37 % 101).alias("v"),
        "id",
    )
    for keys in ([], ["k"]):
        got = running_totals(
            df, [F.col("v").desc(), F.col("id").asc()], {"run": F.col("v")}, {"total": F.col("v")}, keys, chunks
        )
        part = Window.partitionBy(*keys)
        plain = df.withColumn(
            "run", F.sum("v").over(part.orderBy(F.col("v").desc(), "id").rowsBetween(Window.unboundedPreceding, 0))
        ).withColumn("total", F.sum("v").over(part))
        assert sorted(got.collect()) == sorted(plain.collect())


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rows_are_exchanged_once(spark, keys):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), "id")
    got = running_totals(df, [F.col("id").asc()], {"run": F.lit(1)}, {"total": F.lit(1)}, keys, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    rows = plan[plan.index("Window") :] if keys else plan[plan.index("Window") : plan.index("BroadcastExchange")]
    # The window reads buckets: nothing between it and the scan of the rows moves them.
    assert "hashpartitioning" not in rows.split("FileScan")[0]
    assert "Bucketed: true" in rows
    # Both groups, the larger one of two thirds of the rows, are split over several chunks.
    most = got.where("k = 'hot'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < 2000


def test_written_tables_are_removed(spark):
    from pdwatch import session

    other = spark.newSession()
    before = session._bucketed.get(spark.sparkContext.applicationId, [])[:]
    running_totals(other.range(10).toDF("id"), [F.col("id").asc()], {"run": F.lit(1)}, chunks=2).collect()
    table = next(t for t in session._bucketed[spark.sparkContext.applicationId] if t not in before)
    assert other.catalog.tableExists(table)
    session.clean_up(other)
    assert not other.catalog.tableExists(table)
    assert session.clean_up(other) is None


def test_bands_of_known_rows(calibration_rows):
    rows = C.assign_bands(calibration_rows, 5).orderBy("predicted_probability").collect()
    assert [r["calibration_band"] for r in rows] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_table_and_errors_of_known_rows(calibration_rows):
    table = C.calibration_table(calibration_rows, 5)
    first = table.where("calibration_band = 1").first()
    assert (first["record_count"], first["default_count"]) == (2, 0)
    assert (first["minimum_predicted_pd"], first["maximum_predicted_pd"], first["average_predicted_pd"]) == (0.05, 0.1, 0.075)
    assert first["calibration_gap"] == 0.075 and first["population_percentage"] == 0.2
    errors = C.calibration_errors(table).first()
    assert errors["expected_calibration_error"] == pytest.approx(0.135)
    assert errors["maximum_calibration_error"] == pytest.approx(0.25)
    assert C.expected_vs_actual(table).count() == 10


def test_fewer_rows_than_bands(calibration_rows):
    assert C.calibration_table(calibration_rows.limit(3), 10).count() == 3
    assert C.calibration_table(calibration_rows.limit(1), 10).first()["calibration_band"] == 1


def test_bands_equal_quantile_cut_for_many_sizes(spark):
    """All groups at once: one group per (rows, bands) pair, against pandas."""
    for bands in (3, 7, 10, 20):
        sizes = [*range(1, 40), 97, 150]
        rows = [(f"g{n}", f"{i:04d}", i / n) for n in sizes for i in range(n)]
        df = spark.createDataFrame(rows, "g string, application_id string, predicted_probability double")
        got = C.assign_bands(df, bands, keys=["g"]).toPandas()
        for n in sizes:
            mine = got[got.g == f"g{n}"].sort_values("application_id").calibration_band.to_numpy()
            ranks = pd.Series(np.arange(n) / n).rank(method="first")
            assert (mine == pd.qcut(ranks, min(bands, n), labels=False, duplicates="drop").to_numpy() + 1).all(), (n, bands)


def test_hot_score_is_split_by_identifier(spark):
    df = spark.range(300).select(
        F.format_string("%04d", "id").alias("application_id"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 300.0).alias("predicted_probability"),
    )
    got = C.assign_bands(df).toPandas().sort_values(["predicted_probability", "application_id"])
    assert (got.calibration_band.to_numpy() == np.repeat(np.arange(1, 11), 30)).all()


def test_arguments(calibration_rows):
    with pytest.raises(ValueError, match="bands"):
        C.calibration_table(calibration_rows, 1)
    with pytest.raises(TypeError, match="bands"):
        C.calibration_table(calibration_rows, 2.5)
