"""Stored states, samples, identifiers and keyed streams against plain definitions."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pdwatch.operators import drift, sampling
from pdwatch.operators.metrics import performance_report
from pdwatch.operators.quality import QualityError
from pdwatch.plans import states
from pdwatch.streaming.outcomes import matured_stream
from pdwatch.streaming.windows import alarm_transitions, write_windows


@pytest.fixture(scope="module")
def scored(spark):
    return spark.range(4000).select(
        F.col("id").cast("string").alias("application_id"),
        ((F.col("id") * 7919 % 997) / 1000.0).alias("predicted_probability"),
        (F.col("id") * 31 % 7 < 2).cast("int").alias("actual_default"),
        F.format_string("2020-%02d", 1 + F.col("id") % 12).alias("period"),
    )


def test_reports_of_ranges_equal_full_scans(spark, scored, tmp_path):
    path = str(tmp_path / "states")
    states.store_distributions(scored.where("period <= '2020-08'"), path)
    states.store_distributions(scored.where("period >= '2020-08'"), path)  # replaces August with the same rows
    stored = spark.read.schema("score double, pos bigint, neg bigint, period string").parquet(path)
    ranges = {"spring": ("2020-03", "2020-05"), "summer": ("2020-05", "2020-08"), "all": ("2020-01", "2020-12"), "none": ("2019-01", "2019-02")}
    found = {r["range"]: r for r in states.performance_by_range(stored, ranges, 0.5).collect()}
    assert set(found) == {"spring", "summer", "all"}
    for name, row in found.items():
        whole = performance_report(scored.where(F.col("period").between(*ranges[name])), 0.5).first().asDict()
        assert {k: v for k, v in row.asDict().items() if k != "range"} == whole
    # One partition of the states is read for a range of one month, and no row of the scores.
    one = states.distributions_between(stored, {"may": ("2020-05", "2020-05")})
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan
    assert one.inputFiles() and one.agg(F.sum(F.col("pos") + F.col("neg"))).first()[0] == scored.where("period = '2020-05'").count()
    with pytest.raises(ValueError, match="range"):
        states.performance_by_range(stored, {}, 0.5)


def test_profiles_add_up_and_give_the_same_index(spark):
    before = spark.range(3000).select((F.col("id") % 37).cast("double").alias("a"), (F.col("id") % 100 / 7.0).alias("b"), (F.col("id") % 10).alias("c"))
    after = spark.range(1000).select(
        (F.col("id") % 53).cast("double").alias("a"),
        (F.col("id") % 10 / 3.0).alias("b"),
        F.when(F.col("id") % 7 == 0, F.lit(0)).otherwise(F.col("id") % 10).alias("c"),
    )
    halves = [states.value_profile(before.where(c), ["a", "b", "c"]) for c in ("a < 20", "a >= 20")]
    profile = halves[0].unionByName(halves[1])
    got = sorted(states.psi_against_profile(profile, after, ["a", "b", "c"]).collect())
    assert got == sorted(drift.psi_by_feature(before, after, ["a", "b", "c"]).collect())
    assert {r["status"] for r in got} == {"WARNING", "ALERT"}
    gap = after.unionByName(spark.createDataFrame([(float("nan"), 1.0, 1)], after.schema))
    with pytest.raises(QualityError, match="missing values in: a"):
        states.psi_against_profile(profile, gap, ["a", "b", "c"])
    with pytest.raises(QualityError, match="rows"):
        states.psi_against_profile(profile.where("feature = 'a'"), after, ["a", "b", "c"])


@pytest.mark.parametrize("digits, collected", [(3, 4096), (1, 3)])
def test_samples_are_the_first_rows_by_hash(spark, monkeypatch, digits, collected):
    monkeypatch.setattr(sampling, "COUNTED_DIGITS", digits)
    monkeypatch.setattr(sampling, "COLLECTED", collected)
    names = [*map(str, range(300)), "7", "7", "8"]
    df = spark.createDataFrame([(n,) for n in names], "application_id string").repartition(5)
    ordered = sorted(names, key=lambda n: (hashlib.md5(f"{n}|42".encode()).hexdigest(), n))
    for size in (1, 2, 30, 299, 302, 303, 1000):
        found = [r[0] for r in sampling.sample_rows(df, size, 42).collect()]
        assert sorted(found) == sorted(ordered[:size])
    plan = sampling.sample_rows(df, 30, 42)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


def test_samples_of_odd_tables(spark):
    assert sampling.sample_rows(spark.createDataFrame([], "application_id string"), 5).collect() == []
    gaps = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "application_id string, v int")
    assert sampling.sample_rows(gaps, 2).count() == 2
    assert sampling.sample_rows(gaps, 3).count() == 3


def test_default_identifiers_are_gapless_and_repeat(spark):
    rows = [(n % 7, f"x{n % 5}", None if n % 3 else 1.0) for n in range(100)]
    one = spark.createDataFrame(rows, "a int, b string, c double").repartition(7)
    other = spark.createDataFrame(rows[::-1], "a int, b string, c double").repartition(2)
    found = sorted(map(tuple, sampling.with_default_identifiers(one).collect()), key=lambda r: int(r[0]))
    assert [int(r[0]) for r in found] == list(range(100))
    assert found == sorted(map(tuple, sampling.with_default_identifiers(other).collect()), key=lambda r: int(r[0]))
    assert sampling.with_default_identifiers(one.limit(0)).collect() == []
    with pytest.raises(ValueError, match="already"):
        sampling.with_default_identifiers(one.withColumnRenamed("a", "application_id"))


def test_labels_mature_over_batches(spark, tmp_path):
    folders = {name: str(tmp_path / name) for name in ("predictions", "labels", "out", "checkpoint")}
    schemas = {
        "predictions": "application_id string, predicted_probability double, predicted_at timestamp",
        "labels": "application_id string, actual_default int, labelled_at timestamp",
    }

    def arrive(name, rows):
        frame = spark.createDataFrame(rows, "id string, v double, at string")
        kind = "double" if name == "predictions" else "int"
        columns = schemas[name].replace(",", "").split()[0::2]
        frame.select(F.col("id"), F.col("v").cast(kind), F.col("at").cast("timestamp")).toDF(*columns).coalesce(1).write.mode("append").parquet(folders[name])

    def process():
        sides = [spark.readStream.schema(s).parquet(folders[n]) for n, s in schemas.items()]
        write_windows(matured_stream(*sides, maturity="30 days", delay="2 days"), folders["out"], folders["checkpoint"]).awaitTermination()
        return sorted(r[0] for r in spark.read.parquet(folders["out"]).select("application_id").collect())

    arrive("predictions", [("a", 0.1, "2020-01-01"), ("b", 0.2, "2020-01-02"), ("c", 0.3, "2020-01-03"), ("late", 0.5, "2020-01-03")])
    arrive("labels", [("a", 1.0, "2020-01-01"), ("early", 0.0, "2020-01-01")])
    assert process() == ["a"]
    # b matures in time, c's label is dated more than 30 days after it, d has no label yet.
    arrive("predictions", [("d", 0.4, "2020-02-20")])
    arrive("labels", [("b", 0.0, "2020-01-20"), ("c", 1.0, "2020-02-20")])
    assert process() == ["a", "b"]
    arrive("predictions", [("e", 0.4, "2020-04-20")])
    arrive("labels", [("d", 0.0, "2020-03-01"), ("e", 0.0, "2020-04-20")])
    assert process() == ["a", "b", "d", "e"]
    # This label is dated in time but arrives when its prediction is no longer waited for.
    arrive("labels", [("late", 1.0, "2020-01-10")])
    assert process() == ["a", "b", "d", "e"]


def test_transitions_over_batches(spark, tmp_path):
    folder, out, checkpoint = (str(tmp_path / n) for n in ("windows", "out", "checkpoint"))
    schema = "alarm string, window_start timestamp, breached boolean"

    def process(rows):
        hours = [(alarm, f"2020-01-01 {hour:02d}:00:00", breached) for alarm, hour, breached in rows]
        frame = spark.createDataFrame(hours, "alarm string, at string, breached boolean")
        frame.select("alarm", F.col("at").cast("timestamp").alias("window_start"), "breached").write.mode("append").parquet(folder)
        stream = alarm_transitions(spark.readStream.schema(schema).parquet(folder), 3600)
        write_windows(stream, out, checkpoint).awaitTermination()
        return sorted((r["alarm"], r["changed_at"].hour, r["state"]) for r in spark.read.schema(stream.schema).parquet(out).collect())

    first = [("x", 1, False), ("x", 2, True), ("x", 3, True), ("y", 1, True)]
    assert process(first) == [("x", 2, "ALARM"), ("y", 1, "ALARM")]
    # Hour 4 of x has no events; y goes on without a gap.
    assert process([("x", 5, True), ("y", 2, True), ("x", 6, False)]) == [
        ("x", 2, "ALARM"), ("x", 4, "OK"), ("x", 5, "ALARM"), ("x", 6, "OK"), ("y", 1, "ALARM"),
    ]
