"""Missing features, infinite features, folder-form streams and the latest date."""

from __future__ import annotations

import pytest

from pdwatch.operators import forest as forests
from pdwatch.operators import shap
from pdwatch.sources import tables
from pdwatch.streaming import scoring

INF, NAN = float("inf"), float("nan")


def _forest():
    leaves = (
        forests.Leaf(0, 0.5, (("a", -INF, 1.0),)),
        forests.Leaf(0, -0.4, (("a", 1.0, INF), ("b", -INF, 2.0))),
        forests.Leaf(0, 0.3, (("a", 1.0, INF), ("b", 2.0, INF))),
    )
    return forests.Forest(-0.1, leaves)


@pytest.mark.parametrize("limit", [128, 0])
def test_impacts_add_up_or_are_null(spark, monkeypatch, limit):
    monkeypatch.setattr(shap, "EXPRESSION_LEAVES", limit)
    rows = [(0.0, 1.0), (1.0, 2.0), (-INF, 3.0), (INF, INF), (2.0, -INF), (NAN, 1.0), (None, 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    model = _forest()
    background = shap.background_counts(df, model)
    assert background.rows == 5
    out = shap.shap_vectors(df, model, background, ["a", "b"]).withColumn("margin", forests.margin(model)).collect()
    for row, (a, b) in zip(out, rows, strict=True):
        if a is None or b is None or a != a:
            assert row["margin"] is None
            assert row["impacts"] is None
        else:
            assert sum(row["impacts"]) == pytest.approx(row["margin"] - background.expected_margin(model))


def test_stream_follows_files_and_folders(spark, tmp_path):
    df = spark.range(20).repartition(3)
    folder = str(tmp_path / "t.parquet")
    df.write.parquet(folder)
    part = next(p for p in (tmp_path / "t.parquet").iterdir() if p.name.endswith(".parquet"))
    for n, (path, rows) in enumerate([(folder, 20), (str(part), spark.read.parquet(str(part)).count())]):
        stream = scoring.follow_parquet(spark, path, df.schema)
        query = stream.writeStream.format("memory").queryName(f"followed{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table(f"followed{n}").count() == rows
    with pytest.raises(FileNotFoundError):
        scoring.follow_parquet(spark, str(tmp_path / "none.parquet"), df.schema)


def test_latest_reads_one_date(spark, tmp_path):
    path = str(tmp_path / "dated")
    spark.sql("SELECT id, date_add(DATE'2026-01-01', int(id % 3)) AS dt FROM range(9)").write.partitionBy("dt").parquet(path)
    assert tables.partition_dates(spark, path)[-1] == "2026-01-03"
    latest = tables.read_latest(spark, path)
    assert sorted(r["id"] for r in latest.collect()) == [2, 5, 8]
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert "2026-01-03" in plan.split("PartitionFilters: ")[1].split("PushedFilters")[0]
