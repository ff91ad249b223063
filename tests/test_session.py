from types import SimpleNamespace

import pytest

from pdwatch.session import settle, shared_folder, staging_path


def session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda name, default=None: folder),
        sparkContext=SimpleNamespace(master=master, applicationId=f"app-{master}"),
    )


def test_shared_folder():
    assert shared_folder(session("yarn", "hdfs://shared/")) == "hdfs://shared"
    assert staging_path(session("yarn", "hdfs://shared/"), "x").startswith("hdfs://shared/pdwatch/app-yarn/x-")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("yarn"))
    local = session("local[2]")
    assert shared_folder(local) == shared_folder(local)


def test_settled_rows_are_fixed_and_pruned(spark):
    df = spark.range(100).selectExpr("id", "rand() AS r", "id * 2 AS twice")
    kept = settle(df, "random")
    assert sorted(kept.collect()) == sorted(kept.collect())
    assert "ReadSchema: struct<id:bigint>" in kept.select("id")._jdf.queryExecution().toString()
