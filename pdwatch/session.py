"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Explaining an application is one wide expression. The JVM does not compile methods above
    # 8000 bytes, so beyond that size Spark should split the generated code.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}

_local_folders: dict[str, str] = {}
_bucketed: dict[str, list[str]] = {}
_shipped: set[str] = set()


def build_session(app_name: str = "pdwatch", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the package is tested with; `conf` overrides them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as `spark.checkpoint.dir` names it.

    A local session without the setting gets a temporary folder. On a cluster the setting is
    required: a folder on one machine would be lost with that machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="pdwatch-")
    return _local_folders[app]


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, unique per call."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/pdwatch/{app}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once as Parquet in the shared folder and return the scan of it.

    Later plans read the columns they need instead of recomputing `df`, and values that are fixed
    by one physical run (a partition id after a range shuffle) stay fixed even when an executor
    is lost and its tasks are run again.
    """
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_buckets(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """Write `df` once, bucketed by `column`: plans that group by it and other columns need no exchange.

    The table's files are below the shared folder; its entry in the session's catalog is removed by `clean_up`.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    table = "pdwatch_" + path.rsplit("/", 1)[1].replace("-", "_")
    df.write.format("parquet").bucketBy(buckets, column).option("path", path).saveAsTable(table)
    _bucketed.setdefault(spark.sparkContext.applicationId, []).append(table)
    return spark.table(table)


def clean_up(spark: SparkSession) -> None:
    """Remove all tables that this application has written below the shared folder; results that read them end with it."""
    app = spark.sparkContext.applicationId
    for table in _bucketed.pop(app, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/pdwatch/{app}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for workers that lack it.

    Functions that run in workers are pickled by name. Where the package is installed on all machines, the sent copy is
    the same code and changes nothing.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pdwatch-code-"), "pdwatch.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
