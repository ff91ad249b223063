"""Reading and writing tables: Parquet and CSV, whole or partitioned by date."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdwatch.functions.paths import report_folder
from pdwatch.operators.checks import require_columns, require_names
from pdwatch.operators.quality import QualityError


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """By suffix: .parquet (also a folder of it) or .csv with a header. CSV needs a schema."""
    name = path.rstrip("/").lower()
    if name.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV file needs a schema")
        return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    if name.endswith(".parquet"):
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    raise ValueError(f"unsupported file type: {path}")


def write_table(df: DataFrame, path: str) -> str:
    """One Parquet table, replacing what is there."""
    df.write.mode("overwrite").parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """A report as CSV, each part with a header line."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str] = ("dt",), mode: str = "append") -> str:
    """Partitioned Parquet. `overwrite` replaces only the partitions that `df` has rows for.

    The rebalance hint gathers each partition value's rows into few files, and splits a value that
    holds much of the table over several tasks.
    """
    names = require_names(columns, "partition columns")
    require_columns(df, names)
    writer = df.hint("rebalance", *[F.col(n) for n in names]).write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*names).parquet(path)
    return path


def read_partitioned(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The whole table; partition values are read as strings when the schema says so."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_run_date(spark: SparkSession, path: str, run_date: str | dt.date, schema: T.StructType | None = None) -> DataFrame:
    """Only the files of one date."""
    day = run_date.isoformat() if isinstance(run_date, dt.date) else dt.date.fromisoformat(run_date).isoformat()
    return read_partitioned(spark, path, schema).where(F.col("dt").cast("string") == day)


def partition_dates(spark: SparkSession, path: str) -> list[str]:
    """Dates of the `dt=` folders of a table, ascending, from one listing of the table's folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory()]
    return sorted(name.removeprefix("dt=") for name in names if name.startswith("dt=") and "HIVE" not in name)


def read_latest(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Only the files of the latest date, which is found by listing the table's folder."""
    dates = partition_dates(spark, path)
    if not dates:
        raise QualityError(f"no partitions under {path}")
    return read_partitioned(spark, path, schema).where(F.col("dt").cast("string") == dates[-1])


def store_report(report: DataFrame, path: str, run_date: str) -> DataFrame:
    """Write the rows of a run by `run_date`, replacing those of an earlier run for that date; return what was written."""
    write_partitioned(report, path, ["run_date"], "overwrite")
    stored = read_partitioned(report.sparkSession, path, report.schema).where(F.col("run_date") == run_date)
    return stored.select(*report.columns)


def dated(df: DataFrame, timestamp: str = "ts") -> DataFrame:
    return df.withColumn("dt", F.to_date(timestamp))


def write_report(df: DataFrame, base: str, prefix: str, model_version: str, report_date: dt.date, name: str) -> str:
    """A report below base/prefix/model_version=.../dt=.../name."""
    return write_table(df, f"{base.rstrip('/')}/{report_folder(prefix, model_version, report_date)}/{name}")


def write_explanations(records: DataFrame, path: str, mode: str = "append") -> str:
    """Nested records by date. The application stays a column: a folder per application would not scale."""
    return write_partitioned(dated(records, "prediction_timestamp"), path, ("dt",), mode)
