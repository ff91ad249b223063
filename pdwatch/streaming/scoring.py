"""Streaming scoring: new applications are scored and appended by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pdwatch.operators.forest import Forest, score


def scored_stream(applications: DataFrame, forest: Forest, column: str = "default_probability") -> DataFrame:
    return score(applications, forest, column)


def append_by_date(stream: DataFrame, path: str, checkpoint: str, timestamp: str = "ts", **trigger) -> StreamingQuery:
    """Append-only Parquet sink partitioned by date. Every row is kept; nothing is overwritten."""
    return (
        stream.withColumn("dt", F.to_date(timestamp))
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("dt")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def follow_parquet(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table as a stream: a folder of part files, or one file. A path that is neither is refused."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = table.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(table):
        raise FileNotFoundError(path)
    reader = spark.readStream.schema(schema)
    if files.getFileStatus(table).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", table.getName()).parquet(table.getParent().toString())
