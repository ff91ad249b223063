"""Helpers that the text operators share."""

from __future__ import annotations

import ctypes
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def narrow(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under new names, so that no other column of the input can clash."""
    return df.select([df[f"`{source}`"].alias(name) for name, source in columns.items()])


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def utf8(column: Column) -> Column:
    """The bytes of a text; a null text has none."""
    return F.coalesce(column.cast("binary"), F.lit(b""))


def squeezed(data: bytes) -> bytes:
    """Bytes as they are sent through a shuffle, behind their length: each on its own, with a codec stronger than Spark's."""
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> bytes:
    """What `squeezed` was given."""
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def single_threaded() -> None:
    """Spark gives a task one core; a library must not start threads of its own beside it."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    os.environ.setdefault("OMP_NUM_THREADS", "1")


def release_memory() -> None:
    """Give freed memory back to the system: a worker is used again by tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
