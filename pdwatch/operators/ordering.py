"""Running totals along a global order, without sending all rows to one task.

A window without partition keys puts every row in one task. Here rows are range-partitioned into
ordered chunks, the chunks are written once as buckets so their numbers cannot change, each chunk's totals
give the offset of the next, and an ordinary window runs inside every chunk. The range shuffle is the only exchange of
the rows: totals and windows inside chunks read whole buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pdwatch.session import settle, settle_buckets

CHUNK, BUCKET = "__chunk", "__bucket"
#: Rows of a chunk, which is one task's sort.
CHUNK_ROWS = 4_000_000


@cache
def _bucket_labels(spark: SparkSession, buckets: int) -> tuple[int, ...]:
    """For each bucket a number that Spark's bucketing puts there, so that chunk n is bucket n and no two chunks share one."""
    numbers = spark.range(64 * buckets).select(F.col("id").cast("int").alias("label"))
    placed = numbers.groupBy(F.pmod(F.hash("label"), F.lit(buckets)).alias("bucket")).agg(F.min("label").alias("label"))
    return tuple(row["label"] for row in placed.orderBy("bucket").collect())


def running_totals(
    df: DataFrame,
    order_by: Sequence[Column],
    running: Mapping[str, Column],
    totals: Mapping[str, Column] | None = None,
    keys: Sequence[str] = (),
    chunks: int | None = None,
    derive: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add inclusive running sums and group totals to `df`.

    running: name -> summed column; the sum runs along `order_by` within `keys`.
    totals: name -> summed column; every row gets the total of its `keys` group.
    derive: name -> expression over `totals`, evaluated once per chunk rather than once per row.
    chunks: how many to cut; by default one per shuffle partition, and more where they would exceed CHUNK_ROWS.
    `order_by` must order the rows of a group completely. A group as large as the table is split
    over all chunks, since the chunks are cut by (keys, order) and not by key.
    """
    totals = dict(totals or {})
    derive = dict(derive or {})
    if chunks is None:
        chunks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // CHUNK_ROWS))
    key_columns = [F.col(k) for k in keys]
    labels = F.lit(list(_bucket_labels(df.sparkSession, chunks)))
    ranges = df.repartitionByRange(chunks, *key_columns, *order_by).withColumn(CHUNK, F.spark_partition_id())
    chunked = settle_buckets(ranges.withColumn(BUCKET, F.get(labels, F.col(CHUNK))), "ordered", BUCKET, chunks)

    per_chunk = chunked.groupBy(*keys, CHUNK, BUCKET).agg(
        *[F.sum(c).alias(f"__sum_{n}") for n, c in running.items()],
        *[F.sum(c).alias(f"__tot_{n}") for n, c in totals.items()],
    )
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = per_chunk.select(
        *[F.col(k).alias(f"__key_{k}") for k in keys],
        F.col(CHUNK).alias("__chunk_at"),
        *[F.coalesce(F.sum(f"__sum_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in running],
        *[F.sum(f"__tot_{n}").over(whole).alias(n) for n in totals],
    ).withColumns(derive)
    # A row per chunk and a row per group beyond the first in its chunk. Without keys that is one row per chunk; with keys
    # the written size tells Spark whether to broadcast.
    offsets = settle(offsets, "offsets") if keys else F.broadcast(offsets)

    match = F.col(CHUNK) == F.col("__chunk_at")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__key_{k}"))
    inside = (
        Window.partitionBy(*keys, BUCKET).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    inner = chunked.select("*", *[F.sum(c).over(inside).alias(f"__run_{n}") for n, c in running.items()])
    return inner.join(offsets, match).select(
        *df.columns,
        *[(F.col(f"__before_{n}") + F.col(f"__run_{n}")).alias(n) for n in running],
        *totals,
        *derive,
    )
