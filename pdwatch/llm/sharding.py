"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows lie in many partitions. How many rows of each partition go to each shard is drawn first, exactly
as a uniform permutation of all rows would have it. Then every partition is permuted on its own and
dealt out by these counts, and every shard is permuted again.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow
from pdwatch.session import settle

SHARDS = 24
SEED = 20240229
#: Rows of a partition or of a slice of a shard, which one task sorts.
SORTED_ROWS = 1 << 20
#: Partitions at least, so that small tables use all cores too.
LEAST_PARTITIONS = 256


def hypergeometric(draw: float, good: int, bad: int, taken: int) -> int:
    """How many of `taken` rows, drawn from `good` and `bad` ones, are good: the value at quantile `draw`.

    The quantile is searched outwards from the mode, so the work grows with the standard deviation only.
    """
    low, high = max(0, taken - bad), min(good, taken)
    mode = min(max((taken + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, taken - mode) - log_choose(good + bad, taken))
    left, right = mode, mode + 1
    p_left = at_mode
    p_right = at_mode * (good - mode) * (taken - mode) / ((mode + 1) * (bad - taken + mode + 1)) if mode < high else 0.0
    rest = draw
    while left >= low or right <= high:
        if left >= low and (p_left >= p_right or right > high):
            rest -= p_left
            if rest < 0:
                return left
            p_left = p_left * left * (bad - taken + left) / ((good - left + 1) * (taken - left + 1))
            left -= 1
        else:
            rest -= p_right
            if rest < 0:
                return right
            p_right = p_right * (good - right) * (taken - right) / ((right + 1) * (bad - taken + right + 1))
            right += 1
    return mode


def communication_matrix(partitions: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Rows of partition i for shard j; rows and columns add up to the given sizes exactly."""
    generator = random.Random(seed)
    left = list(shards)
    matrix = []
    for size in partitions:
        others, row = sum(left), []
        for j, room in enumerate(left):
            others -= room
            count = hypergeometric(generator.random(), room, others, size) if others else size
            left[j] -= count
            size -= count
            row.append(count)
        matrix.append(row)
    return matrix


def shuffle_into_shards(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Add `shard` (sizes differ by one at most) and `slot` (from 0 without gaps) to each row.

    Rows are keyed by a hash of all their columns, so the result depends on the rows and the seed alone.
    Rows equal in every column get neighbouring keys and separate slots. An empty table stays empty.
    Only counts reach the driver: one number per partition, of which there is one per SORTED_ROWS rows.
    """
    columns = rows.columns
    total = rows.count()
    partitions = max(LEAST_PARTITIONS, -(-total // SORTED_ROWS))
    slices = max(LEAST_PARTITIONS // 8, -(-total // (shards * SORTED_ROWS)))

    def key(salt: int) -> Column:
        return F.xxhash64(F.lit(seed + salt), *columns)

    keyed = rows.withColumn("_part", F.pmod(key(1), F.lit(partitions)).cast("int"))
    found = dict(keyed.groupBy("_part").count().collect())
    sizes = [found.get(part, 0) for part in range(partitions)]
    room = [total // shards + (shard < total % shards) for shard in range(shards)]
    bounds = []
    for row in communication_matrix(sizes, room, seed):
        upper = 0
        ends = []
        for count in row:
            upper += count
            ends.append(upper)
        bounds.append(ends)
    dealt = rows.sparkSession.createDataFrame(
        list(enumerate(bounds)), "_part int, _ends array<bigint>"
    )
    local = Window.partitionBy("_part").orderBy(key(2), *columns)
    placed = (
        keyed.withColumn("_rank", F.row_number().over(local) - 1)
        .join(dealt, "_part")
        .withColumn("shard", F.size(F.filter("_ends", lambda end: end <= F.col("_rank"))).cast("int"))
        .withColumn("_order", key(3))
        .withColumn("_slice", F.shiftrightunsigned("_order", 32) * slices / F.lit(1 << 32))
        .withColumn("_slice", F.floor("_slice").cast("int"))
        .select(*columns, "shard", "_slice", "_order")
    )
    placed = settle(placed, "sharded")
    counts = placed.groupBy("shard", "_slice").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    inside = Window.partitionBy("shard", "_slice").orderBy("_order", *columns)
    return (
        placed.withColumn("_row", F.row_number().over(inside))
        .join(starts, ["shard", "_slice"])
        .select(*columns, "shard", (F.col("_first") + F.col("_row") - 1).alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Shards of whole documents: their sizes and checksums are read once, and only these are moved.

    A null text counts 8 bytes and has a null checksum.
    """
    text = F.encode("text", "utf-8")
    sized = narrow(docs, doc_id="doc_id", text="text").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    return shuffle_into_shards(settle(sized, "sizes"), shards, seed)
