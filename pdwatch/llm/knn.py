"""Exact top-k by inner product with a Voronoi join.

One more coordinate gives all data the same length and queries none of it; then the largest inner products are
the nearest neighbours. Data and queries fall into the cells of pivots. From each cell's count, and
its smallest and largest distances to the pivot, follows for each group of queries how far its neighbours can
lie at most, and so which ring of every cell it needs. Only those vectors are sent to the group, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pdwatch.llm.common import narrow
from pdwatch.session import settle

SCALE = 1024
#: Cells of the data; the pivots are the vectors with the smallest hashes.
PIVOTS = 64
#: Groups of query cells. Each vector is sent at most once to each block of a group.
GROUPS = 6
#: Vectors and queries that meet in one task.
DATA_BLOCK = 8192
QUERY_BLOCK = 2048

_LONGEST = float(2**62)
_EXACT = float(2**53)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """`row` (a number of the row), `vec_id`, `v` (64-bit components, packed), `norm` for vectors that are whole.

    Vectors that are null, or hold a null or a non-finite component, are left out.
    """

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, vec_id, values in zip(batch["row"], batch["vec_id"].array, batch["embedding"], strict=True):
                if values is None:
                    continue
                whole = np.asarray(values, np.float64)
                if np.isfinite(whole).all():
                    v = np.clip(np.floor(scale * whole), -_LONGEST, _LONGEST).astype(np.int64)
                    norm = float(np.linalg.norm(v.astype(np.float64)))
                    rows.append((row, vec_id, v.astype("<i8").tobytes(), norm))
            frame = pd.DataFrame(rows, columns=["row", "vec_id", "v", "norm"])
            yield frame.astype({"row": "int64", "vec_id": "Int64", "norm": "float64"})

    source = narrow(vectors, vec_id="vec_id", embedding="embedding").withColumn("row", F.monotonically_increasing_id())
    return source.mapInPandas(convert, "row bigint, vec_id bigint, v binary, norm double")


def _matrix(packed: pd.Series, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones count as filled with zeros."""
    out = np.zeros((len(packed), width), np.int64)
    for i, data in enumerate(packed):
        values = np.frombuffer(data, "<i8")
        out[i, : len(values)] = values
    return out


def scores(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond the range of a long they are held at its ends."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * queries.shape[1]
    if bound < _EXACT:
        return (queries.astype(np.float64) @ data.T.astype(np.float64)).astype(np.int64)
    whole = queries.astype(object) @ data.T.astype(object)
    return np.clip(whole, -(2**63), 2**63 - 1).astype(np.int64)


def _distances(points: np.ndarray, extra: np.ndarray, pivots: np.ndarray, pivot_extra: np.ndarray) -> np.ndarray:
    """Distances between points and pivots with their additional coordinate."""
    a = np.column_stack([points.astype(np.float64), extra])
    b = np.column_stack([pivots.astype(np.float64), pivot_extra])
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(squares, 0))


class Plan:
    """Which ring of each cell every query group needs, from the summaries of the cells."""

    def __init__(
        self, between: np.ndarray, nearest: dict[int, list[float]], reach: np.ndarray, groups: np.ndarray, k: int
    ) -> None:
        """`nearest`: the smallest distances in each data cell; `reach`: of each query cell, below 0 if empty."""
        cells = len(reach)
        count = int(groups.max(initial=-1)) + 1
        self.low = np.full((count, cells), np.inf)
        self.high = np.full((count, cells), -np.inf)
        slack = 1e-6 * (1 + float(between.max(initial=0)))
        for cell in np.flatnonzero(reach >= 0):
            bounds = [reach[cell] + between[cell, j] + d for j, held in nearest.items() for d in held]
            bounds.sort()
            # One more than k, since a query's own row may be among them.
            limit = bounds[k] if len(bounds) > k else np.inf
            group = groups[cell]
            low = between[cell] - reach[cell] - limit - slack
            high = between[cell] + reach[cell] + limit + slack
            self.low[group] = np.minimum(self.low[group], low)
            self.high[group] = np.maximum(self.high[group], high)

    def needs(self, cells: np.ndarray, distances: np.ndarray) -> list[np.ndarray]:
        """For each group, the positions of the points it needs."""
        return [
            np.flatnonzero((distances >= low[cells]) & (distances <= high[cells]))
            for low, high in zip(self.low, self.high, strict=True)
        ]


def _best(values: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest values, ties to smaller names."""
    if len(values) > k:
        least = np.partition(values, len(values) - k)[len(values) - k]
        chosen = np.flatnonzero(values >= least)
    else:
        chosen = np.arange(len(values))
    return chosen[np.lexsort((names[chosen], ~values[chosen]))[:k]]


def _solver(width: int, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def solve(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(data):
            data = data.sort_values(["vec_id", "row"], na_position="last")
            ids, data_rows = data["vec_id"].to_numpy(), data["row"].to_numpy()
            place = np.arange(len(data))  # in order of ids, so a tie goes to the smaller place
            table = scores(_matrix(queries["v"], width), _matrix(data["v"], width))
            for query, query_id, values in zip(queries["row"], queries["vec_id"], table, strict=True):
                others = np.flatnonzero(data_rows != query)
                for at in others[_best(values[others], place[others], k)]:
                    rows.append((query, query_id, ids[at], data_rows[at], values[at]))
        frame = pd.DataFrame(rows, columns=["query", "query_id", "vec_id", "row", "score"])
        return frame.astype({"vec_id": "Int64"})

    return solve


def voronoi_top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    """`query_id`, `rank`, `vec_id`, `score` of the `k` largest integer inner products of each query.

    `is_query` is a condition on `vec_id`. Every row but the query's own is a candidate, also rows that repeat
    its id or components. A candidate without an id comes last among equal scores. Fewer candidates than `k` are all
    returned; a table without whole vectors or queries gives no rows. Shorter vectors count as filled with zeros.
    """
    rows = settle(quantized(vectors), "vectors")
    width, longest = rows.agg(F.max(F.length("v")), F.max("norm")).first()
    width, longest = (width or 0) // 8, longest or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id", "v"), "row").limit(PIVOTS).toPandas()
    pivots = _matrix(sample["v"], width)
    pivot_extra = np.sqrt(np.maximum(longest**2 - sample["norm"].to_numpy() ** 2, 0))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            points = _matrix(batch["v"], width)
            extra = np.sqrt(np.maximum(longest**2 - batch["norm"].to_numpy() ** 2, 0))
            own = _distances(points, extra, pivots, pivot_extra)
            asked = _distances(points, np.zeros(len(points)), pivots, pivot_extra)
            at, cell, query_cell = np.arange(len(points)), own.argmin(1), asked.argmin(1)
            yield batch[["row", "vec_id", "v"]].assign(
                cell=cell, distance=own[at, cell], query_cell=query_cell, query_distance=asked[at, query_cell]
            )

    cells = settle(
        rows.mapInPandas(
            assign,
            "row bigint, vec_id bigint, v binary, cell int, distance double, query_cell int, query_distance double",
        ),
        "cells",
    )
    closest = Window.partitionBy("cell").orderBy("distance")
    near = cells.select("cell", "distance").withColumn("n", F.row_number().over(closest)).where(F.col("n") <= k + 1)
    nearest: dict[int, list[float]] = {}
    for cell, distance, _ in near.collect():  # PIVOTS times k + 1 numbers
        nearest.setdefault(cell, []).append(distance)
    asked = cells.where(is_query)
    reach = np.full(len(sample), -1.0)
    sizes = np.zeros(len(sample), np.int64)
    for cell, distance, count in asked.groupBy("query_cell").agg(F.max("query_distance"), F.count("*")).collect():
        reach[cell], sizes[cell] = distance, count
    between = _distances(pivots, pivot_extra, pivots, pivot_extra)
    groups = _group_cells(between, sizes, GROUPS)
    plan = Plan(between, nearest, reach, groups, k)
    group_sizes = np.bincount(groups, sizes, len(plan.low)).astype(int) if len(sample) else np.zeros(0, int)
    query_blocks = [max(1, -(-size // QUERY_BLOCK)) for size in group_sizes.tolist()]
    data_blocks = max(1, -(-cells.count() // DATA_BLOCK))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            needed = plan.needs(batch["cell"].to_numpy(), batch["distance"].to_numpy())
            for group, positions in enumerate(needed):
                for block in range(query_blocks[group]):
                    part = batch.iloc[positions][["row", "vec_id", "v"]]
                    yield part.assign(group=group, query_block=block, data_block=part["row"] % data_blocks)

    schema = "row bigint, vec_id bigint, v binary, group int, query_block int, data_block int"
    data = cells.mapInPandas(send, schema)
    group_of = F.element_at(F.array(*[F.lit(int(g)) for g in groups] or [F.lit(0)]), F.col("query_cell") + 1)
    blocks_of = F.element_at(F.array(*[F.lit(n) for n in query_blocks] or [F.lit(1)]), F.col("group") + 1)
    queries = (
        asked.withColumn("group", group_of)
        .withColumn("query_block", F.pmod(F.xxhash64("row"), blocks_of).cast("int"))
        .withColumn("data_block", F.explode(F.sequence(F.lit(0), F.lit(data_blocks - 1))))
        .select("row", "vec_id", "v", "group", "query_block", "data_block")
    )
    keys = ["group", "query_block", "data_block"]
    local = (
        queries.groupBy(*keys)
        .cogroup(data.groupBy(*keys))
        .applyInPandas(_solver(width, k), "query bigint, query_id bigint, vec_id bigint, row bigint, score bigint")
    )
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return (
        local.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _group_cells(between: np.ndarray, sizes: np.ndarray, groups: int) -> np.ndarray:
    """Give each cell to one of `groups` groups: neighbouring cells together, about equal numbers of queries."""
    cells = len(sizes)
    if not cells:
        return np.zeros(0, int)
    order, left = [0], set(range(1, cells))
    while left:
        order.append(min(left, key=lambda cell: between[order[-1], cell]))
        left.remove(order[-1])
    counted = np.cumsum(sizes[order])
    share = max(int(counted[-1]), 1)
    out = np.zeros(cells, int)
    out[order] = np.minimum((counted - sizes[order]) * groups // share, groups - 1)
    return out
