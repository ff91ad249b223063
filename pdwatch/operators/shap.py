"""Exact Shapley impacts of a tree ensemble against a background population, in log-odds.

For one leaf, a row and a background row matter only through the set of path intervals each
satisfies. So the whole background collapses to counts of the (leaf, set) pairs that occur: one aggregate, no table over
all sets. A leaf's share of a row is a sum over the background's sets that complete the row's set, and its weights follow
from the sizes of both sets alone. So a path may have any number of features. Explaining a row needs no shuffle and no join.

Ensembles whose sets are few in all become one expression with the sums worked out beforehand; others run on Arrow
batches, in which each distinct set of a leaf is worked out once. The results are the same.

Lundberg et al., "From local explanations to global understanding with explainable AI for trees"
(2020); Laberge and Pequignot, "Understanding interventional TreeSHAP" (2022).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pdwatch.operators.checks import require_columns, require_names
from pdwatch.operators.forest import Forest, Leaf, margin, missing, sql_number, within
from pdwatch.operators.quality import QualityError
from pdwatch.session import ship_package

# Above this many leaves, or sets of all leaves together, the expression would outgrow one compiled method.
EXPRESSION_LEAVES, EXPRESSION_SETS = 128, 1 << 12
# Pairs of sets that a worker compares at once.
HELD_PAIRS = 1 << 20
# Up to this many features on a leaf's path, its sets are numbers, which index a table; beyond that they are sorted.
NARROW = 6


@dataclass(frozen=True)
class Background:
    """Rows of the background population per leaf and set of satisfied intervals, for the sets that occur.

    `sets` has for each leaf an array [set, path feature] of booleans, `counts` the rows of each set.
    """

    rows: int
    sets: tuple[np.ndarray, ...]
    counts: tuple[np.ndarray, ...]

    def expected_margin(self, forest: Forest) -> float:
        """Mean log-odds: each leaf counts with the share of rows that satisfy its whole box."""
        return forest.base + sum(
            leaf.value * float(counts[sets.all(axis=1)].sum()) / self.rows
            for leaf, sets, counts in zip(forest.leaves, self.sets, self.counts)
        )


def satisfied(leaf: Leaf) -> Column:
    """The satisfied intervals of a leaf as a bit set."""
    return F.expr(" + ".join(f"IF({within(*interval)}, {1 << i}, 0)" for i, interval in enumerate(leaf.box)))


def _boxes(forest: Forest, order: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return [
        (
            np.array([order.index(f) for f, _, _ in leaf.box]),
            np.array([lo for _, lo, _ in leaf.box]),
            np.array([hi for _, _, hi in leaf.box]),
        )
        for leaf in forest.leaves
    ]


def _batch_sets(values: np.ndarray, box: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """[row, path feature]: whether the row satisfies the interval."""
    position, low, high = box
    picked = values[:, position]
    return ((picked > low) | (low == -np.inf)) & (picked <= high)


def _every_set(size: int) -> np.ndarray:
    """All sets of some features, in the order of their numbers."""
    return (np.arange(1 << size)[:, None] >> np.arange(size) & 1).astype(bool)


def _numbers(columns: np.ndarray, box: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """For each row the number of the set of intervals that it satisfies; `columns` has a row for each feature."""
    numbers = np.zeros(columns.shape[1], np.uint8)
    for bit, (position, low, high) in enumerate(zip(*box)):
        value = columns[position]
        inside = value <= high
        if low > -np.inf:
            inside &= value > low
        numbers |= inside.view(np.uint8) << np.uint8(bit)
    return numbers


def _distinct(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows of booleans, which of them each row is, and how often each occurs."""
    packed = np.packbits(sets, axis=1)
    names = np.ascontiguousarray(packed).view(f"V{packed.shape[1]}").ravel()
    _, first, of, counts = np.unique(names, return_index=True, return_inverse=True, return_counts=True)
    return sets[first], of, counts


def _is_small(forest: Forest) -> bool:
    sets = sum(1 << len(leaf.box) for leaf in forest.leaves)
    return len(forest.leaves) <= EXPRESSION_LEAVES and sets <= EXPRESSION_SETS


def background_counts(background: DataFrame, forest: Forest) -> Background:
    """One aggregate over the background. Rows that lack a feature of the model are no background.

    The result has at most as many sets for a leaf as the background has rows, and at most 2^depth.
    """
    require_columns(background, forest.features)
    background = background.where(f"NOT ({missing(forest)})")
    ship_package(background.sparkSession)
    order = list(forest.features)
    boxes = _boxes(forest, order)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            columns = np.ascontiguousarray(values.T)
            for i, box in enumerate(boxes):
                size = len(box[0])
                if size <= NARROW:
                    counts = np.bincount(_numbers(columns, box), minlength=1 << size)
                    sets, counts = _every_set(size)[counts > 0], counts[counts > 0]
                else:
                    sets, _, counts = _distinct(_batch_sets(values, box))
                held = [row.tobytes() for row in np.packbits(sets, axis=1)]
                yield pd.DataFrame({"leaf": i, "held": held, "n": counts})

    found = background.select(*[F.col(f).cast("double") for f in order]).mapInPandas(count, "leaf long, held binary, n long")
    counted = found.groupBy("leaf", "held").agg(F.sum("n").alias("n")).toPandas()
    sets, counts = [], []
    for i, leaf in enumerate(forest.leaves):
        own = counted[counted["leaf"] == i].sort_values("held")
        packed = np.frombuffer(b"".join(own["held"]), np.uint8).reshape(len(own), -(-len(leaf.box) // 8))
        sets.append(np.unpackbits(packed, axis=1, count=len(leaf.box)).astype(bool))
        counts.append(own["n"].to_numpy(np.int64))
    rows = int(counts[0].sum()) if counts else 0
    if not rows:
        raise QualityError("the background population is empty")
    return Background(rows, tuple(sets), tuple(counts))


def _weights(features: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares of a feature that only the row satisfies, and of one that only the background does.

    By how many features only the row satisfies (u) and how many only the background does (w):
    (u-1)! w! / (u+w)! and u! (w-1)! / (u+w)!.
    """
    row, other = np.zeros((features + 1, features + 1)), np.zeros((features + 1, features + 1))
    for u in range(features + 1):
        for w in range(features + 1 - u):
            ways = comb(u + w, u)
            row[u, w] = 1 / (u * ways) if u else 0.0
            other[u, w] = 1 / (w * ways) if w else 0.0
    return row, other


def leaf_impacts(x: np.ndarray, sets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[set, path feature]: part of a leaf's value that goes to each feature, summed over the background's rows.

    Only sets that complete a row's set matter: some feature outside both blocks every path to the leaf.
    """
    size = x.shape[1]
    for_row, for_other = _weights(size)
    lacks = ~sets
    u = lacks.sum(axis=1)
    out = np.zeros(x.shape)
    step = max(1, HELD_PAIRS // max(1, len(sets)))
    for start in range(0, len(x), step):
        part = x[start : start + step]
        w = size - part.sum(axis=1)
        completes = ((~part).astype(np.float64) @ lacks.T.astype(np.float64)) == 0
        # Where a set completes the row's, the features only the row satisfies are those the set lacks.
        weighted = completes * counts
        gained = (weighted * for_row[u[None, :], np.where(completes, w[:, None], 0)]) @ lacks
        lost = (weighted * for_other[u[None, :], np.where(completes, w[:, None], 0)]).sum(axis=1)
        out[start : start + step] = np.where(part, gained, -lost[:, None])
    return out


def impact_tables(forest: Forest, background: Background) -> list[np.ndarray]:
    """Per leaf, an array [set of the row, path feature] of impacts, for all sets: for small ensembles."""
    tables = []
    for leaf, sets, counts in zip(forest.leaves, background.sets, background.counts):
        tables.append(leaf.value / background.rows * leaf_impacts(_every_set(len(leaf.box)), sets, counts))
    return tables


def shap_vectors(
    df: DataFrame,
    forest: Forest,
    background: Background,
    features: Sequence[str],
    column: str = "impacts",
    digits: int | None = None,
    check_additivity: bool = False,
    tolerance: float = 1e-6,
) -> DataFrame:
    """Add the impact of each feature, as an array in the order of `features`.

    Small ensembles become one expression inside generated code. Larger ones run on Arrow batches, with the
    same results. A row that lacks a feature of the model has null impacts, as it has a null score. With
    `check_additivity`, a row whose impacts and the background's mean log-odds do not sum to its own log-odds within
    `tolerance` raises an error when it is computed; the check is made before rounding.
    """
    order = require_names(features, "features")
    require_columns(df, order)
    unknown = sorted(set(forest.features) - set(order))
    if unknown:
        raise ValueError(f"the model uses features that are not listed: {', '.join(unknown)}")
    make = _by_expression if _is_small(forest) else _by_batch
    made = make(df, forest, background, order, column, None if check_additivity else digits)
    if not check_additivity:
        return made
    total = F.aggregate(column, F.lit(background.expected_margin(forest)), lambda a, v: a + v)
    gap = F.abs(margin(forest) - total)
    error = F.raise_error(F.concat(F.lit("impacts do not add up, by "), gap.cast("string")))
    checked = F.when(gap > tolerance, error.cast("array<double>")).otherwise(F.col(column))
    made = made.withColumn(column, checked)
    return made if digits is None else made.withColumn(column, F.transform(column, lambda v: F.round(v, digits)))


def _by_expression(
    df: DataFrame, forest: Forest, background: Background, order: list[str], column: str, digits: int | None
) -> DataFrame:
    tables = impact_tables(forest, background)
    sets = {f"__set_{i}": satisfied(leaf) for i, leaf in enumerate(forest.leaves)}
    terms: dict[str, list[str]] = {f: [] for f in order}
    for i, (leaf, table) in enumerate(zip(forest.leaves, tables)):
        for j, (feature, _, _) in enumerate(leaf.box):
            if np.any(table[:, j]):
                entries = ", ".join(sql_number(v) for v in table[:, j])
                terms[feature].append(f"get(array({entries}), __set_{i})")
    sums = [" + ".join(terms[f]) or "0.0D" for f in order]
    if digits is not None:
        sums = [f"round({s}, {digits})" for s in sums]
    vector = F.expr(f"CASE WHEN {missing(forest)} THEN NULL ELSE array({', '.join(sums)}) END")
    return df.withColumns(sets).withColumn(column, vector).drop(*sets)


def _by_batch(
    df: DataFrame, forest: Forest, background: Background, order: list[str], column: str, digits: int | None
) -> DataFrame:
    ship_package(df.sparkSession)
    boxes = _boxes(forest, order)
    values_of = [leaf.value / background.rows for leaf in forest.leaves]
    # Paths of few features have one table of all their sets, whatever the number of rows.
    tables = [
        value * leaf_impacts(_every_set(len(box[0])), sets, counts) if len(box[0]) <= NARROW else None
        for box, value, sets, counts in zip(boxes, values_of, background.sets, background.counts)
    ]
    # Sent once to each executor: for each leaf at most a row for each background row, or 2^NARROW rows.
    known = df.sparkSession.sparkContext.broadcast((background.sets, background.counts, tables))

    used = [order.index(feature) for feature in forest.features]

    def explain(values: np.ndarray) -> np.ndarray:
        columns = np.ascontiguousarray(values.T)
        impacts = np.zeros((len(order), len(values)))
        for box, value, sets, counts, table in zip(boxes, values_of, *known.value):
            if table is None:
                distinct, of, _ = _distinct(_batch_sets(values, box))
                impacts[box[0]] += (value * leaf_impacts(distinct, sets, counts))[of].T
                continue
            numbers = _numbers(columns, box)
            for at, position in enumerate(box[0]):
                impacts[position] += table[:, at][numbers]
        return np.ascontiguousarray(impacts.T)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def vector(frame: pd.DataFrame) -> pd.Series:
        values = frame.to_numpy(dtype=float)
        found = pd.Series(list(explain(values)), dtype=object)
        found[np.isnan(values[:, used]).any(axis=1)] = None
        return found

    vectors = df.withColumn(column, vector(F.struct(*[F.col(f).cast("double").alias(f) for f in order])))
    return vectors if digits is None else vectors.withColumn(column, F.transform(column, lambda v: F.round(v, digits)))
