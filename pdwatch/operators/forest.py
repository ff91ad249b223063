"""Tree ensembles as leaf tables, and their scores as column expressions.

A leaf is a value and a box: for each feature on its path an interval low < x <= high. The sum of
the values of the leaves a row falls into, one per tree, plus the base is the row's log-odds.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pdwatch.operators.checks import require_columns

INFINITY = float("inf")


@dataclass(frozen=True)
class Leaf:
    tree: int
    value: float
    box: tuple[tuple[str, float, float], ...]


@dataclass(frozen=True)
class Forest:
    """`trees` has the nested (feature, threshold, left, right) form of the same leaves by tree, where it is known."""

    base: float
    leaves: tuple[Leaf, ...]
    trees: tuple[tuple[int, tuple | float], ...] = ()

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(sorted({f for leaf in self.leaves for f, _, _ in leaf.box}))

    @property
    def depth(self) -> int:
        return max(len(leaf.box) for leaf in self.leaves)


def leaves_of(tree: int, node: tuple | float, box: dict[str, tuple[float, float]] | None = None) -> list[Leaf]:
    """Leaves of a nested (feature, threshold, left, right) tree; left holds x <= threshold."""
    box = box or {}
    if not isinstance(node, tuple):
        return [Leaf(tree, float(node), tuple((f, lo, hi) for f, (lo, hi) in sorted(box.items())))]
    feature, threshold, left, right = node
    low, high = box.get(feature, (-INFINITY, INFINITY))
    return leaves_of(tree, left, {**box, feature: (low, min(high, threshold))}) + leaves_of(
        tree, right, {**box, feature: (max(low, threshold), high)}
    )


def forest_of(base: float, *trees: tuple) -> Forest:
    return Forest(base, tuple(leaf for i, t in enumerate(trees) for leaf in leaves_of(i, t)), tuple(enumerate(trees)))


def sql_name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def sql_number(value: float) -> str:
    return f"{float(value)!r}D"


def within(feature: str, low: float, high: float) -> str:
    """SQL text: whether a row satisfies one interval of a leaf."""
    sides = []
    if low > -INFINITY:
        sides.append(f"{sql_name(feature)} > {sql_number(low)}")
    if high < INFINITY:
        sides.append(f"{sql_name(feature)} <= {sql_number(high)}")
    return " AND ".join(sides)


def missing(forest: Forest) -> str:
    """SQL text: whether a row lacks a feature of the model. Null and NaN are missing, infinities are values."""
    tests = [f"{sql_name(f)} IS NULL OR isnan(CAST({sql_name(f)} AS DOUBLE))" for f in forest.features]
    return " OR ".join(tests) or "false"


def _descent(node: tuple | float) -> str:
    """SQL text: the value of the leaf that a row reaches from a node, by one comparison a level."""
    if not isinstance(node, tuple):
        return sql_number(node)
    feature, threshold, left, right = node
    return f"IF({sql_name(feature)} <= {sql_number(threshold)}, {_descent(left)}, {_descent(right)})"


def margin(forest: Forest) -> Column:
    """Log-odds of a row: the base, and per tree the value of the leaf whose box holds the row.

    A row that lacks a feature has none: it satisfies no interval, so no leaf may claim it. A row descends trees whose
    nested form is known; else it tries their leaves one by one.
    """
    terms = [sql_number(forest.base)]
    if forest.trees:
        terms += [_descent(tree) for _, tree in forest.trees]
        return F.expr(f"CASE WHEN {missing(forest)} THEN NULL ELSE {' + '.join(terms)} END")
    for tree in sorted({leaf.tree for leaf in forest.leaves}):
        *cases, last = [leaf for leaf in forest.leaves if leaf.tree == tree]
        whens = " ".join(
            f"WHEN {' AND '.join(within(*i) for i in leaf.box)} THEN {sql_number(leaf.value)}" for leaf in cases
        )
        terms.append(f"CASE {whens} ELSE {sql_number(last.value)} END")
    return F.expr(f"CASE WHEN {missing(forest)} THEN NULL ELSE {' + '.join(terms)} END")


def probability(log_odds: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-log_odds))


def score(df: DataFrame, forest: Forest, column: str = "default_probability") -> DataFrame:
    require_columns(df, forest.features)
    return df.withColumn(column, probability(margin(forest)))


def apply_scorer(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], column: str) -> DataFrame:
    """Score with a given function of DataFrames, such as a fitted model's `transform`."""
    scored = scorer(df)
    require_columns(scored, [*df.columns, column])
    return scored


def forest_from_gbt(spark: SparkSession, model_path: str, features: tuple[str, ...]) -> Forest:
    """The leaf table of a saved gradient-boosted classifier.

    Reads the node table of the saved model, whose size is that of the model, not of any data. The
    classifier's probability is the logistic function of twice its margin, so leaf values are
    doubled to give log-odds.
    """
    nodes = spark.read.parquet(f"{model_path}/data")
    weights = spark.read.parquet(f"{model_path}/treesMetadata")
    require_columns(nodes, ["treeID", "nodeData"])
    require_columns(weights, ["_1", "_3"])
    weight_of = {r["_1"]: r["_3"] for r in weights.select("_1", "_3").collect()}
    trees: dict[int, dict[int, object]] = {}
    for row in nodes.collect():
        trees.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]

    def nested(tree: int, node_id: int) -> tuple | float:
        node = trees[tree][node_id]
        if node["leftChild"] < 0:
            return 2.0 * weight_of[tree] * node["prediction"]
        split = node["split"]
        if split["numCategories"] >= 0:
            raise ValueError("categorical splits are not supported")
        return (
            features[split["featureIndex"]],
            split["leftCategoriesOrThreshold"][0],
            nested(tree, node["leftChild"]),
            nested(tree, node["rightChild"]),
        )

    leaves: list[Leaf] = []
    split_trees: list[tuple[int, tuple | float]] = []
    base = 0.0
    for tree in sorted(trees):
        root = nested(tree, 0)
        own = leaves_of(tree, root)
        if len(own) == 1:
            base += own[0].value
        else:
            leaves += own
            split_trees.append((tree, root))
    return Forest(base, tuple(leaves), tuple(split_trees))
