"""Connected components of a table of links, without any component in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.session import settle


def label_components(pairs: DataFrame) -> DataFrame:
    """The smallest node of each node's component: `node`, `label` for every node in links (`a`, `b`).

    Each round takes the smallest label among a node's neighbours and then follows that label to its own
    label, so labels travel along a path in doubling steps. A round is one written table; the rounds
    end when no label changes.
    """
    both = settle(
        pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
                                       F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e"))
        .select("e.node", "e.other"),
        "edges",
    )
    labels = settle(
        both.groupBy("node").agg(F.min("other").alias("least")).select("node", F.least("node", "least").alias("label")),
        "labels",
    )
    while True:
        # A label is a node of the same component, so it has a label itself.
        targets = labels.select("label").distinct()
        jumps = targets.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label")
        jumped = labels.join(jumps, "label").select("node", F.col("next").alias("label"), F.col("label").alias("old"))
        offers = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(
            F.min("label").alias("offer")
        )
        step = settle(
            jumped.join(offers, "node").select("node", F.least("label", "offer").alias("label"), "old"), "labels"
        )
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels
