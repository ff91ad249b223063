"""The explanation job: score, decide, attribute, select reasons, nest.

Everything about one application is computed inside its row, so between the scan of the
applications and the written records there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.config import CLASSIFICATION_THRESHOLD
from pdwatch.operators.checks import require_choice
from pdwatch.operators.forest import Forest, score
from pdwatch.operators.impacts import typical_values, with_impact_entries
from pdwatch.operators.reasons import reasons_in_row
from pdwatch.operators.records import explanation_records
from pdwatch.operators.registry import DEFAULT_REGISTRY, Entry
from pdwatch.operators.shap import Background, background_counts, shap_vectors
from pdwatch.schemas import FEATURES, ID
from pdwatch.sources.tables import write_explanations


def explained_rows(
    applications: DataFrame,
    forest: Forest,
    background: Background,
    typical: Mapping[str, float],
    features: Sequence[str] = FEATURES,
    digits: int | None = None,
) -> DataFrame:
    """Applications with `default_probability`, `impacts` and `contributions`."""
    scored = score(applications, forest, "default_probability")
    return with_impact_entries(shap_vectors(scored, forest, background, features, digits=digits), features, typical)


def explain_batch(
    applications: DataFrame,
    forest: Forest,
    background: DataFrame,
    model_version: str,
    threshold: float = CLASSIFICATION_THRESHOLD,
    features: Sequence[str] = FEATURES,
    registry: Mapping[str, Entry] = DEFAULT_REGISTRY,
    direction: str = "adverse",
    ranking: str = "impact",
    top_n: int | str = 4,
    minimum: float = 0.0,
    timestamp: str = "ts",
    metadata: Mapping[str, str] | None = None,
    persistence: str = "none",
    path: str | None = None,
    digits: int | None = None,
) -> DataFrame:
    """One explanation record per application; with persistence "table", written below `path`."""
    require_choice(persistence, ("none", "table"), "persistence")
    rows = explained_rows(
        applications, forest, background_counts(background, forest), typical_values(background, features), features, digits
    )
    chosen = rows.withColumn(
        "reasons", reasons_in_row(F.col("contributions"), registry, direction, ranking, top_n, minimum)
    ).select(
        ID,
        timestamp,
        "default_probability",
        "reasons",
        # Stored from the impact that raises the risk most to the one that lowers it most.
        F.sort_array(
            F.transform("contributions", lambda c, i: F.struct(c["ranked_impact_positive"].alias("rank"), i.alias("at"), c.alias("entry")))
        )["entry"].alias("contributions"),
    )
    records = explanation_records(
        chosen, "default_probability", threshold, model_version, top_n, direction, timestamp, metadata
    )
    if persistence == "table":
        if not path:
            raise ValueError("persistence needs a path")
        write_explanations(records, path)
    return records
