"""The model and run settings the registered queries use."""

from __future__ import annotations

from pdwatch.operators.forest import forest_of
from pdwatch.operators.registry import DEFAULT_REGISTRY, registry_from
from pdwatch.schemas import FEATURE_RANGES

MODEL_VERSION = "v1.0"
ENVIRONMENT = "development"
RUN_DATE = "2001-12-31"

# Three trees as (feature, threshold, left, right); left holds x <= threshold, numbers are log-odds.
TREES = (
    (
        "fico",
        620.0,
        ("utilization", 0.55, ("history", 12.0, 0.45, 0.2), 0.9),
        ("fico", 740.0, ("loan_amount", 180000.0, -0.15, 0.1), -0.6),
    ),
    (
        "utilization",
        0.45,
        ("income", 60000.0, -0.05, -0.35),
        ("debt", 9000.0, 0.25, ("accounts", 3.0, 0.4, 0.55)),
    ),
    (
        "history",
        10.0,
        ("age", 30.0, 0.5, ("age", 55.0, 0.3, 0.15)),
        ("employment", 8.0, 0.05, ("balance", 3000.0, -0.05, -0.25)),
    ),
)
BASE = -0.9
FOREST = forest_of(BASE, *TREES)

# Ranges of a lender that takes less than the model's contract allows; the others are the contract's.
LENDER_RANGES = tuple(
    {
        "fico": ("fico", 580.0, True, 850.0),
        "income": ("income", 60000.0, True, None),
        "utilization": ("utilization", 0.0, True, 0.6),
    }.get(limits[0], limits)
    for limits in FEATURE_RANGES
)

# A registry with priorities for the business ranking; the rest keeps the default priority.
PRIORITIES = {"utilization": 1, "history": 2, "fico": 3}
PRIORITY_REGISTRY = registry_from(
    {
        name: {**entry._asdict(), "metadata": {"business_priority": PRIORITIES[name]} if name in PRIORITIES else None}
        for name, entry in DEFAULT_REGISTRY.items()
    }
)
