"""Rounding with the tie rule of NumPy, which the reports follow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even(value: Column, digits: int = 4) -> Column:
    """Scale, round to the nearest integer with ties to even, scale back (float arithmetic)."""
    scale = float(10**digits)
    return F.rint(value * F.lit(scale)) / F.lit(scale)
