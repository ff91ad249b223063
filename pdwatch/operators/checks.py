"""Argument and schema checks that run on the driver, before any job starts."""

from __future__ import annotations

from collections.abc import Sequence
from numbers import Real

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def require_names(names: Sequence[str], what: str) -> list[str]:
    """A non-empty list of distinct, non-blank names."""
    listed = list(names)
    if not listed:
        raise ValueError(f"{what} must not be empty")
    if any(not isinstance(n, str) or not n.strip() for n in listed):
        raise ValueError(f"{what} must be non-blank strings")
    if len(set(listed)) != len(listed):
        raise ValueError(f"{what} must be unique")
    return listed


def require_numeric(df: DataFrame, names: Sequence[str]) -> None:
    wrong = sorted(n for n in names if not isinstance(df.schema[n].dataType, T.NumericType))
    if wrong:
        raise TypeError(f"columns must be numeric: {', '.join(wrong)}")


def require_real(value: object, what: str) -> float:
    if isinstance(value, bool) or not isinstance(value, Real):
        raise TypeError(f"{what} must be a number")
    return float(value)


def require_unit_interval(value: object, what: str) -> float:
    number = require_real(value, what)
    if not 0.0 <= number <= 1.0:
        raise ValueError(f"{what} must lie between 0 and 1")
    return number


def require_non_negative(value: object, what: str) -> float:
    number = require_real(value, what)
    if not number >= 0.0:
        raise ValueError(f"{what} must not be negative")
    return number


def require_count(value: object, what: str, minimum: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int):
        raise TypeError(f"{what} must be a whole number")
    if value < minimum:
        raise ValueError(f"{what} must be at least {minimum}")
    return value


def require_choice(value: object, choices: Sequence[str], what: str) -> str:
    if value not in choices:
        raise ValueError(f"{what} must be one of {', '.join(choices)}")
    return str(value)


def require_top_n(value: object) -> int | str:
    return "all" if value == "all" else require_count(value, "top_n")


def require_text(value: object, what: str) -> str:
    if not isinstance(value, str):
        raise TypeError(f"{what} must be a string")
    if not value.strip():
        raise ValueError(f"{what} must not be blank")
    return value
