"""Names of report folders and files."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pdwatch.operators.checks import require_text


def clean_prefix(prefix: str) -> str:
    if not isinstance(prefix, str):
        raise TypeError("prefix must be a string")
    cleaned = prefix.strip("/ ")
    if not cleaned:
        raise ValueError("prefix must not be blank")
    return cleaned


def report_folder(prefix: str, model_version: str, report_date: dt.date) -> str:
    if not isinstance(report_date, dt.date):
        raise TypeError("report_date must be a date")
    return f"{clean_prefix(prefix)}/model_version={require_text(model_version, 'model_version')}/dt={report_date.isoformat()}"


def artifact_paths(names: Sequence[str], prefix: str, model_version: str, report_date: dt.date) -> dict[str, str]:
    if not names:
        raise ValueError("no artifacts given")
    folder = report_folder(prefix, model_version, report_date)
    return {n: f"{folder}/{n}" for n in names}


def report_path(prefix: Column, model_version: Column, report_date: Column) -> Column:
    """The same folder as an expression over rows."""
    return F.concat_ws(
        "/",
        F.regexp_replace(prefix, "^[/ ]+|[/ ]+$", ""),
        F.concat(F.lit("model_version="), model_version),
        F.concat(F.lit("dt="), F.date_format(report_date, "yyyy-MM-dd")),
    )
