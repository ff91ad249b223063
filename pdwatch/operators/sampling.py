"""Background loading and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pdwatch.config import BACKGROUND_SEED
from pdwatch.operators.checks import require_columns, require_count, require_names
from pdwatch.operators.ordering import running_totals
from pdwatch.operators.quality import check_background, enforce
from pdwatch.schemas import ID


#: Hexadecimal digits of the hash that a round of the selection counts by, and the rows it may collect at its end.
COUNTED_DIGITS, COLLECTED = 3, 4096


def sample_rows(df: DataFrame, size: int | None, seed: int = BACKGROUND_SEED, id_column: str = ID) -> DataFrame:
    """`size` rows without replacement, the same ones for the same seed; all rows when size is None.

    The order is a hash of identifier and seed. Where its last row lies is found by counting rows by the leading digits of
    the hash, then by further digits of the one range that holds it, until few rows are left. The sample is then a
    filter: no sort, and no task that gathers it. Of rows that repeat the last identifier of the sample some stay, so many
    that the size is kept.
    """
    require_columns(df, [id_column])
    if size is None:
        return df
    require_count(size, "sample size")
    identifier = F.col(f"`{id_column}`").cast("string")
    name = F.coalesce(F.md5(F.concat(identifier, F.lit(f"|{seed}"))), F.lit(""))
    left, prefix = size, ""
    while True:
        inside = df.where(name.startswith(prefix)) if prefix else df
        digits = F.substring(name, len(prefix) + 1, COUNTED_DIGITS)
        # At most 16 to the power of COUNTED_DIGITS rows, and one for rows without an identifier.
        counts = sorted((row["d"], row["n"]) for row in inside.groupBy(digits.alias("d")).agg(F.count("*").alias("n")).collect())
        if sum(n for _, n in counts) <= left:
            return df if not prefix else df.where(name.substr(1, len(prefix)) <= prefix)
        for found, n in counts:
            if n >= left:
                break
            left -= n
        prefix += found
        if n <= COLLECTED or len(found) < COUNTED_DIGITS or len(prefix) >= 32:
            break
    order = F.struct(name.alias("h"), F.coalesce(identifier, F.lit("")).alias("i"))
    near = df.where(name.startswith(prefix) if prefix else name == "")
    named = near.groupBy(order.alias("o")).agg(F.count("*").alias("n")).orderBy("o").limit(COLLECTED).collect()
    for row in named:
        if row["n"] >= left:
            break
        left -= row["n"]
    last = F.struct(F.lit(row["o"]["h"]).alias("h"), F.lit(row["o"]["i"]).alias("i"))
    if row["n"] == left:
        return df.where(order <= last)
    return df.where(order < last).unionByName(df.where(order == last).limit(left))


def load_background(
    df: DataFrame,
    features: Sequence[str],
    size: int | None,
    seed: int = BACKGROUND_SEED,
    id_column: str = ID,
) -> DataFrame:
    """Validated, sampled, and projected to the features in model order."""
    names = require_names(features, "features")
    enforce(check_background(df, names))
    return sample_rows(df.select(id_column, *names), size, seed, id_column).select(*names)


def with_default_identifiers(df: DataFrame, order_by: Sequence[str] | None = None, id_column: str = ID) -> DataFrame:
    """Number the rows from 0 on in the order of `order_by`, for a table without identifiers.

    All columns in table order are used if none are named, so the numbers follow from the values alone and rows that get
    either of two numbers are equal. Rows are numbered inside ranges of that order, and the ranges' sizes give their first
    numbers; no task sees all rows.
    """
    if id_column in df.columns:
        raise ValueError(f"the table has a column {id_column} already")
    names = require_names(order_by or df.columns, "order columns")
    require_columns(df, names)
    numbered = running_totals(df, [F.col(f"`{n}`").asc_nulls_first() for n in names], {id_column: F.lit(1)})
    return numbered.select((F.col(id_column) - 1).cast("string").alias(id_column), *[F.col(f"`{c}`") for c in df.columns])


def bootstrap_rows(df: DataFrame, size: int, seed: int = BACKGROUND_SEED, id_column: str = ID) -> DataFrame:
    """`size` draws with replacement, numbered from 0 in `draw`; the same ones for the same rows and seed.

    Rows are numbered in the order of their identifiers, which must be unique, and a hash of the draw and the seed names
    a row. Neither the layout of the table nor the number of tasks decides.
    """
    require_columns(df, [id_column])
    require_count(size, "sample size")
    numbered = running_totals(df, [F.col(id_column).cast("string")], {"__row": F.lit(1)}, {"__rows": F.lit(1)})
    rows = numbered.select("__rows").first()
    if rows is None:
        raise ValueError("cannot draw from an empty table")
    digits = F.substring(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed))).cast("binary")), 1, 15)
    draws = df.sparkSession.range(size).select(
        F.col("id").alias("draw"), (F.conv(digits, 16, 10).cast("bigint") % F.lit(rows[0]) + 1).alias("__row")
    )
    return draws.join(numbered, "__row").select("draw", *df.columns)
