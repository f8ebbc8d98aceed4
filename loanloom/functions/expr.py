"""Row-level building blocks. All are plain Spark expressions, no Python UDF."""

from __future__ import annotations

import sys
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_column(value: ColumnLike) -> Column:
    return F.col(value) if isinstance(value, str) else value


def safe_div(num: ColumnLike, den: ColumnLike, mode: str = "null") -> Column:
    """Quotient as double. ``null``: x/0 is NULL; ``ieee``: x/0 is infinite, and 0/0 missing."""
    num = as_column(num).cast("double")
    den = as_column(den).cast("double")
    if mode == "null":
        return F.try_divide(num, den)
    if mode != "ieee":
        raise ValueError(f"unknown division mode {mode!r}")
    at_zero = (
        F.when(num > 0, F.lit(float("inf")))
        .when(num < 0, F.lit(float("-inf")))
    )
    return F.when(den == 0, at_zero).otherwise(F.try_divide(num, den))


def clip_at_zero(value: ColumnLike) -> Column:
    """Negative values become 0; missing stays missing (``greatest`` would not)."""
    value = as_column(value)
    return F.when(value <= 0, F.lit(0)).otherwise(value)


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def sql_literal(value: object) -> str:
    """A value as it is written in SQL text."""
    if isinstance(value, Decimal):
        return f"{value:f}BD"
    if isinstance(value, str):
        escaped = value.replace("\\", "\\\\").replace("'", "\\'")
        return f"'{escaped}'"
    return repr(value)


def is_missing(column: ColumnLike, kind: str) -> Column:
    """NULL, or NaN in a column of floating-point ``kind``."""
    column = as_column(column)
    return column.isNull() | F.isnan(column) if kind in ("float", "double") else column.isNull()


def dummy(column: str, value: object | None) -> str:
    """SQL text of the indicator of one category; ``None`` indicates missing."""
    hit = f"`{column}` IS NULL" if value is None else f"`{column}` = {sql_literal(value)}"
    return f"(CASE WHEN {hit} THEN 1 ELSE 0 END)"


def null_if_value(column: ColumnLike, value: object) -> Column:
    """Sentinel removal; a missing sentinel changes nothing."""
    column = as_column(column)
    if value is None:
        return column
    return F.nullif(column, F.lit(value))


def finite_or_zero(column: ColumnLike) -> Column:
    """Missing and NaN to 0, infinities to the largest finite double."""
    column = as_column(column).cast("double")
    largest = sys.float_info.max
    return (
        F.when(column.isNull() | F.isnan(column), F.lit(0.0))
        .when(column == float("inf"), F.lit(largest))
        .when(column == float("-inf"), F.lit(-largest))
        .otherwise(column)
    )


def ordinal_code(column: ColumnLike, codes: Mapping[str, int], otherwise: int) -> Column:
    """E5: fixed code per category, missing included in ``otherwise``."""
    column = as_column(column)
    result = None
    for value, code in codes.items():
        branch = (column == value, F.lit(code))
        result = F.when(*branch) if result is None else result.when(*branch)
    return F.lit(otherwise) if result is None else result.otherwise(F.lit(otherwise))
