"""Interquartile fences and what to do with values outside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.operators.quantiles import column_quantiles

Fences = Mapping[str, tuple[float, float]]


def fence_table(
    df: DataFrame, columns: Sequence[str], q1: float = 0.25, q3: float = 0.75, approx: bool = False
) -> DataFrame:
    """O1: ``(column, low, up)``, 1.5 interquartile ranges outside the quartiles."""
    low, high = F.element_at("q", 1), F.element_at("q", 2)
    reach = 1.5 * (high - low)
    return column_quantiles(df, columns, [q1, q3], approx).select(
        "column", (low - reach).alias("low"), (high + reach).alias("up")
    )


def fit_fences(
    df: DataFrame, columns: Sequence[str], q1: float = 0.25, q3: float = 0.75, approx: bool = False
) -> dict[str, tuple[float, float]]:
    """O1 on the driver: two numbers per column, used as literals afterwards."""
    return {r["column"]: (r["low"], r["up"]) for r in fence_table(df, columns, q1, q3, approx).collect()}


def outside(column: str, fences: Fences) -> Column:
    """True outside the fences; a column without any value has none."""
    if column not in fences:
        return F.lit(False)
    low, up = fences[column]
    return (F.col(column) < low) | (F.col(column) > up)


def winsorise(df: DataFrame, columns: Sequence[str], fences: Fences | None = None) -> DataFrame:
    """O2: values beyond a fence take the fence's value."""
    fences = fit_fences(df, columns) if fences is None else fences
    changed = {}
    for c in columns:
        if c in fences:
            low, up = fences[c]
            changed[c] = F.when(F.col(c) < low, F.lit(low)).when(F.col(c) > up, F.lit(up)).otherwise(F.col(c))
    return df.withColumns(changed)


def has_outliers(df: DataFrame, columns: Sequence[str], fences: Fences | None = None) -> DataFrame:
    """O3: ``(column, has_outlier)`` for all columns in one pass."""
    fences = fit_fences(df, columns) if fences is None else fences
    found = df.agg(
        *[F.coalesce(F.max(outside(c, fences)), F.lit(False)).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"_{i}").alias("has_outlier"))
        for i, c in enumerate(columns)
    ]
    return found.select(F.inline(F.array(*pairs)))


def grab_outliers(
    df: DataFrame, column: str, key: str, fences: Fences | None = None, ids_only: bool = False
) -> DataFrame:
    """The outlier rows, or only the first 5 by key when there are more than 10.

    ``ids_only`` returns the key of every outlier.
    """
    fences = fit_fences(df, [column]) if fences is None else fences
    rows = df.where(outside(column, fences))
    if ids_only:
        return rows.select(key)
    many = rows.limit(11).count() > 10
    return rows.orderBy(key).limit(5) if many else rows


def remove_outliers(df: DataFrame, column: str, fences: Fences | None = None) -> DataFrame:
    """Rows inside the fences and rows with a missing value."""
    fences = fit_fences(df, [column]) if fences is None else fences
    return df.where(~outside(column, fences) | F.col(column).isNull())
