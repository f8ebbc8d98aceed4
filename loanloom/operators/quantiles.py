"""Exact interpolated quantiles without holding a group's values in one task.

The built-in exact percentile keeps a count of every distinct value of a group
in one aggregation buffer. That is used, on pre-aggregated counts, only after a
distinct-count sketch has shown the buffer to be small. Beyond that a quantile
sketch brackets each quantile, and only the few values inside are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanloom.operators.lookup import lookup_join

# Distinct values per group that one buffer may hold.
_DISTINCT_LIMIT = 1_000_000
# The sketch is off by at most 1/_ACCURACY of the rows and the bracket allows four times
# that, so even of 10^11 distinct values less than 10^7 are ranked in one task.
_ACCURACY = 100_000


def group_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str],
    approx: bool = False,
    accuracy: int = _ACCURACY,
    distinct_limit: int = _DISTINCT_LIMIT,
    most_distinct: int | None = None,
) -> DataFrame:
    """One row per group (missing groups dropped) and array column ``q``, one entry per prob.

    Missing values are ignored, neighbours are interpolated linearly. ``approx``
    returns the sketch's values after a single pass. ``most_distinct`` is the largest approximate
    number of distinct values of a group, if it is known already.
    """
    by, probs = list(by), [float(p) for p in probs]
    rows = df.select(*by, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    for b in by:
        rows = rows.where(F.col(b).isNotNull())
    if approx:
        return rows.groupBy(*by).agg(F.percentile_approx("_v", probs, accuracy).alias("q"))
    if most_distinct is None:
        distinct = rows.groupBy(*by).agg(F.approx_count_distinct("_v").alias("d"))
        most_distinct = distinct.agg(F.max("d")).first()[0] or 0
    if most_distinct <= distinct_limit:
        counts = rows.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
        return counts.groupBy(*by).agg(F.percentile("_v", probs, F.col("_c")).alias("q"))
    return _bracketed(rows, probs, by, accuracy)


def _bracketed(rows: DataFrame, probs: list[float], by: list[str], accuracy: int) -> DataFrame:
    slack = 4 / accuracy
    edges = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-slack, slack)]
    groups = rows.groupBy(*by).agg(
        F.count("_v").alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", edges, accuracy).alias("_edges"),
    )
    # A group no larger than the sketch is ranked whole. The sketch need not hit the
    # extremes, which quantiles near 0 and 1 reach for.
    whole = F.col("_n") <= accuracy
    bounds = []
    for i, p in enumerate(probs):
        low = F.col("_min") if p <= slack else F.element_at("_edges", 2 * i + 1)
        high = F.col("_max") if p >= 1 - slack else F.element_at("_edges", 2 * i + 2)
        bounds.append(F.when(whole, F.col("_min")).otherwise(low).alias(f"_low{i}"))
        bounds.append(F.when(whole, F.col("_max")).otherwise(high).alias(f"_high{i}"))
    marked = lookup_join(rows, groups.select(*by, "_n", whole.alias("_whole"), *bounds), by, how="inner")

    each = range(len(probs))
    below = marked.groupBy(*by).agg(
        *[F.count_if(F.col("_v") < F.col(f"_low{i}")).alias(f"_below{i}") for i in each]
    )
    inside = [F.col("_v").between(F.col(f"_low{i}"), F.col(f"_high{i}")) for i in each]
    near = inside[0]
    for hit in inside[1:]:
        near = near | hit
    # A row inside a bracket is tagged with it; the rows of a whole group need only one tag.
    tags = F.when(F.col("_whole"), F.array(F.lit(-1))).otherwise(
        F.array_compact(F.array(*[F.when(hit, F.lit(i)) for i, hit in enumerate(inside)]))
    )
    counted = (
        marked.where(near)
        .select(*by, "_n", "_v", F.explode(tags).alias("i"))
        .groupBy(*by, "_n", "i", "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*by, "i").orderBy("_v")
    upto = F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"_from": upto - F.col("_c"), "_to": upto})
    picked = lookup_join(ranked, below, by).groupBy(*by).agg(*[_interpolated(i, p) for i, p in enumerate(probs)])
    return picked.select(*by, F.array(*[f"_q{i}" for i in each]).alias("q"))


def _interpolated(i: int, prob: float) -> Column:
    """The value at position ``prob * (n - 1)`` of a group's ranked values."""
    position = (F.col("_n") - 1) * F.lit(prob)
    first = F.floor(position)
    last = F.least(first + 1, F.col("_n") - 1)

    def at(rank: Column) -> Column:
        place = rank - F.col(f"_below{i}")
        hit = F.col("i").isin(i, -1) & (F.col("_from") <= place) & (place < F.col("_to"))
        return F.max(F.when(hit, F.col("_v")))

    low, high = at(first), at(last)
    outside = F.raise_error(F.lit("quantile fell outside its bracket")).cast("double")
    value = low + (high - low) * F.max(position - first)
    return F.when(low.isNull() | high.isNull(), outside).otherwise(value).alias(f"_q{i}")


def long_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows ``(column, value)`` of numeric columns, so all are profiled in one pass."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot([], list(columns), "column", "value")


def column_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    approx: bool = False,
) -> DataFrame:
    """``(column, q)`` for numeric columns of the whole table."""
    return group_quantiles(long_values(df, columns), "value", probs, ["column"], approx)


def group_median(
    df: DataFrame, value: str, by: Sequence[str], approx: bool = False, most_distinct: int | None = None
) -> DataFrame:
    """Median per group as column ``median``."""
    quantiles = group_quantiles(df, value, [0.5], by, approx, most_distinct=most_distinct)
    return quantiles.select(*by, F.element_at("q", 1).alias("median"))
