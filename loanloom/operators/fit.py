"""What the builders learn from a source before they build, in one pass over it.

Maxima, modes, category levels and the number of rows are facts about a source. Each row is taken apart into
(fact, value) pairs, which are counted and combined on the map side, so a source is read once whatever is asked of it and
only levels, one mode per column and one row of maxima reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import is_missing
from loanloom.operators.encode import Vocabulary, string_columns, typed_level
from loanloom.operators.lookup import MIN_HOT_ROWS, hot_keys


@dataclass(frozen=True)
class SourceFit:
    """``spread``: the largest approximate number of distinct values, asked for, within one level of a column."""

    rows: int
    maxima: Mapping[str, object] = field(default_factory=dict)
    modes: Mapping[str, object] = field(default_factory=dict)
    vocabulary: Vocabulary = field(default_factory=lambda: Vocabulary({}))
    spread: int = 0

    def hot(self, df: DataFrame, key: str, min_rows: int = MIN_HOT_ROWS) -> list[object]:
        """Hot keys; a source with fewer rows than one hot key has cannot hold any and is not read again."""
        return [] if self.rows < min_rows else hot_keys(df, key, min_rows)


_LEVEL, _MODE, _ROWS = 0, 1, 2


def fit_source(
    df: DataFrame,
    maxima: Mapping[str, Column] | None = None,
    modes: Sequence[str] = (),
    levels: Sequence[str] | None = None,
    missing: bool = True,
    spread_of: str | None = None,
    max_levels: int | None = None,
) -> SourceFit:
    """Rows, maxima of the given expressions, modes and levels (default: of all string columns) in one pass.

    As for the single operators: missing values and NaN count for nothing, ties of a mode go to the smallest
    value, levels are sorted, and more levels than ``max_levels`` are refused.
    """
    maxima, kinds = dict(maxima or {}), dict(df.dtypes)
    levels = string_columns(df) if levels is None else list(levels)
    tops = [f"_max{i}" for i in range(len(maxima))]

    def fact(kind: int, place: int, column: str | None = None) -> Column:
        known = F.lit(None).cast("string") if column is None else F.when(~is_missing(column, kinds[column]), F.col(column))
        number = known.try_cast("double") if kind == _MODE and kinds[column] != "string" else F.lit(None).cast("double")
        spread = F.col(spread_of).cast("double") if kind == _LEVEL and spread_of else F.lit(None).cast("double")
        own = [(v if kind == _ROWS else F.lit(None).cast(df.select(v).dtypes[0][1])).alias(t) for t, v in zip(tops, maxima.values())]
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(place).alias("place"), known.cast("string").alias("value"), number.alias("number"),
            spread.alias("spread"), *own,
        )

    facts = [fact(_ROWS, 0)]
    facts += [fact(_LEVEL, i, c) for i, c in enumerate(levels)]
    facts += [fact(_MODE, i, c) for i, c in enumerate(modes)]
    sketch = [F.approx_count_distinct("spread").alias("spread")] if spread_of else []
    counted = (
        df.select(F.inline(F.array(*facts)))
        .where(F.col("value").isNotNull() | (F.col("kind") == _ROWS))
        .groupBy("kind", "place", "value", "number")
        .agg(F.count(F.lit(1)).alias("n"), *sketch, *[F.max(t).alias(t) for t in tops])
    )
    # All levels are kept; of a mode's values only the most frequent.
    kept = F.when(F.col("kind") != _MODE, F.col("value")).alias("level")
    top = F.min(F.struct((-F.col("n")).alias("minus"), "number", "value"))["value"].alias("top")
    combined = counted.groupBy("kind", "place", kept).agg(
        F.sum("n").alias("n"), top, *[F.max(c).alias(c) for c in ([*tops, "spread"] if spread_of else tops)]
    )
    found = (combined if max_levels is None else combined.limit(max_levels + len(modes) + 2)).collect()
    per_column: dict[int, list[str]] = {}
    for r in found:
        if r["kind"] == _LEVEL:
            per_column.setdefault(r["place"], []).append(r["level"])
    if max_levels is not None and sum(map(len, per_column.values())) > max_levels:
        raise ValueError(f"more than {max_levels} levels in {levels}")
    whole = next((r for r in found if r["kind"] == _ROWS), None)
    sorted_levels = {
        c: tuple(sorted(typed_level(v, kinds[c]) for v in per_column.get(i, ()))) for i, c in enumerate(levels)
    }
    most = {r["place"]: r["top"] for r in found if r["kind"] == _MODE}
    return SourceFit(
        whole["n"] if whole else 0,
        {c: whole[t] if whole else None for c, t in zip(maxima, tops)},
        {c: typed_level(most[i], kinds[c]) if i in most else None for i, c in enumerate(modes)},
        Vocabulary(sorted_levels, missing),
        max((r["spread"] or 0 for r in found if r["kind"] == _LEVEL), default=0) if spread_of else 0,
    )


def known_facts(
    df: DataFrame, fit: SourceFit | None, vocabulary: Vocabulary | None, hot: Sequence[object] | None, key: str = "SK_ID_CURR"
) -> tuple[Vocabulary, Sequence[object]]:
    """Levels and hot keys; a pass over the table only for what neither the caller nor a fit names."""
    return sized_facts(df, fit, vocabulary, hot, key)[:2]


def sized_facts(
    df: DataFrame, fit: SourceFit | None, vocabulary: Vocabulary | None, hot: Sequence[object] | None, key: str = "SK_ID_CURR"
) -> tuple[Vocabulary, Sequence[object], int | None]:
    """``known_facts`` and the number of rows, None if it took no pass to know the others."""
    if fit is None and (vocabulary is None or hot is None):
        fit = fit_source(df)
    return vocabulary or fit.vocabulary, fit.hot(df, key) if hot is None else hot, fit.rows if fit else None
