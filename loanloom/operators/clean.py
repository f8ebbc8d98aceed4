"""Fills, sentinel removal, substitutions and column housekeeping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import finite_or_zero, is_missing, null_if_value


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Constants for missing; a constant of another kind changes nothing."""
    kinds = dict(df.dtypes)
    fitting = {c: v for c, v in values.items() if isinstance(v, str) == (kinds[c] == "string")}
    return df.fillna(fitting) if fitting else df


def most_frequent(df: DataFrame, columns: Sequence[str]) -> dict[str, object | None]:
    """The mode of each column; ties go to the smallest value, missing values and NaN do not count.

    One count per column and value, combined on the map side, and a largest per
    column, because the built-in mode keeps every distinct value in one buffer.
    """
    kinds = dict(df.dtypes)
    pairs = []
    for i, c in enumerate(columns):
        known = F.when(~is_missing(c, kinds[c]), F.col(c))
        values = [(known if j == i else F.lit(None).cast(kinds[d])).alias(f"_{j}") for j, d in enumerate(columns)]
        pairs.append(F.struct(F.lit(i).alias("i"), *values))
    names = [f"_{j}" for j in range(len(columns))]
    counted = df.select(F.inline(F.array(*pairs))).groupBy("i", *names).agg((-F.count(F.lit(1))).alias("minus"))
    present = counted.where(F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull())
    top = present.groupBy("i").agg(F.min(F.struct("minus", *names)).alias("top")).collect()
    modes: dict[str, object | None] = dict.fromkeys(columns)
    modes.update({columns[r["i"]]: r["top"][f"_{r['i']}"] for r in top})
    return modes


def fill_mode(df: DataFrame, columns: Sequence[str], modes: Mapping[str, object] | None = None) -> DataFrame:
    """The most frequent value for missing; ``modes`` if it is known already."""
    kinds = dict(df.dtypes)
    if modes is None:
        modes = most_frequent(df, columns) if columns else {}
    return df.withColumns(
        {
            c: F.when(is_missing(c, kinds[c]), F.lit(m).cast(kinds[c])).otherwise(F.col(c))
            for c, m in modes.items() if m is not None
        }
    )


def _maxima(df: DataFrame, values: Mapping[str, Column]) -> dict[str, object]:
    if not values:
        return {}
    row = df.agg(*[F.max(v).alias(c) for c, v in values.items()]).first()
    return row.asDict()


def sentinel_values(columns: Sequence[str], zero_is_missing: bool = False) -> dict[str, Column]:
    """What the largest value of each column is taken of."""
    return {c: F.nullif(F.col(c), F.lit(0)) if zero_is_missing else F.col(c) for c in columns}


def null_max(
    df: DataFrame, columns: Sequence[str], zero_is_missing: bool = False, maxima: Mapping[str, object] | None = None
) -> DataFrame:
    """The column's largest value is a sentinel for missing.

    With ``zero_is_missing`` zeros go first and the maximum is taken after that.
    All maxima come from one pass, unless they are known already.
    """
    values = sentinel_values(columns, zero_is_missing)
    top = _maxima(df, values) if maxima is None else maxima
    return df.withColumns({c: null_if_value(v, top[c]) for c, v in values.items()})


def null_sentinel(
    df: DataFrame,
    column: str,
    scope: str = "column",
    maxima: Mapping[str, object] | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """C4: null the largest value of ``column``, there or in every numeric column (``all``) but ``keys``.

    A key may well be as large as the sentinel, and without it the row belongs to nobody.
    """
    if scope == "column":
        return null_max(df, [column], maxima=maxima)
    if scope != "all":
        raise ValueError(f"unknown scope {scope!r}")
    top = (_maxima(df, {column: F.col(column)}) if maxima is None else maxima)[column]
    if top is None:
        return df
    numeric = [c for c, t in df.dtypes if t in _NUMERIC and c not in keys]
    hit = {c: F.col(c).cast("double") == float(top) for c in numeric}
    return df.withColumns({c: F.when(~h | h.isNull(), F.col(c)) for c, h in hit.items()})


_NUMERIC = {"tinyint", "smallint", "int", "bigint", "float", "double"}


def replace_value(df: DataFrame, column: str, values: Mapping[str, str]) -> DataFrame:
    """Category substitution."""
    return df.replace(dict(values), subset=[column])


def first_of_each_name(df: DataFrame) -> DataFrame:
    """C14: of columns with the same name keep the leftmost."""
    names = df.columns
    handles = [f"_c{i}" for i in range(len(names))]
    kept = [i for i, n in enumerate(names) if n not in names[:i]]
    return df.toDF(*handles).select(*[F.col(handles[i]).alias(names[i]) for i in kept])


def split_label(df: DataFrame, label: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Features without the label, and the label by key."""
    return df.drop(label), df.select(key, label)


def finite_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinities replaced over a whole feature matrix."""
    return df.select(
        *[finite_or_zero(c).alias(c) if c in set(columns) else F.col(c) for c in df.columns]
    )


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """C17: columns whose name contains the pattern."""
    return df.select(*[c for c in df.columns if pattern in c])
