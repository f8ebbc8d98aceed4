"""Categories to numbers. Fit once, then apply to any table or slice."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.expr import dummy, flag, is_missing
from loanloom.functions.names import clean_name, unique_names
from loanloom.operators.lookup import bounded, lookup_join
from loanloom.sources.io import checkpoint


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


@dataclass(frozen=True)
class Vocabulary:
    """Sorted levels per column; the same for every slice, train and test (T5)."""

    levels: Mapping[str, tuple[object, ...]]
    missing: bool = True
    drop_first: bool = False

    def dummies(self) -> dict[str, str]:
        """SQL text of every indicator by output name, in column then level order."""
        names, columns = [], []
        for c, values in self.levels.items():
            for v in values[1:] if self.drop_first else values:
                names.append(clean_name(f"{c}_{v}"))
                columns.append(dummy(c, v))
            if self.missing:
                names.append(clean_name(f"{c}_nan"))
                columns.append(dummy(c, None))
        return dict(zip(unique_names(names), columns, strict=True))


def fit_vocabulary(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    missing: bool = True,
    drop_first: bool = False,
    max_levels: int | None = None,
) -> Vocabulary:
    """Distinct levels of the given (default: all string) columns in one pass; NaN is missing.

    There is a column per level, so the levels are a schema and reach the driver
    whatever their number; a caller who wants a refusal instead names ``max_levels``.
    """
    columns = string_columns(df) if columns is None else list(columns)
    if not columns:
        return Vocabulary({}, missing, drop_first)
    kinds = dict(df.dtypes)
    pairs = [
        F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v"))
        for i, c in enumerate(columns)
    ]
    distinct = df.select(F.inline(F.array(*pairs))).where("v IS NOT NULL").distinct()
    found = (distinct if max_levels is None else distinct.limit(max_levels + 1)).collect()
    if max_levels is not None and len(found) > max_levels:
        raise ValueError(f"more than {max_levels} levels in {columns}")
    levels = {}
    for i, c in enumerate(columns):
        values = [r["v"] for r in found if r["i"] == i and not (r["v"] == "NaN" and kinds[c] in ("float", "double"))]
        levels[c] = tuple(sorted(typed_level(v, kinds[c]) for v in values))
    return Vocabulary(levels, missing, drop_first)


def typed_level(text: str, kind: str) -> object:
    """A level as a value that sorts as its column does and can be written as a literal."""
    if kind.endswith("int"):
        return int(text)
    if kind in ("float", "double"):
        return float(text)
    if kind == "boolean":
        return text == "true"
    if kind.startswith("decimal"):
        return Decimal(text)
    return text


def apply_one_hot(df: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Dummies appended, encoded columns dropped; one projection, no pivot."""
    kept = [c for c in df.columns if c not in vocabulary.levels]
    dummies = vocabulary.dummies()
    clash = {c.lower() for c in kept} & {n.lower() for n in dummies}
    if clash:
        raise ValueError(f"dummy names already taken: {sorted(clash)}")
    return df.selectExpr(*[f"`{c}`" for c in kept], *[f"{d} AS `{n}`" for n, d in dummies.items()])


def one_hot(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    missing: bool = True,
    drop_first: bool = False,
) -> tuple[DataFrame, list[str]]:
    """E1 (default), E2 (``missing=False``), E3 (``columns``, ``drop_first``)."""
    vocabulary = fit_vocabulary(df, columns, missing, drop_first)
    return apply_one_hot(df, vocabulary), list(vocabulary.dummies())


def sorted_codes(values: DataFrame, column: str) -> DataFrame:
    """``(column, _code)``: place of each distinct value in sorted order, from 0.

    A wide domain is sorted in range partitions and numbered by partition
    offsets, so no single task sees all of it; the checkpoint pins the numbers.
    """
    small, fits = bounded(values)
    if fits:
        # As Spark orders them, which puts NaN last.
        ordered = sorted((r[0] for r in small.collect()), key=lambda v: (v != v, v))
        rows = [(v, i) for i, v in enumerate(ordered)]
        kind = values.schema[column].dataType.simpleString()
        return values.sparkSession.createDataFrame(rows, f"`{column}` {kind}, _code long")
    ordered = checkpoint(
        values.repartitionByRange(column)
        .sortWithinPartitions(column)
        .withColumn("_id", F.monotonically_increasing_id())
        .select(column, F.shiftright("_id", 33).alias("_part"), "_id")
    )
    # One row per partition, so the running total is over a short list.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    place = F.col("_offset") + F.col("_id") - F.shiftleft("_part", 33)
    return lookup_join(ordered, offsets, "_part").select(column, place.alias("_code"))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Category to its code in sorted order; missing stays missing."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = lookup_join(df, sorted_codes(values, column), column)
    return coded.select(
        *[F.col("_code").alias(c) if c == column else F.col(c) for c in df.columns]
    )


def rare_to_other(
    df: DataFrame,
    columns: Sequence[str],
    rare_perc: float,
    gate: float = 0.01,
    other: str = "999",
) -> DataFrame:
    """Categories below ``rare_perc`` of all rows become ``other``.

    A column takes part only if more than one category is below ``gate``. The
    lookup holds the frequent categories, of which there are at most
    ``1/rare_perc``, not the rare ones.
    """
    columns = list(columns)
    pairs = [F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(columns)]
    levels = df.select(F.inline(F.array(*pairs))).groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = checkpoint(levels)
    total = counted.where("i = 0").agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / F.lit(max(total, 1))
    known = F.col("v").isNotNull()
    rows = counted.where(known).groupBy("i").agg(
        F.count_if(share < gate).alias("below"), F.sort_array(F.collect_list(F.when(share >= rare_perc, F.col("v")))).alias("kept")
    )
    # At most 1 / rare_perc levels a column are frequent, so they are a list, not a join.
    encoded = {}
    for r in rows.where("below > 1").collect():
        c = columns[r["i"]]
        text = F.col(c).cast("string")
        rare = text.isNotNull() & ~text.isin(r["kept"])
        encoded[c] = F.when(rare, F.lit(other)).otherwise(text)
    return df.withColumns(encoded) if encoded else df


def binary_columns(df: DataFrame, include_small_numeric: bool = True) -> list[str]:
    """Columns with exactly two distinct values, 64-bit numbers left out.

    Two passes of plain aggregates: the extremes, then whether anything lies
    between them. No distinct sets are built.
    """
    skipped = {"bigint", "double"}
    if not include_small_numeric:
        skipped |= {"tinyint", "smallint", "int", "float"}
    columns = [c for c, t in df.dtypes if t not in skipped]
    if not columns:
        return []
    ends = df.agg(
        *[g(F.col(c)).alias(f"{g.__name__}_{i}") for i, c in enumerate(columns) for g in (F.min, F.max)]
    ).first()
    open_ = [
        (i, c) for i, c in enumerate(columns)
        if ends[f"min_{i}"] is not None and ends[f"min_{i}"] != ends[f"max_{i}"]
    ]
    if not open_:
        return []
    between = df.agg(
        *[
            F.max(flag((F.col(c) != F.lit(ends[f"min_{i}"])) & (F.col(c) != F.lit(ends[f"max_{i}"]))))
            .alias(f"b_{i}")
            for i, c in open_
        ]
    ).first()
    return [c for i, c in open_ if between[f"b_{i}"] == 0]


def missing_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``<column>_NA_FLAG`` next to the data."""
    kinds = dict(df.dtypes)
    return df.withColumns({f"{c}_NA_FLAG": is_missing(c, kinds[c]).cast("int") for c in columns})
