"""Table profiles. Every operator covers all its columns in one or two scans."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import is_missing
from loanloom.operators.encode import missing_flags
from loanloom.operators.quantiles import column_quantiles, long_values
from loanloom.operators.table_profile import NUMERIC, TableProfile

CHECK_PROBS = [0.0, 0.05, 0.5, 0.95, 0.99, 1.0]
SUMMARY_PROBS = [0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99]


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t in NUMERIC]


def quantile_name(prob: float) -> str:
    return f"q{round(prob * 100):02d}"


def _one_row_to_long(row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A one-row aggregate with columns ``<field>_<i>`` to a row per column."""
    pairs = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"{f}_{i}").alias(f) for f in fields])
        for i, c in enumerate(columns)
    ]
    return row.select(F.inline(F.array(*pairs)))


# --- missing values ---------------------------------------------------------------------------


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``(column, dtype, n_rows, n_miss)`` in one scan; NaN is missing."""
    columns = list(columns or df.columns)
    kinds = dict(df.dtypes)
    row = df.agg(
        *[
            a
            for i, c in enumerate(columns)
            for a in (
                F.lit(kinds[c]).alias(f"dtype_{i}"),
                F.count(F.lit(1)).alias(f"n_rows_{i}"),
                F.count_if(is_missing(c, kinds[c])).alias(f"n_miss_{i}"),
            )
        ]
    )
    return _one_row_to_long(row, columns, ["dtype", "n_rows", "n_miss"])


def missing_values_table(df: DataFrame, with_dtype: bool = True) -> DataFrame:
    """P11 (P12 without ``dtype``): columns with missing values, most missing first."""
    ratio = F.round(F.col("n_miss") / F.col("n_rows") * 100, 2)
    table = (
        missing_counts(df)
        .where(F.col("n_miss") > 0)
        .select("column", *(["dtype"] if with_dtype else []), "n_miss", ratio.alias("ratio"))
    )
    return table.orderBy(F.col("n_miss").desc(), "column")


def mostly_missing(df: DataFrame, above_percent: float = 40.0) -> list[str]:
    """Names of columns with more than that percentage missing, in table order."""
    found = {r["column"] for r in missing_values_table(df).where(F.col("ratio") > above_percent).collect()}
    return [c for c in df.columns if c in found]


def missing_vs_target(df: DataFrame, target: str, na_columns: Sequence[str]) -> DataFrame:
    """Mean and count of the target per missing flag, for all columns at once."""
    flagged = missing_flags(df.select(target, *[c for c in na_columns if c != target]), na_columns)
    pairs = [
        F.struct(F.lit(f"{c}_NA_FLAG").alias("column"), F.col(f"{c}_NA_FLAG").alias("flag"))
        for c in na_columns
    ]
    return (
        flagged.select(F.col(target).alias("_t"), F.inline(F.array(*pairs)))
        .groupBy("column", "flag")
        .agg(F.avg("_t").alias("target_mean"), F.count("_t").alias("n"))
    )


# --- quantiles and descriptions ---------------------------------------------------------------


def check_table(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column its type, missing count and, for numbers, six quantiles; NaN is missing."""
    if not approx:
        return TableProfile(df).check(CHECK_PROBS)
    quantiles = column_quantiles(df, numeric_columns(df), CHECK_PROBS, approx)
    quantiles = quantiles.select(
        "column", *[F.element_at("q", i + 1).alias(quantile_name(p)) for i, p in enumerate(CHECK_PROBS)]
    )
    return missing_counts(df).drop("n_rows").join(F.broadcast(quantiles), "column", "left")


def describe_numeric(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    probs: Sequence[float] = (0.25, 0.5, 0.75),
    approx: bool = False,
) -> DataFrame:
    """Count, mean, std, min, quantiles, max, with columns as rows; NaN is missing."""
    columns = list(columns or numeric_columns(df))
    if not approx:
        return TableProfile(df, columns).describe(probs)
    moments = long_values(df, columns).groupBy("column").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quantiles = column_quantiles(df, columns, probs, approx).select(
        "column", *[F.element_at("q", i + 1).alias(quantile_name(p)) for i, p in enumerate(probs)]
    )
    return moments.join(F.broadcast(quantiles), "column", "left")


def num_summary(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """The description with twelve quantiles."""
    return describe_numeric(df, columns, SUMMARY_PROBS, approx)


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 20) -> DataFrame:
    """Counts in equal-width bins 1..bins; the maximum belongs to the last bin."""
    values = long_values(df, columns).where(F.col("value").isNotNull())
    ends = {
        r["column"]: (r["low"], r["high"])
        for r in values.groupBy("column").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    }
    bin_of = None
    for c, (low, high) in ends.items():
        place = F.floor((F.col("value") - low) / (high - low) * bins) if high > low else F.lit(bins // 2)
        value = F.least(place, F.lit(bins - 1)) + 1
        hit = F.col("column") == c
        bin_of = F.when(hit, value) if bin_of is None else bin_of.when(hit, value)
    if bin_of is None:
        bin_of = F.lit(None).cast("long")
    return (
        values.groupBy("column", bin_of.cast("long").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


# --- categories -------------------------------------------------------------------------------


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Level, count and percent of all rows, missing levels left out of the rows only."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns
    ]
    return (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ratio", 100.0 * F.col("n") / total)
    )


def rare_analyser(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Count, share of all rows and target mean per level, and levels per column."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns
    ]
    levels = (
        df.select(F.col(target).alias("_t"), F.inline(F.array(*pairs)))
        .where(F.col("level").isNotNull())
        .groupBy("column", "level")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("_t").alias("target_mean"))
        .withColumn("ratio", F.col("n") / total)
    )
    per_column = levels.groupBy("column").agg(F.count(F.lit(1)).alias("n_levels"))
    return levels.join(per_column, "column")


def target_mean_by_category(df: DataFrame, target: str, column: str) -> DataFrame:
    """P5."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.avg(target).alias("target_mean"))


def numeric_mean_by_target(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """P6."""
    rows = df.where(F.col(target).isNotNull())
    return rows.groupBy(target).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])


def counts_by_category(df: DataFrame, column: str, target: str | None = None) -> DataFrame:
    """The counts behind a count plot."""
    by = [column] if target is None else [column, target]
    for c in by:
        df = df.where(F.col(c).isNotNull())
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def target_percent(df: DataFrame, column: str, target: str, values: Sequence[object] = (0, 1)) -> DataFrame:
    """Percent of each target value within a category."""
    rows = df.where(F.col(column).isNotNull() & F.col(target).isNotNull())
    return rows.groupBy(column).agg(
        *[
            (F.count_if(F.col(target) == v) * 100.0 / F.count(F.lit(1))).alias(f"percent_{v}")
            for v in values
        ]
    )


# --- column kinds -----------------------------------------------------------------------------


class ColumnKinds(NamedTuple):
    cat_cols: list[str]
    num_cols: list[str]
    cat_but_car: list[str]
    num_but_cat: list[str]


def grab_col_names(df: DataFrame, cat_th: int = 10, car_th: int = 20) -> ColumnKinds:
    """Categorical, numeric, categorical-but-cardinal, numeric-but-categorical columns.

    A sketch settles every column far above the thresholds; only the rest is
    counted exactly, where map-side combining leaves a handful of values.
    """
    rough = df.agg(*[F.approx_count_distinct(c).alias(f"_{i}") for i, c in enumerate(df.columns)]).first()
    distinct = {c: rough[f"_{i}"] for i, c in enumerate(df.columns)}
    near = [c for c in df.columns if distinct[c] <= 10 * max(cat_th, car_th)]
    if near:
        pairs = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in near]
        exact = (
            df.select(F.inline(F.array(*pairs)))
            .where(F.col("v").isNotNull())
            .distinct()
            .groupBy("c")
            .count()
        )
        distinct.update({c: 0 for c in near})
        distinct.update({r["c"]: r["count"] for r in exact.collect()})
    text = {c for c, t in df.dtypes if t == "string"}
    num_but_cat = [c for c in df.columns if c not in text and distinct[c] < cat_th]
    cat_but_car = [c for c in df.columns if c in text and distinct[c] > car_th]
    cat_cols = [c for c in df.columns if c in text and c not in cat_but_car] + num_but_cat
    num_cols = [c for c in df.columns if c not in text and c not in num_but_cat]
    return ColumnKinds(cat_cols, num_cols, cat_but_car, num_but_cat)


def constant_columns(df: DataFrame) -> list[str]:
    """At most one distinct value, missing and NaN excluded; extremes tell, no distinct set needed."""
    known = {c: F.when(~is_missing(c, k), F.col(c)) for c, k in df.dtypes}
    row = df.agg(*[(F.min(v).eqNullSafe(F.max(v))).alias(f"_{i}") for i, v in enumerate(known.values())]).first()
    return [c for i, c in enumerate(df.columns) if row[f"_{i}"]]


# A frequent-items sketch holds at most twice the reciprocal of this many items per column.
_LEAST_SKETCHED = 0.02


def near_constants(df: DataFrame, ratio: float) -> DataFrame:
    """P10: ``(column, top_value, n, ratio)`` of columns whose top value fills that share of rows.

    Counts per column and value, combined on the map side, and the largest of each
    column; equal counts go to the smallest text. For shares a sketch can hold, which cannot
    miss such a value, only the sketch's few candidates are counted.
    """
    names = df.columns
    pairs = [
        F.struct(F.lit(i).alias("i"), F.col(f"`{c}`").cast("string").alias("v")) for i, c in enumerate(names)
    ]
    long = df.select(F.inline(F.array(*pairs)))
    if ratio >= _LEAST_SKETCHED:
        texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(names)])
        found = texts.stat.freqItems(texts.columns, support=min(0.5, ratio / 2)).first()
        likely = None
        for i in range(len(names)):
            hit = (F.col("i") == i) & F.col("v").isin([v for v in found[i] or () if v is not None])
            likely = hit if likely is None else likely | hit
        long = long.where(likely)
    total = df.count()
    counted = long.where("v IS NOT NULL").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    top = counted.groupBy("i").agg(F.min(F.struct((-F.col("n")).alias("minus"), "v")).alias("top"))
    share = -F.col("top.minus") / F.lit(float(max(total, 1)))
    return (
        top.where(share >= ratio)
        .select(
            F.element_at(F.array(*map(F.lit, names)), F.col("i") + 1).alias("column"),
            F.col("top.v").alias("top_value"),
            (-F.col("top.minus")).alias("n"),
            share.alias("ratio"),
        )
    )

