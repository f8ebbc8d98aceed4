"""Pairwise-complete Pearson correlation, in tiles of columns that bound a task's memory."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanloom.operators.profile import numeric_columns

# A pair whose variance is below this share of its squares may be constant where both are known.
_ROUNDING = 1e-9
# Doubtful pairs that one scan computes again.
_AGAIN = 50_000
# Bytes of sums that a task may hold: a scan takes two tiles of columns that fit.
SUM_BYTES = 32 << 20
# Bytes of rows, or of rows by doubtful pairs, that a task turns into matrices at once.
_STEP_BYTES = 4 << 20
# Tasks of a scan, each of which sends one set of sums.
_MOST_TASKS = 4_096
# Columns whose sums leave a task together.
_LINES = 64
_SUMS = ("n", "sa", "sb", "saa", "sbb", "sab")
_PAIRS = "col_a string, col_b string, r double"


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles named by their places; NaN and infinities are missing."""
    kinds = dict(df.dtypes)

    def finite(c: str) -> Column:
        value = F.col(f"`{c}`").cast("double")
        return F.when(F.abs(value) < float("inf"), value) if kinds[c] in ("float", "double") else value

    return df.select(*[finite(c).alias(f"_{i}") for i, c in enumerate(columns)])


def correlations(
    df: DataFrame, columns: Sequence[str] | None = None, sum_bytes: int = SUM_BYTES
) -> DataFrame:
    """``(col_a, col_b, r)`` for pairs in column order, ``r`` NULL where undefined; NaN and infinities count as missing.

    Matrix products of the centred values per batch, summed by Spark. Columns are cut into as
    few tiles as keep the sums of two tiles within ``sum_bytes`` a task; each pair of tiles is a
    scan of those columns alone (800 columns or so need one scan, 1,600 three). A pair that
    hardly varies on the rows where both are known is computed again around its own means, so
    that rounding cannot pass for correlation. Empty and constant columns correlate with nothing.
    """
    columns = list(columns or numeric_columns(df))
    if len(columns) < 2:
        return df.sparkSession.createDataFrame([], _PAIRS)
    known = _known(df, columns)
    stats = known.agg(*[f(f"_{i}") for i in range(len(columns)) for f in (F.avg, F.min, F.max)]).first()
    means, low, high = (stats[i::3] for i in range(3))
    centre = np.array([m or 0.0 for m in means], dtype=float)
    varying = [i for i in range(len(columns)) if low[i] is not None and low[i] < high[i]]
    found = [_tiles(known, varying, centre, sum_bytes)] if len(varying) > 1 else []
    fixed = sorted(set(range(len(columns))) - set(varying))
    if fixed:
        found.append(_undefined(df, len(columns), fixed))
    names = F.array(*[F.lit(c) for c in columns])
    return reduce(DataFrame.unionByName, found).select(
        F.element_at(names, F.col("a") + 1).alias("col_a"), F.element_at(names, F.col("b") + 1).alias("col_b"), "r"
    )


def _undefined(df: DataFrame, k: int, fixed: list[int]) -> DataFrame:
    """The pairs of columns that do not vary, without a list of them on the driver."""
    spark = df.sparkSession
    one = spark.createDataFrame([(i,) for i in fixed], "i int")
    others = one.select("i", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("j")).where("i <> j")
    pairs = others.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).distinct()
    return pairs.withColumn("r", F.lit(None).cast("double"))


def _tiles(known: DataFrame, varying: list[int], centre: np.ndarray, sum_bytes: int) -> DataFrame:
    """``a, b, r`` for all pairs of the varying columns."""
    side = max(1, int((sum_bytes / (8 * len(_SUMS))) ** 0.5))
    count = -(-len(varying) // side)
    tiles = [[int(i) for i in tile] for tile in np.array_split(np.array(varying), count)]
    # Read again by the choice of doubtful pairs, and small: a row per pair of columns.
    total = reduce(
        DataFrame.unionByName, [_sums(known, a, b, centre) for a, b in combinations_with_replacement(tiles, 2)]
    ).persist()
    va, vb, r = _pearson()
    flat = (F.col("n") > 0) & ((va <= F.col("saa") * _ROUNDING) | (vb <= F.col("sbb") * _ROUNDING))
    judged = total.select("a", "b", "n", "sa", "sb", r.alias("r"), flat.alias("flat"))
    again = [
        (x["a"], x["b"], centre[x["a"]] + x["sa"] / x["n"], centre[x["b"]] + x["sb"] / x["n"])
        for x in judged.where("flat").toLocalIterator()
    ]
    parts = [judged.where("NOT flat").select("a", "b", "r")]
    parts += [_again(known, again[i : i + _AGAIN]) for i in range(0, len(again), _AGAIN)]
    return reduce(DataFrame.unionByName, parts)


def _pearson() -> tuple[Column, Column, Column]:
    """Both variations and the correlation from the sums of a pair."""
    n, sa, sb, saa, sbb, sab = map(F.col, _SUMS)
    va, vb = saa - F.try_divide(sa * sa, n), sbb - F.try_divide(sb * sb, n)
    # Roots first: the product of two small variations may not be representable.
    spread = F.sqrt(F.greatest(va, F.lit(0.0))) * F.sqrt(F.greatest(vb, F.lit(0.0)))
    return va, vb, F.try_divide(sab - F.try_divide(sa * sb, n), spread)


def _sums(known: DataFrame, first: list[int], second: list[int], centre: np.ndarray) -> DataFrame:
    """``a, b`` and the sums of their shared rows, for pairs of one tile with another or itself."""
    same = first == second
    columns = first if same else first + second
    left, right = slice(0, len(first)), slice(0 if same else len(first), len(columns))
    middle = centre[columns]
    step = max(1, _STEP_BYTES // (8 * len(columns)))
    schema = "a int, b array<int>, " + ", ".join(f"{s} array<double>" for s in _SUMS)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, rows = np.zeros((len(_SUMS), len(first), len(second))), 0
        for batch in batches:
            rows += len(batch)
            for start in range(0, len(batch), step):
                x = batch.iloc[start : start + step].to_numpy(dtype=float) - middle
                seen = ~np.isnan(x)
                x[~seen] = 0.0
                m, sq = seen.astype(float), x * x
                for i, (p, q) in enumerate(((m, m), (x, m), (m, x), (sq, m), (m, sq), (x, x))):
                    sums[i] += p[:, left].T @ q[:, right]
        if rows:
            partners = np.array(second, dtype=np.int32)
            for start in range(0, len(first), _LINES):
                lines = range(start, min(start + _LINES, len(first)))
                later = [slice(line + 1 if same else 0, None) for line in lines]
                picked = {s: [sums[i, x, some] for x, some in zip(lines, later)] for i, s in enumerate(_SUMS)}
                yield pd.DataFrame({"a": [first[x] for x in lines], "b": [partners[some] for some in later], **picked})

    values = known.select(*[f"_{i}" for i in columns]).coalesce(_MOST_TASKS)
    parts = values.mapInPandas(partial, schema).select("a", F.inline(F.arrays_zip("b", *_SUMS)))
    return parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])


def _again(known: DataFrame, pairs: list[tuple[int, int, float, float]]) -> DataFrame:
    """``a, b, r`` of these pairs, centred at their own means; no correlation where one does not vary."""
    columns = sorted({i for pair in pairs for i in pair[:2]})
    place = {c: i for i, c in enumerate(columns)}
    ends = np.array([pair[:2] for pair in pairs], dtype=np.int32)
    at = np.array([[place[a], place[b]] for a, b in ends.tolist()])
    means = np.array([pair[2:] for pair in pairs], dtype=float)
    limits = ("low_a", "high_a", "low_b", "high_b")
    width = 256

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(_SUMS), len(pairs)))
        edges = np.tile(np.array([[np.inf], [-np.inf], [np.inf], [-np.inf]]), len(pairs))
        step, rows = max(1, _STEP_BYTES // (8 * max(width, len(columns)))), 0
        for batch in batches:
            rows += batch.num_rows
            for start in range(0, batch.num_rows, step):
                x = batch.slice(start, step).to_pandas().to_numpy(dtype=float)
                for f in range(0, len(pairs), width):
                    some = slice(f, f + width)
                    u, v = x[:, at[some, 0]], x[:, at[some, 1]]
                    both = ~(np.isnan(u) | np.isnan(v))
                    for i, values in ((0, u), (2, v)):
                        edges[i, some] = np.minimum(edges[i, some], np.where(both, values, np.inf).min(axis=0))
                        edges[i + 1, some] = np.maximum(edges[i + 1, some], np.where(both, values, -np.inf).max(axis=0))
                    u, v = np.where(both, u - means[some, 0], 0.0), np.where(both, v - means[some, 1], 0.0)
                    for i, added in enumerate((both, u, v, u * u, v * v, u * v)):
                        sums[i, some] += added.sum(axis=0)
        if rows:
            arrays = [ends[:, 0], ends[:, 1], *sums, *edges]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["a", "b", *_SUMS, *limits])

    schema = "a int, b int, " + ", ".join(f"{s} double" for s in _SUMS + limits)
    values = known.select(*[f"_{i}" for i in columns]).coalesce(_MOST_TASKS)
    total = values.mapInArrow(partial, schema).groupBy("a", "b").agg(
        *[F.sum(s).alias(s) for s in _SUMS],
        *[(F.min if s.startswith("low") else F.max)(s).alias(s) for s in limits],
    )
    varies = (F.col("low_a") < F.col("high_a")) & (F.col("low_b") < F.col("high_b"))
    return total.select("a", "b", F.when(varies, _pearson()[2]).alias("r"))


def correlation_matrix_long(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """P20: the full symmetric matrix, diagonal included, as a long table."""
    columns = list(columns or numeric_columns(df))
    half = correlations(df, columns)
    swapped = half.select(F.col("col_b").alias("col_a"), F.col("col_a").alias("col_b"), "r")
    varying = _known(df, columns).agg(
        *[F.when(F.min(f"_{i}") != F.max(f"_{i}"), F.lit(1.0)).alias(f"_{i}") for i in range(len(columns))]
    )
    diagonal = varying.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("col_a"), F.lit(c).alias("col_b"), F.col(f"_{i}").alias("r"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )
    return half.unionByName(swapped).unionByName(diagonal)


def high_correlated_columns(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.90
) -> list[str]:
    """Columns strongly correlated with any earlier column, in column order."""
    columns = list(columns or numeric_columns(df))
    strong = correlations(df, columns).where(F.abs("r") > threshold).select("col_b").distinct()
    found = {r["col_b"] for r in strong.collect()}
    return [c for c in columns if c in found]


def drop_correlated(
    df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.95
) -> DataFrame:
    """P8."""
    return df.drop(*high_correlated_columns(df, columns, threshold))
