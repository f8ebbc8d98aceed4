"""M2-M4: ANOVA F scores, top-k features, standardisation and column alignment."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import finite_or_zero

# Aggregates per pass; wide matrices are scanned in column slices, which a
# columnar source reads only once in total.
_FEATURES_PER_PASS = 200


def anova_f(df: DataFrame, features: Sequence[str], label: str, fill: bool = True) -> DataFrame:
    """M2: ``(feature, f_score)``; NULL for a feature without any variation.

    Per class only count, mean and variance are needed, which merge across
    partitions; the classes are few, so the last step is a small table.
    """
    features = list(features)
    result = None
    for start in range(0, len(features), _FEATURES_PER_PASS):
        part = _anova_slice(df, features[start : start + _FEATURES_PER_PASS], label, fill)
        result = part if result is None else result.unionByName(part)
    return result


def _anova_slice(df: DataFrame, features: list[str], label: str, fill: bool) -> DataFrame:
    values = [finite_or_zero(f) if fill else F.col(f).cast("double") for f in features]
    per_class = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        *[
            F.struct(
                F.lit(f).alias("feature"),
                F.count(v).alias("n"),
                F.avg(v).alias("mean"),
                F.var_pop(v).alias("var"),
            ).alias(f"_{i}")
            for i, (f, v) in enumerate(zip(features, values, strict=True))
        ]
    )
    long = per_class.select(F.inline(F.array(*[f"_{i}" for i in range(len(features))])))
    totals = long.groupBy("feature").agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
    )
    spread = long.join(F.broadcast(totals.withColumnRenamed("n", "total")), "feature").groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"),
        F.sum(F.col("n") * F.col("var")).alias("within"),
        F.max("total").alias("total"),
        F.max("k").alias("k"),
    )
    ms_between = F.try_divide(F.col("between"), (F.col("k") - 1).cast("double"))
    ms_within = F.try_divide(F.col("within"), (F.col("total") - F.col("k")).cast("double"))
    score = F.when((ms_within == 0) & (ms_between > 0), F.lit(float("inf"))).otherwise(
        F.try_divide(ms_between, ms_within)
    )
    return spread.select("feature", score.alias("f_score"))


def top_features(scores: DataFrame, k: int = 20) -> DataFrame:
    """T4: the k best, ties by name; features without a score come last."""
    return scores.orderBy(F.col("f_score").desc_nulls_last(), "feature").limit(k)


def select_k_best(df: DataFrame, features: Sequence[str], label: str, k: int = 20) -> list[str]:
    """M2: names of the k best features in table order."""
    best = {r["feature"] for r in top_features(anova_f(df, features, label), k).collect()}
    return [f for f in features if f in best]


Scaler = Mapping[str, tuple[float, float]]


def fit_scaler(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """M3: mean and population deviation per column, missing ignored; no variation divides by 1."""
    row = df.agg(
        *[a for i, c in enumerate(columns) for a in (F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}"))]
    ).first()
    return {
        c: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)
    }


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    """M3: apply fitted means and deviations."""
    return df.withColumns({c: (F.col(c) - m) / s for c, (m, s) in scaler.items()})


def align_columns(df: DataFrame, like: Sequence[str]) -> DataFrame:
    """M4: exactly the given columns in that order; a dummy never seen here is 0."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(0).alias(c) for c in like])
