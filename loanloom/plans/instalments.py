"""Repayments of instalments.

A loan belongs to one applicant, so the sum paid per instalment number is taken
inside the applicant's rows. Within a slice only the payments of that slice
count towards it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanloom.functions.expr import clip_at_zero, flag, safe_div
from loanloom.operators.attach import attach_stats_in_place
from loanloom.operators.clean import fill_constant
from loanloom.operators.encode import Vocabulary
from loanloom.operators.fit import sized_facts
from loanloom.operators.recency import DAY_SLICES, Block, recency_features, roll_up

# Days past due that open a bucket.
DPD_BUCKETS = {"7": 7, "15": 15, "30": 30, "60": 60, "90": 90, "180": 180, "WOF": 720}
INSTALMENT = ("SK_ID_PREV", "NUM_INSTALMENT_NUMBER")


def attach_payment_sum(df: DataFrame) -> DataFrame:
    """Everything paid towards the same instalment number of the same loan."""
    attached = attach_stats_in_place(df, INSTALMENT, {"_n": F.count(F.lit(1)), "AMT_PAYMENT_GROUPED": F.sum("AMT_PAYMENT")})
    paid = F.when(F.col("_n").isNotNull(), F.coalesce("AMT_PAYMENT_GROUPED", F.lit(0)))
    return attached.withColumn("AMT_PAYMENT_GROUPED", paid).drop("_n")


def late_columns(df: DataFrame, late_from: str = "DBD", mode: str = "null") -> DataFrame:
    """X16-X19 except what needs the payment sum."""
    over = F.col("AMT_PAYMENT") - F.col("AMT_INSTALMENT")
    days = F.col("DAYS_ENTRY_PAYMENT") - F.col("DAYS_INSTALMENT")
    df = df.withColumns(
        {
            "PAID_OVER_AMOUNT": over,
            "PAID_OVER": flag(over > 0),
            "DPD": clip_at_zero(days),
            "DBD": clip_at_zero(-days),
            "INSTALMENT_PAYMENT_RATIO": safe_div("AMT_PAYMENT", "AMT_INSTALMENT", mode),
        }
    ).withColumn("LATE_PAYMENT", flag(F.col(late_from) > 0))
    df = df.withColumn(
        "LATE_PAYMENT_RATIO",
        F.when(F.col("LATE_PAYMENT") == 1, F.col("INSTALMENT_PAYMENT_RATIO")).otherwise(F.lit(0.0)),
    )
    return df.withColumns(
        {
            "SIGNIFICANT_LATE_PAYMENT": flag(F.col("LATE_PAYMENT_RATIO") > 0.05),
            **{f"DPD_{name}": flag(F.col("DPD") >= days) for name, days in DPD_BUCKETS.items()},
        }
    )


def instalment_row_features(df: DataFrame, late_from: str = "DBD", mode: str = "null") -> DataFrame:
    """All row-level features of a repayment."""
    grouped = F.col("AMT_PAYMENT_GROUPED")
    return late_columns(attach_payment_sum(df), late_from, mode).withColumns(
        {
            "PAYMENT_DIFFERENCE": F.col("AMT_INSTALMENT") - grouped,
            "PAYMENT_RATIO": safe_div("AMT_INSTALMENT", grouped, mode),
        }
    )


def instalment_block(vocabulary: Vocabulary, late_from: str = "DBD", mode: str = "null") -> Block:
    """Repayments to one row per applicant.

    Rows are first combined per instalment and version. The sum paid per
    instalment is then a window over those few combined rows, and the
    difference to it follows from extremes, sum and count of the amounts due.
    """
    dummies = vocabulary.dummies()

    def aggregate(df: DataFrame, by: list[str]) -> DataFrame:
        keys = [*by, *INSTALMENT]
        paid, due, entry, over, late = (
            "AMT_PAYMENT", "AMT_INSTALMENT", "DAYS_ENTRY_PAYMENT", "PAID_OVER_AMOUNT", "LATE_PAYMENT",
        )
        parts = [F.count(F.lit(1)).alias("_n")]
        for c in (paid, due, entry, over, late):
            parts += [
                F.min(c).alias(f"_min_{c}"), F.max(c).alias(f"_max_{c}"),
                F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_n_{c}"),
            ]
        parts += [F.expr(f"sum({d}) AS `_sum_{n}`") for n, d in dummies.items()]
        combined = df.groupBy(*keys, "NUM_INSTALMENT_VERSION").agg(*parts)

        known = F.col(INSTALMENT[0]).isNotNull() & F.col(INSTALMENT[1]).isNotNull()
        grouped = F.when(known, F.coalesce(F.sum(f"_sum_{paid}").over(Window.partitionBy(*keys)), F.lit(0)))
        combined = combined.withColumn("_grouped", grouped)

        def total(c: str):
            return F.coalesce(F.sum(f"_sum_{c}"), F.lit(0))

        def mean(c: str):
            return safe_div(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}"))

        n_diff = F.when(F.col("_grouped").isNotNull(), F.col(f"_n_{due}")).otherwise(F.lit(0))
        sum_diff = F.coalesce(F.sum(F.col(f"_sum_{due}") - F.col(f"_n_{due}") * F.col("_grouped")), F.lit(0))
        columns = [
            F.max(f"_max_{late}").alias("INS_LATE_PAYMENT_MAX"),
            mean(late).alias("INS_LATE_PAYMENT_MEAN"),
            F.min(f"_min_{late}").alias("INS_LATE_PAYMENT_MIN"),
            F.min(f"_min_{paid}").alias("INS_AMT_PAYMENT_MIN"),
            F.max(f"_max_{paid}").alias("INS_AMT_PAYMENT_MAX"),
            mean(paid).alias("INS_AMT_PAYMENT_MEAN"),
            total(paid).alias("INS_AMT_PAYMENT_SUM"),
            F.count_distinct("NUM_INSTALMENT_VERSION").alias("INS_NUM_INSTALMENT_VERSION_NUNIQUE"),
            F.max("NUM_INSTALMENT_NUMBER").alias("INS_NUM_INSTALMENT_NUMBER_MAX"),
            F.max(f"_max_{due}").alias("INS_AMT_INSTALMENT_MAX"),
            mean(due).alias("INS_AMT_INSTALMENT_MEAN"),
            total(due).alias("INS_AMT_INSTALMENT_SUM"),
            F.max(F.col(f"_max_{due}") - F.col("_grouped")).alias("INS_PAYMENT_DIFFERENCE_MAX"),
            safe_div(sum_diff, F.sum(n_diff)).alias("INS_PAYMENT_DIFFERENCE_MEAN"),
            F.min(F.col(f"_min_{due}") - F.col("_grouped")).alias("INS_PAYMENT_DIFFERENCE_MIN"),
            sum_diff.alias("INS_PAYMENT_DIFFERENCE_SUM"),
            F.max(f"_max_{entry}").alias("INS_DAYS_ENTRY_PAYMENT_MAX"),
            mean(entry).alias("INS_DAYS_ENTRY_PAYMENT_MEAN"),
            total(entry).alias("INS_DAYS_ENTRY_PAYMENT_SUM"),
            F.max(f"_max_{over}").alias("INS_PAID_OVER_AMOUNT_MAX"),
            mean(over).alias("INS_PAID_OVER_AMOUNT_MEAN"),
            F.min(f"_min_{over}").alias("INS_PAID_OVER_AMOUNT_MIN"),
        ]
        columns += [safe_div(F.sum(f"_sum_{n}"), F.sum("_n")).alias(f"INS_{n}_MEAN") for n in dummies]
        columns.append(F.sum("_n").alias("INSTALLATION_COUNT"))
        return combined.groupBy(*by).agg(*columns)

    return Block(aggregate, prepare=lambda df: late_columns(df, late_from, mode))


def instalment_features(df: DataFrame, late_from: str = "DBD", hot=None, mode: str = "null") -> DataFrame:
    """F6."""
    vocabulary, hot, rows = sized_facts(df, None, None, hot)
    return roll_up(df, "SK_ID_CURR", instalment_block(vocabulary, late_from, mode), hot, rows)


def instalment_recency(
    df: DataFrame,
    strategy: str = "tagged",
    late_from: str = "DBD",
    slices=DAY_SLICES,
    hot=None,
    vocabulary: Vocabulary | None = None,
    mode: str = "null",
) -> DataFrame:
    """Seven look-back slices on the due day; missing payments count as 0."""
    df = fill_constant(df, {"DAYS_ENTRY_PAYMENT": 0, "AMT_PAYMENT": 0})
    vocabulary, hot, rows = sized_facts(df, None, vocabulary, hot)
    block = instalment_block(vocabulary, late_from, mode)
    return recency_features(df, "SK_ID_CURR", "DAYS_INSTALMENT", slices, block, strategy, hot, rows)
