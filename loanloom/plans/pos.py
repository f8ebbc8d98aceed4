"""Monthly balances of point-of-sale and cash loans.

A loan (``SK_ID_PREV``) belongs to one applicant, so loan-level results stay
with the applicant's rows and need no second shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanloom.functions.expr import dummy, flag, safe_div
from loanloom.operators.encode import Vocabulary
from loanloom.operators.fit import sized_facts
from loanloom.operators.recency import MONTH_SLICES, Block, recency_features, roll_up


def pos_row_features(df: DataFrame) -> DataFrame:
    """X14."""
    return df.withColumn("LATE_PAYMENT", flag(F.col("SK_DPD") > 0))


def loan_outcomes(df: DataFrame, by: list[str], order: list[str], extra=()) -> DataFrame:
    """Per loan its completion, early completion and what remains.

    First and last skip missing values and follow the explicit order.
    """
    place = F.struct(*order)

    def edge(pick, column: str):
        return pick(F.when(F.col(column).isNotNull(), F.struct(place, F.col(column).alias("v"))))["v"]

    first_plan, last_plan = edge(F.min, "CNT_INSTALMENT"), edge(F.max, "CNT_INSTALMENT")
    remaining = edge(F.max, "CNT_INSTALMENT_FUTURE")
    completed = F.expr(f"avg({dummy('NAME_CONTRACT_STATUS', 'Completed')})")
    return df.groupBy(*by).agg(
        completed.alias("POS_LOAN_COMPLETED_MEAN"),
        flag((first_plan - last_plan > 0) & (completed > 0)).alias("POS_COMPLETED_BEFORE_MEAN"),
        remaining.alias("POS_REMAINING_INSTALMENTS"),
        safe_div(remaining, last_plan).alias("POS_REMAINING_INSTALMENTS_RATIO"),
        *extra,
    )


LOAN_FEATURES = (
    "POS_LOAN_COMPLETED_MEAN", "POS_COMPLETED_BEFORE_MEAN",
    "POS_REMAINING_INSTALMENTS", "POS_REMAINING_INSTALMENTS_RATIO",
)


def pos_block(vocabulary: Vocabulary, tie_break: tuple[str, ...] = ()) -> Block:
    """Rows to loans, then loans to the applicant.

    The row-level statistics travel through the loan level as mergeable parts
    (sum, count, extremes), so both levels are one chain of aggregations.
    """
    dummies = vocabulary.dummies()
    order = ["MONTHS_BALANCE", *tie_break]

    def aggregate(df: DataFrame, by: list[str]) -> DataFrame:
        parts = [F.count(F.lit(1)).alias("_n")]
        for c in ("SK_DPD_DEF", "SK_DPD", "MONTHS_BALANCE"):
            parts += [F.max(c).alias(f"_max_{c}"), F.sum(c).alias(f"_sum_{c}"), F.count(c).alias(f"_n_{c}")]
        parts += [F.min(c).alias(f"_min_{c}") for c in ("SK_DPD_DEF", "SK_DPD")]
        parts += [F.max(c).alias(f"_max_{c}") for c in ("CNT_INSTALMENT", "CNT_INSTALMENT_FUTURE")]
        parts += [F.sum("CNT_INSTALMENT_FUTURE").alias("_sum_CNT_INSTALMENT_FUTURE")]
        parts += [F.expr(f"sum({d}) AS `_sum_{n}`") for n, d in dummies.items()]
        loans = loan_outcomes(df, [*by, "SK_ID_PREV"], order, parts)

        def mean(c: str):
            return safe_div(F.sum(f"_sum_{c}"), F.sum(f"_n_{c}"))

        rows = F.sum("_n")
        columns = []
        for c in ("SK_DPD_DEF", "SK_DPD"):
            columns += [
                F.max(f"_max_{c}").alias(f"POS_{c}_MAX"),
                mean(c).alias(f"POS_{c}_MEAN"),
                F.min(f"_min_{c}").alias(f"POS_{c}_MIN"),
            ]
        columns += [
            F.max("_max_MONTHS_BALANCE").alias("POS_MONTHS_BALANCE_MAX"),
            mean("MONTHS_BALANCE").alias("POS_MONTHS_BALANCE_MEAN"),
            rows.alias("POS_MONTHS_BALANCE_SIZE"),
            F.max("_max_CNT_INSTALMENT").alias("POS_CNT_INSTALMENT_MAX"),
            rows.alias("POS_CNT_INSTALMENT_SIZE"),
            F.max("_max_CNT_INSTALMENT_FUTURE").alias("POS_CNT_INSTALMENT_FUTURE_MAX"),
            rows.alias("POS_CNT_INSTALMENT_FUTURE_SIZE"),
            F.coalesce(F.sum("_sum_CNT_INSTALMENT_FUTURE"), F.lit(0)).alias("POS_CNT_INSTALMENT_FUTURE_SUM"),
        ]
        columns += [safe_div(F.sum(f"_sum_{n}"), rows).alias(f"POS_{n}_MEAN") for n in dummies]
        # Rows without a loan id count as rows of the applicant but form no loan.
        is_loan = F.col("SK_ID_PREV").isNotNull()
        columns += [
            F.when(
                F.count_if(is_loan) > 0, F.coalesce(F.sum(F.when(is_loan, F.col(c))), F.lit(0))
            ).alias(c)
            for c in LOAN_FEATURES
        ]
        return loans.groupBy(*by).agg(*columns)

    return Block(aggregate)


def pos_features(df: DataFrame, tie_break: tuple[str, ...] = (), hot=None) -> DataFrame:
    """F5."""
    vocabulary, hot, rows = sized_facts(df, None, None, hot)
    return roll_up(df, "SK_ID_CURR", pos_block(vocabulary, tie_break), hot, rows)


def pos_recency(
    df: DataFrame,
    strategy: str = "tagged",
    tie_break: tuple[str, ...] = (),
    slices=MONTH_SLICES,
    hot=None,
    vocabulary: Vocabulary | None = None,
) -> DataFrame:
    """Five look-back slices on the balance month."""
    vocabulary, hot, rows = sized_facts(df, None, vocabulary, hot)
    block = pos_block(vocabulary, tie_break)
    return recency_features(df, "SK_ID_CURR", "MONTHS_BALANCE", slices, block, strategy, hot, rows)


